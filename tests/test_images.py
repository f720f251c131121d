"""Pixel operators on small made-up images and files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.operators import images as I


def png(pixels, filters=(0,)):
    """Encode with the given row filters, in turn."""
    bits = pixels.dtype.itemsize * 8
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    step = (1 if pixels.ndim == 2 else pixels.shape[2]) * bits // 8
    height = pixels.shape[0]
    raw = np.frombuffer(pixels.astype(pixels.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(height, -1).astype(int)
    out = b""
    for y in range(height):
        kind = filters[y % len(filters)]
        up = raw[y - 1] if y else np.zeros_like(raw[0])
        left = np.concatenate([np.zeros(step, int), raw[y][:-step]])
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        near = left + up - corner
        order = np.stack([abs(near - left), abs(near - up), abs(near - corner)])
        paeth = np.choose(order.argmin(axis=0), [left, up, corner])
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        out += bytes([kind]) + ((raw[y] - guess) % 256).astype(np.uint8).tobytes()
    body = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    head = struct.pack(">IIBBBBB", pixels.shape[1], height, bits, colour, 0, 0, 0)
    return I.PNG_START + body(b"IHDR", head) + body(b"IDAT", zlib.compress(out)) + body(b"IEND", b"")


RANDOM = np.random.default_rng(1)


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("shape,kind", [((9, 7), np.uint8), ((6, 11), np.uint16), ((5, 4, 3), np.uint8)])
def test_png_round_trip(filters, shape, kind):
    pixels = RANDOM.integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (I.read_png(png(pixels, filters)) == pixels).all()


def test_min_max_and_flat():
    assert I.min_max(np.array([[10, 20], [30, 60]], np.uint16)).tolist() == [[0, 51], [102, 255]]
    assert I.min_max(np.full((2, 2), 9, np.uint16)).tolist() == [[0, 0], [0, 0]]


def test_equalise():
    assert I.equalise(np.full((3, 3), 8, np.uint8)).tolist() == [[8] * 3] * 3
    assert I.equalise(np.array([[1, 1], [5, 9]], np.uint8)).tolist() == [[0, 0], [128, 255]]


@pytest.mark.parametrize("shape,before,after", [((2, 5), (1, 2), (0, 0)), ((5, 2), (0, 0), (1, 2))])
def test_pad_puts_the_odd_pixel_last(shape, before, after):
    image = np.full(shape, 7, np.uint8)
    image[0, 0] = 3
    padded = I.pad_square(image)
    assert padded.shape == (5, 5)
    rows, columns = before, after
    inner = padded[rows[0] : 5 - rows[1], columns[0] : 5 - columns[1]]
    assert (inner == image).all() and padded.sum() == image.sum() + 3 * (25 - image.size)


def test_grey_swaps_by_default():
    red = np.zeros((1, 1, 3), np.uint8)
    red[..., 0] = 200
    assert I.grey(red)[0, 0] == round(0.114 * 200) and I.grey(red, "rgb")[0, 0] == round(0.299 * 200)


def test_resizing_keeps_flat_and_identity():
    flat, image = np.full((7, 9), 77, np.uint8), RANDOM.integers(0, 255, (6, 6)).astype(np.uint8)
    for resize in (I.resize_bilinear, I.resize_smooth, lambda a, h, w: I.resize_smooth(a, h, w, "triangle")):
        assert (resize(flat, 4, 15) == 77).all()
        assert (resize(image, 6, 6) == image).all()
    assert I.resize_bilinear(np.array([[0, 100]], np.uint8), 1, 4).tolist() == [[0, 25, 75, 100]]


def test_model_input_shape_and_range():
    out = I.model_input(RANDOM.integers(0, 255, (40, 60, 3)).astype(np.uint8), 16)
    assert out.shape == (3, 16, 16) and out.dtype == np.float32 and out.min() >= 0 and out.max() <= 1


@pytest.fixture()
def folder(tmp_path):
    wide = RANDOM.integers(0, 4000, (20, 33)).astype(np.uint16)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png(wide))
    (tmp_path / "sub" / "b.PNG").write_bytes(png(RANDOM.integers(0, 255, (30, 20)).astype(np.uint8)))
    (tmp_path / "c.png").write_bytes(png(RANDOM.integers(0, 255, (12, 12, 3)).astype(np.uint8)))
    (tmp_path / "cut.png").write_bytes(png(wide)[:300])
    (tmp_path / "text.png").write_bytes(b"x" * 200)
    (tmp_path / "small.png").write_bytes(I.PNG_START)
    (tmp_path / ".hidden.png").write_bytes(png(wide))
    (tmp_path / "note.txt").write_bytes(b"x" * 200)
    return tmp_path


def test_prepare_folder(spark, folder):
    done = I.prepare_folder(spark, str(folder), "padchest", 16)
    got = {r.path.rsplit("/", 1)[1]: r for r in done.collect()}
    assert set(got) == {"a.png", "c.png", "cut.png", "text.png", "small.png"}
    assert (got["a.png"].height, got["a.png"].width, got["a.png"].mode, got["a.png"].error) == (16, 16, 0, None)
    assert "more than one channel" in got["c.png"].error
    assert "OSError" in got["cut.png"].error and got["text.png"].error == got["small.png"].error == "not an image file"
    assert I.quarantined(done).count() == 4


def test_finished_files_are_skipped(spark, folder):
    every = I.prepare_folder(spark, str(folder), "openi", 8)
    first = every.filter("error IS NULL").select("path")
    assert first.count() == 2
    rest = I.prepare_folder(spark, str(folder), "openi", 8, finished=first)
    assert rest.filter("error IS NULL").count() == 0 and rest.count() == every.count() - 2


def test_finished_folders_are_skipped_as_a_whole(spark, folder):
    every = I.prepare_folder(spark, str(folder), "chestxray14", 8)
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    sub = every.filter("path LIKE '%/sub/%'").select("path")
    rest = I.prepare_folder(spark, str(folder), "chestxray14", 8, finished=sub.union(every.filter("path LIKE '%a.png'").select("path")))
    assert names(every) == ["a.png", "b.PNG", "c.png", "cut.png", "small.png", "text.png"]
    assert names(rest) == ["a.png", "c.png", "cut.png", "small.png", "text.png"]


def test_eight_bit_source(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in I.decode_8bit(spark, str(folder), "*.{png,PNG}").collect()}
    assert got["b.PNG"].height == 30 and got["text.png"].error and got["text.png"].height == -1
    colour = I.decode_8bit(spark, str(folder), "c.png")
    mine = I.decode_png(spark.read.format("binaryFile").load(str(folder / "c.png")))
    swap = I.apply_to_images(colour, lambda a: a, bgr=True)
    assert swap.first().data == mine.first().data


def test_smooth_preset_takes_colour(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r.error for r in I.prepare_folder(spark, str(folder), "covidx", 8).collect()}
    assert got["c.png"] is None and got["b.PNG"] is None


def test_magic(spark):
    from reportlake.operators.columns import looks_like_image

    rows = [(b"\xff\xd8\xff" + b"0" * 97, True), (b"\xff\xd8\xff" + b"0" * 96, False), (b"RIFF0000WEBP" + b"0" * 99, True), (b"0WEBP" + b"0" * 99, False), (b"", False), (None, False)]
    df = spark.createDataFrame([(c,) for c, _ in rows], "content binary")
    assert [r[0] for r in df.select(looks_like_image("content")).collect()] == [v for _, v in rows]
    assert df.filter(F.col("content").isNull()).count() == 1


def direct_resize(line, target, kind):
    """One line of pixels, weight by weight."""
    size = len(line)
    scale = size / target
    widen = max(scale, 1.0)
    reach = {"triangle": 1, "lanczos": 3}[kind] * widen
    out = []
    for i in range(target):
        centre = (i + 0.5) * scale
        total = weight = 0.0
        for j in range(max(int(centre - reach + 0.5), 0), min(int(centre + reach + 0.5), size)):
            x = (j + 0.5 - centre) / widen
            w = max(0, 1 - abs(x)) if kind == "triangle" else (float(np.sinc(x) * np.sinc(x / 3)) if abs(x) < 3 else 0.0)
            total, weight = total + w * line[j], weight + w
        out.append(min(max(int(np.floor(total / weight + 0.5)), 0), 255))
    return out


@pytest.mark.parametrize("kind", ["triangle", "lanczos"])
@pytest.mark.parametrize("shape,target", [((9, 14), (4, 20)), ((5, 5), (12, 3)), ((30, 7), (7, 7))])
def test_smooth_resize_matches_a_direct_sum(kind, shape, target):
    image = RANDOM.integers(0, 255, shape).astype(np.uint8)
    wide = [direct_resize(row.tolist(), target[1], kind) for row in image] if target[1] != shape[1] else image.tolist()
    columns = [direct_resize([row[x] for row in wide], target[0], kind) for x in range(target[1])]
    wanted = np.array(columns).T
    assert np.abs(I.resize_smooth(image, *target, kind).astype(int) - wanted).max() <= 1
