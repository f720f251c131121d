"""Pixel work as Arrow batches of image rows.

An image row is (path, height, width, n_channels, mode, data), the layout of
Spark's ``image`` source with RGB channel order. Each function on arrays is a
small NumPy helper; Spark cuts the files into tasks and keeps the bad rows in a
quarantine column.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.operators.columns import looks_like_image
from reportlake.operators.joins import missing, split_heavy
from reportlake.plans.ordinals import by_digest
from reportlake.session import scratch, stage
from reportlake.sources.files import files, has_suffix  # noqa: F401
from reportlake.sources.tree import visible_files, with_content

IMAGE_SCHEMA = "path string, height int, width int, n_channels int, mode int, data binary, error string"

# Type codes of the data buffer, per channel count 1.
DEPTH = {0: np.uint8, 2: np.uint16, 5: np.float32}
# Luminance weights in 15-bit fixed point, in the order they are applied.
GREY_WEIGHTS = {"as_bgr": (3735, 19235, 9798), "rgb": (9798, 19235, 3735)}
GREY_BITS = 15
PNG_START = b"\x89PNG\r\n\x1a\n"


def mode_of(array: np.ndarray) -> int:
    channels = 1 if array.ndim == 2 else array.shape[2]
    depth = {v: k for k, v in DEPTH.items()}[array.dtype.type]
    return depth + 8 * (channels - 1)


def to_array(height: int, width: int, mode: int, data: bytes) -> np.ndarray:
    channels = mode // 8 + 1
    array = np.frombuffer(data, dtype=DEPTH[mode % 8])
    return array.reshape((height, width) if channels == 1 else (height, width, channels))


def min_max(image: np.ndarray) -> np.ndarray:
    """Stretch to 0-255 in single precision, cut to whole numbers; flat stays 0."""
    pixels = image.astype(np.float32)
    pixels = pixels - pixels.min()
    top = pixels.max()
    if top != 0:
        pixels = pixels / top
    return (pixels * np.float32(255.0)).astype(np.uint8)


def cast_8bit(image: np.ndarray) -> np.ndarray:
    """Keep the low byte of whole numbers."""
    return image.astype(np.uint8)


def grey(image: np.ndarray, channel_order: str = "as_bgr") -> np.ndarray:
    """One channel; by default the weights meet the channels in swapped order."""
    if image.ndim == 2:
        return image
    summed = image[:, :, :3].astype(np.int64) @ np.array(GREY_WEIGHTS[channel_order])
    return ((summed + (1 << GREY_BITS - 1)) >> GREY_BITS).astype(np.uint8)


def equalise(image: np.ndarray) -> np.ndarray:
    """I4: histogram equalisation; an image of one level is unchanged."""
    counts = np.bincount(image.ravel(), minlength=256)
    lowest = np.flatnonzero(counts)[0]
    first, total = counts[lowest], image.size
    if first == total:
        return image
    scale = np.float32(255.0) / np.float32(total - first)
    summed = np.cumsum(counts) - first
    table = np.rint(np.maximum(summed, 0).astype(np.float32) * scale)
    return table.clip(0, 255).astype(np.uint8)[image]


def pad_square(image: np.ndarray) -> np.ndarray:
    """Square with the image minimum; an odd pixel goes right or below."""
    height, width = image.shape[:2]
    side = max(height, width)
    above, left = (side - height) // 2, (side - width) // 2
    edges = [(above, side - height - above), (left, side - width - left)]
    return np.pad(image, edges + [(0, 0)] * (image.ndim - 2), constant_values=image.min())


def _half_pixel(size: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = (np.arange(target) + 0.5) * (size / target) - 0.5
    low = np.floor(at).astype(int)
    part = np.clip(at - low, 0.0, 1.0)
    part[at < 0] = 0.0
    return low.clip(0, size - 1), (low + 1).clip(0, size - 1), part


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Two-point bilinear with half-pixel centres, no smoothing when shrinking."""
    pixels = image.astype(np.float64)
    top, bottom, down = _half_pixel(image.shape[0], height)
    left, right, across = _half_pixel(image.shape[1], width)
    down = down.reshape((-1,) + (1,) * (image.ndim - 1))
    rows = pixels[top] * (1 - down) + pixels[bottom] * down
    across = across.reshape((1, -1) + (1,) * (image.ndim - 2))
    result = rows[:, left] * (1 - across) + rows[:, right] * across
    return np.floor(result + 0.5).clip(0, 255).astype(np.uint8)


def _kernel(kind: str, x: np.ndarray) -> np.ndarray:
    if kind == "triangle":
        return np.maximum(1 - np.abs(x), 0)
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _weights(size: int, target: int, kind: str) -> np.ndarray:
    """Rows of weights: the kernel widens when shrinking, so pixels are averaged."""
    scale = size / target
    widen = max(scale, 1.0)
    reach = {"triangle": 1.0, "lanczos": 3.0}[kind] * widen
    centre = (np.arange(target) + 0.5) * scale
    first = np.maximum(np.floor(centre - reach + 0.5), 0)
    last = np.minimum(np.floor(centre + reach + 0.5), size)
    place = np.arange(size)
    weights = _kernel(kind, (place[None, :] + 0.5 - centre[:, None]) / widen)
    weights[(place[None, :] < first[:, None]) | (place[None, :] >= last[:, None])] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def resize_smooth(image: np.ndarray, height: int, width: int, kind: str = "lanczos") -> np.ndarray:
    """Resize with a widening kernel, columns first, whole numbers between."""
    def whole(x: np.ndarray) -> np.ndarray:
        return np.floor(x + 0.5).clip(0, 255)

    pixels = image.astype(np.float64)
    if width != image.shape[1]:
        pixels = whole(np.moveaxis(np.tensordot(_weights(image.shape[1], width, kind), pixels, (1, 1)), 0, 1))
    if height != image.shape[0]:
        pixels = whole(np.tensordot(_weights(image.shape[0], height, kind), pixels, (1, 0)))
    return pixels.astype(np.uint8)


def model_input(image: np.ndarray, size: int = 224) -> np.ndarray:
    """I8: short side to ``size + 16``, centre crop, values in [0, 1], channels first."""
    height, width = image.shape[:2]
    short = size + 16
    if height <= width:
        height, width = short, int(short * width / height)
    else:
        height, width = int(short * height / width), short
    small = resize_smooth(image, height, width, "triangle")
    top, left = int(round((height - size) / 2.0)), int(round((width - size) / 2.0))
    crop = small[top : top + size, left : left + size].astype(np.float32) / np.float32(255)
    return crop[None] if crop.ndim == 2 else np.moveaxis(crop, 2, 0)


@dataclass(frozen=True)
class Preset:
    """What one image source needs."""

    suffixes: tuple[str, ...]
    recursive: bool
    stretch: bool
    to_grey: bool
    resize: str
    skip_finished: str  # "no", "file", "folder"


# The steps of each public image collection.
PRESETS = {
    "padchest": Preset(("png",), False, True, False, "bilinear", "no"),
    "mimic": Preset(("png",), False, True, False, "bilinear", "no"),
    "chexpert": Preset(("jpg", "jpeg"), True, True, False, "bilinear", "file"),
    "chestxray14": Preset(("png",), True, True, True, "bilinear", "folder"),
    "covidx": Preset(("png", "jpg", "jpeg"), True, False, True, "lanczos", "file"),
    "openi": Preset(("png",), True, False, False, "bilinear", "file"),
}


def prepared(image: np.ndarray, preset: Preset, size: int, channel_order: str = "as_bgr") -> np.ndarray:
    """The steps of a preset on one image."""
    image = min_max(image) if preset.stretch else cast_8bit(image)
    if preset.to_grey:
        image = grey(image, channel_order)
    if image.ndim != 2:
        raise ValueError("more than one channel")
    image = pad_square(equalise(image))
    if preset.resize == "lanczos":
        return resize_smooth(image, size, size, "lanczos")
    return resize_bilinear(image, size, size)


def undo_filters(lines: np.ndarray, step: int) -> np.ndarray:
    """PNG scan lines (a filter byte and the bytes of the line) back to bytes, in array steps.

    A pixel needs its neighbours to the left, above and between. All pixels of a diagonal that runs down
    to the left have theirs on earlier diagonals, so each diagonal is one step; in
    the flat image its pixels are evenly spaced.
    """
    kinds, (height, width) = lines[:, :1].astype(np.int16), (len(lines), (lines.shape[1] - 1) // step)
    if kinds.max(initial=0) > 4:
        raise SyntaxError(f"unknown filter {kinds.max()}")
    if not kinds.any():
        return lines[:, 1:]
    data = lines[:, 1:].astype(np.int16).reshape(-1, step)
    row = width + 1
    out = np.zeros(((height + 1) * row, step), np.int16)  # a border of zeros above and to the left
    used = set(np.unique(kinds).tolist())
    for t in range(height + width - 1):
        top, low = max(0, t - width + 1), min(height - 1, t)
        span = (low - top) * width + 1
        here = (top + 1) * row + t - top + 1
        a, b, c = (out[at : at + span : width] for at in (here - 1, here - row, here - row - 1))
        first = top * (width - 1) + t
        kind = kinds[top : low + 1]
        guess = np.where(kind == 1, a, np.where(kind == 2, b, np.int16(0)))
        if 3 in used:
            guess = np.where(kind == 3, (a + b) >> 1, guess)
        if 4 in used:
            down, left = b - c, a - c
            near_a, near_b, near_c = np.abs(down), np.abs(left), np.abs(down + left)
            best = np.where((near_a <= near_b) & (near_a <= near_c), a, np.where(near_b <= near_c, b, c))
            guess = np.where(kind == 4, best, guess)
        values = data[first : first + (low - top) * (width - 1) + 1 : max(1, width - 1)]
        out[here : here + span : width] = (values + guess) & 255
    return out.reshape(height + 1, row, step)[1:, 1:].astype(np.uint8).reshape(height, width * step)


# fixed values: start and step of the seven passes of an interlaced PNG, as (x, y, dx, dy)
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(raw: np.ndarray, height: int, width: int, bits: int, channels: int) -> tuple[np.ndarray, int]:
    """Samples of one pass (height, width, channels) and the bytes that it took."""
    stride = (width * channels * bits + 7) // 8
    size = height * (stride + 1)
    if raw.size < size:
        raise OSError("image data is truncated")
    flat = undo_filters(raw[:size].reshape(height, stride + 1), max(1, channels * bits // 8))
    if bits == 16:
        flat = np.ascontiguousarray(flat).view(">u2").astype(np.uint16)
    elif bits < 8:
        parts = np.unpackbits(flat, axis=1).reshape(height, -1, bits)
        flat = (parts << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : width * channels]
    return flat.reshape(height, width, channels), size


def read_png(content: bytes) -> np.ndarray:
    """PNG of any colour type and depth; Spark's own reader keeps 8 bits of 16.

    Grey of fewer than 8 bits is scaled to 8, palette images become RGB, or RGBA if the palette is transparent.
    """
    if not content.startswith(PNG_START):
        raise ValueError("cannot identify image file")
    at, parts, head, palette, alpha = len(PNG_START), [], None, b"", b""
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise OSError("image file is truncated")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = body
        elif name == b"tRNS":
            alpha = body
        elif name == b"IDAT":
            parts.append(body)
        elif name == b"IEND":
            break
        elif not name.isalpha():
            raise SyntaxError(f"broken PNG file (chunk {name!r})")
        at += size + 12
    if head is None or not parts:
        raise OSError("image file is truncated")
    width, height, bits, colour, _, _, interlaced = head
    if bits not in (1, 2, 4, 8, 16) or colour not in (0, 2, 3, 4, 6) or (bits < 8 and colour not in (0, 3)):
        raise ValueError(f"unsupported PNG: {bits} bits, colour type {colour}")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise OSError("image data is damaged") from e
    if interlaced:
        pixels = np.zeros((height, width, channels), np.uint16 if bits == 16 else np.uint8)
        for x, y, dx, dy in PASSES:
            part = pixels[y::dy, x::dx]
            if part.size:
                part[:], used = _samples(raw, part.shape[0], part.shape[1], bits, channels)
                raw = raw[used:]
    else:
        pixels, _ = _samples(raw, height, width, bits, channels)
    if colour == 3:
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if pixels.max(initial=0) >= len(colours):
            raise OSError("colour outside the palette")
        if alpha:
            opacity = np.full(len(colours), 255, np.uint8)
            opacity[: len(alpha)] = np.frombuffer(alpha, np.uint8)[: len(colours)]
            colours = np.column_stack([colours, opacity])
        return colours[pixels[:, :, 0]]
    if bits < 8:
        pixels = pixels * np.uint8(255 // (2**bits - 1))
    return pixels[:, :, 0] if channels == 1 else pixels


IMAGE_COLUMNS = ["path", "height", "width", "n_channels", "mode", "data", "error"]
BATCH_BYTES = 32 * 1024 * 1024


def image_row(path: str, image: np.ndarray) -> tuple:
    mode = mode_of(image)
    return (path, image.shape[0], image.shape[1], mode // 8 + 1, mode, image.tobytes(), None)


def bad_row(path: str, error: Exception) -> tuple:
    return (path, -1, -1, -1, -1, None, f"{type(error).__name__}: {error}")


def _mapped(df: DataFrame, columns: list[str], work: Callable[[tuple], np.ndarray]) -> DataFrame:
    """Rows to image rows. A failed row carries its error; output leaves in
    batches of bounded bytes, since a decoded image is far larger than its file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if getattr(r, "error", None) is not None:
                    rows.append(tuple(r))
                    continue
                try:
                    rows.append(image_row(r.path, np.ascontiguousarray(work(r))))
                    size += len(rows[-1][5])
                except (OSError, SyntaxError, ValueError) as e:
                    rows.append(bad_row(r.path, e))
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=IMAGE_COLUMNS)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=IMAGE_COLUMNS)

    return df.select(*columns).mapInPandas(run, IMAGE_SCHEMA)


def decode_png(found: DataFrame, then: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(path, content) to image rows; what cannot be read gets an ``error``.

    ``then`` is applied in the same pass, so decoded pixels never travel.
    """
    step = then or (lambda image: image)
    return _mapped(found, ["path", "content"], lambda r: step(read_png(r.content)))


def decode_8bit(spark: SparkSession, root: str | list[str], glob: str = "*") -> DataFrame:
    """P16 with Spark's own decoder (PNG, JPEG, 8 bits) over a folder or a list of files; bad files keep height -1.

    The source gives BGR; channels are put in RGB order by :func:`prepare`.
    """
    reader = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", glob)
    df = reader.load(root) if isinstance(root, list) else reader.option("recursiveFileLookup", "true").load(root)
    bad = F.col("image.height") < 0
    return df.select(
        # named as ``binaryFile`` names it: one slash after the scheme, no percent signs
        F.regexp_replace(F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/").alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.when(bad, F.lit(-1)).otherwise(F.col("image.mode")).alias("mode"),
        F.when(~bad, F.col("image.data")).alias("data"),
        F.when(bad, F.lit("cannot decode image file")).alias("error"),
    )


def quarantined(images: DataFrame) -> DataFrame:
    """The bad rows, (path, error)."""
    return images.filter(F.col("error").isNotNull()).select("path", "error")


def apply_to_images(images: DataFrame, function: Callable[[np.ndarray], np.ndarray], bgr: bool = False) -> DataFrame:
    """Apply an array function to every good image row; failures are quarantined."""

    def work(r: tuple) -> np.ndarray:
        array = to_array(r.height, r.width, r.mode, r.data)
        return function(array[:, :, [2, 1, 0]] if bgr and array.ndim == 3 else array)

    return _mapped(images, IMAGE_COLUMNS, work)


def prepare(images: DataFrame, preset: str, size: int = 512, channel_order: str = "as_bgr", bgr: bool = False) -> DataFrame:
    """One pass over the image rows with the steps of a preset."""
    steps = PRESETS[preset]
    return apply_to_images(images, lambda a: prepared(a, steps, size, channel_order), bgr)


def to_model_input(images: DataFrame, size: int = 224) -> DataFrame:
    """I8 over image rows; data holds float32, channels first, heights stacked."""
    return apply_to_images(images, lambda a: model_input(a, size).reshape(-1, size))


def without_finished_folders(found: DataFrame, finished: DataFrame) -> DataFrame:
    """Drop folders that have as many finished files as files; one folder may hold most."""
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("_folder")
    counts = [d.groupBy(folder).agg(F.count(F.lit(1)).alias("_n")) for d in (found, finished)]
    done = counts[0].join(counts[1], ["_folder", "_n"]).select("_folder")
    listed = found.select("*", folder)
    return split_heavy(listed, done, ["_folder"], "left_anti", keys=listed.select("_folder")).drop("_folder")


LIST_FILES = 20_000  # files of a list, whose paths the driver holds
LIST_BYTES = 8 << 30
FILES_PER_TASK = 128
LISTS_AT_ONCE = 8  # lists that are decoded together when a folder is prepared as one table


def planned_lists(found: DataFrame, most_files: int = LIST_FILES, most_bytes: int = LIST_BYTES) -> DataFrame:
    """(path, length) with ``list``: lists of files bounded by number and by bytes.

    A file weighs its bytes, or the share that makes ``most_files`` fill a list, so one running
    total over the listing bounds both; a list passes the bytes by less than its last file.
    """
    weight = F.greatest(F.col("length"), F.lit(-(-most_bytes // most_files)))
    summed = by_digest(found, "path", "lists", weight=weight, name="_before")
    return summed.withColumn("list", F.floor(F.col("_before") / F.lit(most_bytes)).cast("int")).drop("_before")


def literal_path(path: str) -> str:
    """A path for ``load``, which would take some characters for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def wanted_files(spark: SparkSession, root: str, preset: str, finished: DataFrame | None = None) -> DataFrame:
    """(path, length) of a preset's files that have no output yet; no content is read."""
    steps = PRESETS[preset]
    found = visible_files(spark, root, recursive=steps.recursive).select("path", "length")
    found = found.filter(has_suffix(F.col("path"), list(steps.suffixes)))
    if finished is not None and steps.skip_finished == "file":
        found = missing(found, finished.select("path"), "path")
    if finished is not None and steps.skip_finished == "folder":
        found = without_finished_folders(found, finished)
    return found


def _tasks(paths: list[str]) -> int:
    """Tasks for the files of a list: Spark may give each small file one, whose start outlasts its work."""
    return -(-len(paths) // FILES_PER_TASK)


def prepared_png(found: DataFrame, preset: str, size: int = 512) -> DataFrame:
    """I7 over (path, length, content) rows of PNG files."""
    plausible = looks_like_image("content", F.col("length"))
    broken = found.filter(~plausible).select(
        "path",
        *[F.lit(-1).alias(c) for c in ("height", "width", "n_channels", "mode")],
        F.lit(None).cast("binary").alias("data"),
        F.lit("not an image file").alias("error"),
    )
    return decode_png(found.filter(plausible), lambda a: prepared(a, PRESETS[preset], size)).unionByName(broken)


def prepared_list(spark: SparkSession, paths: list[str], preset: str, size: int = 512) -> DataFrame:
    """I7 over a list of files: PNG by content, the rest by Spark's decoder; nothing else is opened."""
    parts = []
    png = [literal_path(p) for p in paths if p.lower().endswith(".png")]
    other = [literal_path(p) for p in paths if not p.lower().endswith(".png")]
    if png:
        parts.append(prepared_png(spark.read.format("binaryFile").load(png).coalesce(_tasks(png)), preset, size))
    if other:
        parts.append(prepare(decode_8bit(spark, other).coalesce(_tasks(other)), preset, size, bgr=True))
    return reduce(DataFrame.unionByName, parts)


def _planned(spark: SparkSession, wanted: DataFrame, most_files: int, most_bytes: int) -> tuple[DataFrame, int]:
    """The lists, written in their order so that one of them is found without reading all, and their number."""
    planned = planned_lists(wanted, most_files, most_bytes).repartitionByRange("list").sortWithinPartitions("list")
    planned = stage(planned, "lists")
    last = planned.agg(F.max("list").alias("n")).first().n
    return planned, 0 if last is None else last + 1


def _paths(planned: DataFrame, number: int) -> list[str]:
    return sorted(r.path for r in planned.filter(F.col("list") == number).select("path").collect())


def prepared_lists(
    spark: SparkSession, root: str, preset: str, size: int = 512, finished: DataFrame | None = None,
    most_files: int = LIST_FILES, most_bytes: int = LIST_BYTES,
) -> Iterator[DataFrame]:
    """List without content, skip what is finished, plan bounded lists, then decode list by list.

    Write each as it comes: a run cut short goes on with what is not finished.
    """
    planned, lists = _planned(spark, wanted_files(spark, root, preset, finished), most_files, most_bytes)
    for number in range(lists):
        if paths := _paths(planned, number):
            yield prepared_list(spark, paths, preset, size)


def prepare_folder(
    spark: SparkSession, root: str, preset: str, size: int = 512, finished: DataFrame | None = None,
    most_files: int = LIST_FILES, most_bytes: int = LIST_BYTES,
) -> DataFrame:
    """All wanted files of a folder as one table.

    PNG files are opened by the tasks, so no list of them is held anywhere. Spark's decoder takes the other files by their
    paths: they go in the bounded lists of :func:`prepared_lists`, each written as it is done, ``LISTS_AT_ONCE`` at a time, so
    the driver holds the paths and plans of so many lists, whatever their number.
    ``finished`` has the paths with an output; such files are not opened, whatever their kind.
    """
    planned, lists = _planned(spark, wanted_files(spark, root, preset, finished), most_files, most_bytes)
    png = F.lower("path").endswith(".png")
    done = scratch(spark, "prepared")

    def write(number: int) -> bool:
        paths = _paths(planned.filter(~png), number)
        if paths:
            prepared_list(spark, paths, preset, size).write.parquet(f"{done}/list={number}")
        return bool(paths)

    with ThreadPoolExecutor(LISTS_AT_ONCE) as pool:
        written = any(list(pool.map(write, range(lists))))
    parts = [prepared_png(with_content(planned.filter(png), root), preset, size)]
    if written:
        parts.append(spark.read.schema(IMAGE_SCHEMA).parquet(done).select(*IMAGE_COLUMNS))
    return reduce(DataFrame.unionByName, parts)
