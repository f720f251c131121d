"""The embeddings read as small images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.operators import images as I
from reportlake.operators.joins import missing
from reportlake.session import scratch, table
from reportlake.sources.tree import opened, visible_files
from reportlake.workloads.base import register


def image_rows(spark, folder, height: int, width: int, channels: int = 1, kind: str = "float32") -> DataFrame:
    """Image rows whose pixels are the values of each embedding; zeros fill up the last row.

    float32 keeps the values, uint8 and uint16 take ``floor(|x| * 1000)``.
    """
    size = height * width * channels

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, values in zip(batch["vec_id"], batch["embedding"], strict=True):
                pixels = np.zeros(size, np.float32)
                pixels[: len(values)] = values
                if kind != "float32":
                    pixels = np.floor(np.abs(pixels.astype(np.float64)) * 1000).astype(kind)
                shape = (height, width) if channels == 1 else (height, width, channels)
                rows.append(I.image_row(str(key), pixels.reshape(shape)))
            yield pd.DataFrame(rows, columns=I.IMAGE_COLUMNS)

    return table(spark, folder, "embeddings").select("vec_id", "embedding").mapInPandas(build, I.IMAGE_SCHEMA)


def shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").cast("bigint").alias("vec_id"), "height", "width", F.hex("data").alias("pixels"))


# SQL forms over a list of pixels
MIN_MAX_SQL = """(SELECT vec_id, [CAST(floor(CASE WHEN hi = 0 THEN 0::FLOAT ELSE (d / hi) * 255::FLOAT END) AS INT) for d in s] AS p FROM
  (SELECT vec_id, s, list_max(s) AS hi FROM (SELECT vec_id, [(x - list_min(embedding))::FLOAT for x in embedding] AS s FROM embeddings)))"""


def hex_sql(p: str) -> str:
    return f"array_to_string([printf('%02X', v) for v in {p}], '')"


def equalise_sql(source: str) -> str:
    return f"""(SELECT vec_id, CASE WHEN h0 = len(p) THEN p ELSE
      [CAST(round_even(CAST((len(list_filter(p, lambda q: q <= v)) - h0)::FLOAT * (255::FLOAT / (len(p) - h0)::FLOAT) AS FLOAT)::DOUBLE, 0) AS INT) for v in p] END AS p
      FROM (SELECT vec_id, p, len(list_filter(p, lambda q: q = list_min(p))) AS h0 FROM {source}))"""


def resize_sql(source: str, side: int, target: int) -> str:
    """Two-point bilinear on a square image, one row per target pixel."""
    at = f"({{i}} + 0.5::DOUBLE) * ({side}::DOUBLE / {target}) - 0.5::DOUBLE"
    axis = f"""(SELECT i, CAST(greatest(floor(a), 0) AS INT) AS lo, CAST(least(floor(a) + 1, {side - 1}) AS INT) AS hi,
      CASE WHEN a < 0 THEN 0 ELSE a - floor(a) END AS w FROM (SELECT i, {at.format(i='i')} AS a FROM range({target}) AS r(i)))"""
    value = (
        f"((p[y.lo * {side} + x.lo + 1] * (1 - y.w) + p[y.hi * {side} + x.lo + 1] * y.w) * (1 - x.w)"
        f" + (p[y.lo * {side} + x.hi + 1] * (1 - y.w) + p[y.hi * {side} + x.hi + 1] * y.w) * x.w)"
    )
    return f"""(SELECT vec_id, list(CAST(floor({value} + 0.5::DOUBLE) AS INT) ORDER BY y.i, x.i) AS p FROM {source}, {axis} y, {axis} x GROUP BY vec_id)"""


def picture_sql(source: str, height: int, width: int) -> str:
    return f"SELECT vec_id, CAST({height} AS INT) AS height, CAST({width} AS INT) AS width, {hex_sql('p')} AS pixels FROM {source}"


@register("i01_min_max", picture_sql(MIN_MAX_SQL, 8, 8))
def i01(spark, folder):
    return shown(I.apply_to_images(image_rows(spark, folder, 8, 8), I.min_max))


WHOLE_SQL = "(SELECT vec_id, [CAST(floor(abs(x::DOUBLE) * 1000) AS INT) for x in embedding[:{n}]] AS p FROM embeddings)"


@register("i02_cast_8bit", picture_sql(f"(SELECT vec_id, [v % 256 for v in p] AS p FROM {WHOLE_SQL.format(n=64)})", 8, 8))
def i02(spark, folder):
    return shown(I.apply_to_images(image_rows(spark, folder, 8, 8, kind="uint16"), I.cast_8bit))


BYTES_SQL = WHOLE_SQL.replace("abs(x::DOUBLE) * 1000) AS INT)", "abs(x::DOUBLE) * 1000) AS INT) % 256")


def grey_sql(r: int, g: int, b: int) -> str:
    return f"""(SELECT vec_id, [CAST((p[3 * i + 1] * {r} + p[3 * i + 2] * {g} + p[3 * i + 3] * {b} + 16384) // 32768 AS INT)
      for i in range(24)] AS p FROM (SELECT vec_id, list_concat(p, [0 for i in range(8)]) AS p FROM {BYTES_SQL.format(n=64)}))"""


@register("i03_grey", picture_sql(grey_sql(*I.GREY_WEIGHTS["as_bgr"]), 4, 6))
def i03(spark, folder):
    return shown(I.apply_to_images(image_rows(spark, folder, 4, 6, 3, "uint8"), I.grey))


@register("i04_equalise", picture_sql(equalise_sql(MIN_MAX_SQL), 8, 8))
def i04(spark, folder):
    return shown(I.apply_to_images(image_rows(spark, folder, 8, 8), lambda a: I.equalise(I.min_max(a))))


@register(
    "i05_pad_square",
    picture_sql(
        f"(SELECT vec_id, list_concat(list_concat([lo for i in range(96)], p), [lo for i in range(96)]) AS p FROM (SELECT vec_id, p, list_min(p) AS lo FROM {MIN_MAX_SQL}))", 16, 16
    ),
)
def i05(spark, folder):
    wide = image_rows(spark, folder, 8, 8)
    return shown(I.apply_to_images(wide, lambda a: I.pad_square(I.min_max(a).reshape(4, 16))))


@register("i06_resize", picture_sql(resize_sql(MIN_MAX_SQL, 8, 16), 16, 16))
def i06(spark, folder):
    return shown(I.apply_to_images(image_rows(spark, folder, 8, 8), lambda a: I.resize_bilinear(I.min_max(a), 16, 16)))


@register("i07_preset", picture_sql(resize_sql(equalise_sql(MIN_MAX_SQL), 8, 12), 12, 12))
def i07(spark, folder):
    return shown(I.prepare(image_rows(spark, folder, 8, 8), "padchest", 12))


KERNELS = {
    "triangle": (1, "greatest(1 - abs({x}), 0)"),
    "lanczos": (3, "CASE WHEN abs({x}) >= 3 THEN 0 WHEN {x} = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) * sin(pi() * {x} / 3) / (pi() * {x} / 3) END"),
}


def smooth_sql(source: str, side: int, target: int, kind: str) -> str:
    """Resize of a square image by a kernel, columns first; the image grows, so the kernel keeps its width."""
    reach, kernel = KERNELS[kind]
    centre = f"((i + 0.5::DOUBLE) * ({side}::DOUBLE / {target}))"
    raw = f"""(SELECT i, q, {kernel.format(x=f"(q + 0.5::DOUBLE - {centre})")} AS w FROM range({target}) AS a(i), range({side}) AS b(q)
      WHERE q >= floor({centre} - {reach} + 0.5::DOUBLE) AND q < floor({centre} + {reach} + 0.5::DOUBLE))"""
    weights = f"(SELECT i, q, w / sum(w) OVER (PARTITION BY i) AS w FROM {raw})"
    whole = "least(255, greatest(0, floor(sum({}) + 0.5::DOUBLE)))"
    across = f"(SELECT vec_id, y, i AS x, {whole.format(f'w * p[y * {side} + q + 1]')} AS v FROM {source}, range({side}) AS r(y), {weights} GROUP BY vec_id, y, i)"
    down = f"(SELECT vec_id, i AS y, x, {whole.format('w * v')} AS v FROM {across} JOIN {weights} ON q = y GROUP BY vec_id, i, x)"
    return f"(SELECT vec_id, list(CAST(v AS INT) ORDER BY y, x) AS p FROM {down} GROUP BY vec_id)"


SQUARE_SQL = f"""(SELECT vec_id, list_concat(list_concat([lo for i in range(6)], p), [lo for i in range(6)]) AS p FROM
  (SELECT vec_id, p, list_min(p) AS lo FROM {equalise_sql(grey_sql(*I.GREY_WEIGHTS["as_bgr"]))}))"""


@register("i07_smooth_preset", picture_sql(smooth_sql(SQUARE_SQL, 6, 16, "lanczos"), 16, 16))
def i07_smooth(spark, folder):
    return shown(I.prepare(image_rows(spark, folder, 4, 6, 3, "uint8"), "covidx", 16))


CROP_SQL = f"(SELECT vec_id, [p[32 * (8 + i // 16) + 8 + i % 16 + 1] for i in range(256)] AS p FROM {smooth_sql(MIN_MAX_SQL, 8, 32, 'triangle')})"


@register("i08_model_input", picture_sql(CROP_SQL, 16, 16))
def i08(spark, folder):
    """The values in [0, 1] are shown as the levels they stand for."""
    df = I.to_model_input(I.apply_to_images(image_rows(spark, folder, 8, 8), I.min_max), 16)
    return shown(I.apply_to_images(df, lambda a: np.rint(a * np.float32(255)).astype(np.uint8)))


@register("i09_skip_finished", "SELECT 'raw/' || vec_id || '.png' AS path FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def i09(spark, folder):
    found = table(spark, folder, "embeddings").selectExpr("concat('raw/', CAST(vec_id AS STRING), '.png') AS path")
    done = table(spark, folder, "labels").selectExpr("concat('out/', CAST(doc_id AS STRING), '.png') AS path")
    finished = done.select(F.replace("path", F.lit("out/"), F.lit("raw/")).alias("path"))
    return missing(found, finished, "path")


def filtered_lines(pixels: np.ndarray, first: int) -> bytes:
    """Scan lines of a 16-bit grey image, each under the next of the five PNG filters."""
    now = pixels.astype(">u2").view(np.uint8).reshape(len(pixels), -1).astype(int)
    up = np.vstack([np.zeros_like(now[:1]), now[:-1]])
    left, corner = (np.hstack([np.zeros((len(x), 2), int), x[:, :-2]]) for x in (now, up))
    near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
    paeth = np.choose(near.argmin(axis=0), [left, up, corner])  # of equal distances the first counts
    guesses = [np.zeros_like(now), left, up, (left + up) // 2, paeth]
    kinds = [(first + y) % 5 for y in range(len(now))]
    return b"".join(bytes([k]) + ((now[y] - guesses[k][y]) % 256).astype(np.uint8).tobytes() for y, k in enumerate(kinds))


def png_files(spark, folder) -> DataFrame:
    """(path, content): a 16-bit PNG per embedding with all filters, every fifth one damaged in one of four ways."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, values in zip(batch["vec_id"], batch["embedding"], strict=True):
                pixels = np.floor(np.abs(np.asarray(values, np.float32).astype(np.float64)) * 1000).astype(np.uint16).reshape(8, 8)
                lines = filtered_lines(pixels, key)
                head = struct.pack(">IIBBBBB", 8, 8, 16, 0, 0, 0, 0)
                content = I.PNG_START + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
                if key % 5 == 0:
                    content = [content[:40], content[:60], b"GIF" + content, content[:8]][key // 5 % 4]
                rows.append((str(key), content))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return table(spark, folder, "embeddings").select("vec_id", "embedding").mapInPandas(build, "path string, content binary")


@register(
    "p16_decoded",
    f"""SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE 8 END AS INT) AS height, CASE WHEN vec_id % 5 <> 0 THEN
        array_to_string([printf('%02X%02X', v % 256, v // 256) for v in p], '') END AS pixels,
        CASE WHEN vec_id % 5 = 0 THEN CASE WHEN (vec_id // 5) % 4 = 2 THEN 'ValueError' ELSE 'OSError' END END AS error FROM {WHOLE_SQL.format(n=64)}""",
)
def p16(spark, folder):
    df = I.decode_png(png_files(spark, folder))
    return df.select(
        F.col("path").cast("bigint").alias("vec_id"), "height", F.hex("data").alias("pixels"), F.substring_index("error", ":", 1).alias("error")
    )


@register("p16_quarantine", "SELECT CAST(vec_id AS VARCHAR) AS path FROM embeddings WHERE vec_id % 5 = 0")
def p16_bad(spark, folder):
    return I.quarantined(I.decode_png(png_files(spark, folder))).select("path")


SIDES = [(8, 8), (12, 9), (5, 16)]


def jpeg_files(spark) -> list[bytes]:
    """One JPEG of each shape, made by the JVM's own encoder."""
    jvm, out = spark._jvm, []
    for height, width in SIDES:
        image = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
        for y in range(height):
            for x in range(width):
                image.getRaster().setSample(x, y, 0, (37 * x + 11 * y) % 256)
        stream = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpg", stream)
        out.append(bytes(stream.toByteArray()))
    return out


def image_folder(spark, folder) -> str:
    """A folder of PNG and JPEG files, one for each embedding; the tasks write them.

    Every fifth PNG is damaged (as in ``png_files``), every seventh JPEG is cut short. Names hold blanks and signs.
    """
    root, jpegs = scratch(spark, "images"), jpeg_files(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = opened(root)
        where.create_dir(base)
        for batch in batches:
            for key, content in zip(batch["path"].astype(int), batch["content"], strict=True):
                name = f"{key} 50%.png"
                if key % 3:
                    name, content = f"{key}+[a].{'JPG' if key % 2 else 'jpeg'}", jpegs[key % len(jpegs)]
                    content = content[: len(content) // 4] if key % 7 == 0 else content
                with where.open_output_stream(f"{base}/{name}") as out:  # the same bytes whenever a task is repeated
                    out.write(content)
            yield batch[["path"]]

    png_files(spark, folder).mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return root


def prepared_images(spark, folder) -> DataFrame:
    """I7, I9 over files: every fourth image is finished, the rest is decoded in lists of at most 150 files."""
    root = image_folder(spark, folder)
    listing = visible_files(spark, root)
    key = F.regexp_extract("path", r"/([0-9]+)[^/]*$", 1).cast("bigint")
    finished = listing.filter(key % 4 == 0)
    done = I.prepare_folder(spark, root, "covidx", 16, finished, most_files=150)
    return done.select(key.alias("vec_id"), "height", "width", "mode", F.length("data").alias("bytes"), F.col("error").alias("error"))


@register(
    "i07_prepared_folder",
    """WITH f AS (SELECT vec_id, vec_id % 3 = 0 AS png, CASE WHEN vec_id % 3 = 0 THEN vec_id % 5 = 0 ELSE vec_id % 7 = 0 END AS bad FROM embeddings WHERE vec_id % 4 <> 0)
       SELECT vec_id, CAST(CASE WHEN bad THEN -1 ELSE 16 END AS INT) AS height, CAST(CASE WHEN bad THEN -1 ELSE 16 END AS INT) AS width,
         CAST(CASE WHEN bad THEN -1 ELSE 0 END AS INT) AS mode, CAST(CASE WHEN NOT bad THEN 256 END AS INT) AS bytes,
         CASE WHEN bad THEN CASE WHEN png THEN 'not an image file' ELSE 'cannot decode image file' END END AS error FROM f""",
)
def i07_folder(spark, folder):
    return prepared_images(spark, folder)
