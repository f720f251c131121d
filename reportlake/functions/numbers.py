"""M1, M2, P20: rounding and image target sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patch size and pixel limits of the target-size rule.
FACTOR = 28
MIN_PIXELS = 4 * 28 * 28
MAX_PIXELS = 16384 * 28 * 28
MAX_RATIO = 200


def round_to(value: Column, factor: int) -> Column:
    """Nearest multiple, halves to even (``rint``, as ``bround`` goes through decimals)."""
    return (F.rint(value / F.lit(float(factor))) * factor).cast("bigint")


def ceil_to(value: Column, factor: int) -> Column:
    return F.ceil(value / F.lit(float(factor))) * factor


def floor_to(value: Column, factor: int) -> Column:
    return F.floor(value / F.lit(float(factor))) * factor


def round_numeric(df: DataFrame, places: int = 3) -> DataFrame:
    """P20: round every float and double column, halves to even."""
    wanted = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.bround(F.col(c), places) for c in wanted})


def target_size(
    height: Column,
    width: Column,
    factor: int = FACTOR,
    min_pixels: int = MIN_PIXELS,
    max_pixels: int = MAX_PIXELS,
    strict: bool = False,
) -> Column:
    """M2: struct(height, width, valid); sides become multiples of ``factor``.

    A side ratio above 200 gives ``valid = false`` with null sides, or raises
    when ``strict``.
    """
    h, w = height.cast("double"), width.cast("double")
    base_h = F.greatest(F.lit(factor).cast("bigint"), round_to(h, factor))
    base_w = F.greatest(F.lit(factor).cast("bigint"), round_to(w, factor))
    shrink = F.sqrt(h * w / F.lit(float(max_pixels)))
    grow = F.sqrt(F.lit(float(min_pixels)) / (h * w))

    def side(raw: Column, base: Column) -> Column:
        return (
            F.when(base_h * base_w > max_pixels, floor_to(raw / shrink, factor))
            .when(base_h * base_w < min_pixels, ceil_to(raw * grow, factor))
            .otherwise(base)
        )

    valid = F.greatest(h, w) / F.least(h, w) <= MAX_RATIO
    bad = F.raise_error(F.lit("side ratio above 200")).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.struct(
        F.when(valid, side(h, base_h)).otherwise(bad).alias("height"),
        F.when(valid, side(w, base_w)).otherwise(bad).alias("width"),
        valid.alias("valid"),
    )
