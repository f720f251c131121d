"""Exact global ordinals without a one-task window.

Rows are cut into buckets whose order agrees with the wanted order. One narrow
aggregate counts the buckets; their running totals (at most ``MOST_BUCKETS``
rows, so a broadcast is safe at any data size) are added to a row number taken
inside each bucket. Buckets depend on values only, never on partitioning, so a
recomputed task always gets the same ordinals.

* digest order: the bucket is a prefix of the md5, uniform by construction;
* key order: the bucket comes from quantiles of a sample of the keys, chosen by
  their digest and of a bounded size. They are fetched once and used as literals, so
  every branch of the plan agrees on them; their accuracy matters for balance only;
* value order: a value that hits a quantile is heavy and gets buckets of its own,
  cut further by the key, as many as quantiles it hit, so one value may hold any
  share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.text import digest

DIGEST_CHARS = 4
MOST_BUCKETS = 16**DIGEST_CHARS
PER_BUCKET = 32  # sampled rows for each bucket


def bucket_count(df: DataFrame) -> int:
    """Buckets for a key order: enough for every core, few enough to list."""
    return min(4096, max(256, df.sparkSession.sparkContext.defaultParallelism))


def quantiles(df: DataFrame, columns: list[str], parts: int, key: str) -> list[list]:
    """Approximate quantiles per column, repeats kept: ``parts - 1`` numbers each.

    They come from about ``PER_BUCKET * parts`` rows, whatever the size of the data: rows are
    counted, and those whose key has a small hash are taken. No task merges what all others found.
    """
    share = min(1.0, PER_BUCKET * parts / max(1, df.count()))
    chosen = F.pmod(F.xxhash64(key), F.lit(2**31)) < int(share * 2**31)
    rows = df.filter(chosen).select(*columns).collect()
    found = []
    for c in columns:
        values = sorted(r[c] for r in rows if r[c] is not None)
        found.append([values[len(values) * i // parts] for i in range(1, parts)] if values else [])
    return found


def below(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below the value: two short scans, not a long one."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    jump = F.size(F.filter(coarse, lambda b: b < value)) * step
    return jump + F.size(F.filter(F.slice(every, jump + 1, step), lambda b: b < value))


def running_total(
    df: DataFrame,
    bucket: Column,
    order: list[Column],
    weight: Column | None = None,
    group: list[str] | None = None,
    name: str = "ordinal",
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows (a 0-based ordinal by default)."""
    group = group or []
    df = df.withColumn("_bucket", bucket)
    if weight is not None:
        df = df.withColumn("_weight", weight.cast("bigint"))
    amount = F.count(F.lit(1)) if weight is None else F.sum("_weight")
    counted = df.groupBy(*group, "_bucket").agg(amount.alias("_amount"))
    # bounded by the number of buckets, whatever the size of the data
    along = Window.partitionBy(*group).orderBy("_bucket")
    offsets = counted.select(
        *group,
        "_bucket",
        (F.sum("_amount").over(along) - F.col("_amount")).alias("_offset"),
        *([F.sum("_amount").over(Window.partitionBy(*group)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    if weight is None:
        within = F.row_number().over(inside) - 1
    else:
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    # every bucket has an offset; a left join spares the not-null filter of an inner
    # one, which would work out the bucket a second time
    # groups come from the data and may be many, so then the optimiser decides by size
    return (
        df.withColumn("_within", within)
        .join(offsets if group else F.broadcast(offsets), [*group, "_bucket"], "left")
        .withColumn(name, (F.col("_offset") + F.col("_within")).cast("bigint"))
        .drop("_bucket", "_offset", "_within", "_weight")
    )


def by_digest(
    df: DataFrame, key: str, seed: int | str, group: list[str] | None = None, **options
) -> DataFrame:
    """Ordinal in the seeded random order. Keys are unique; rows that repeat one may trade places."""
    df = df.withColumn("_digest", digest(seed, key))
    bucket = F.conv(F.substring("_digest", 1, DIGEST_CHARS), 16, 10).cast("int")
    return running_total(df, bucket, [F.col("_digest"), F.col(key)], group=group, **options).drop("_digest")


def by_key(df: DataFrame, key: str, parts: int | None = None, **options) -> DataFrame:
    """Ordinal in the order of a unique numeric key."""
    (cuts,) = quantiles(df, [key], parts or bucket_count(df), key)
    return running_total(df, below(F.col(key), sorted(set(cuts))), [F.col(key)], **options)


def by_value(
    df: DataFrame, value: str, key: str, descending: bool = False, parts: int | None = None, **options
) -> DataFrame:
    """Ordinal in the order of a numeric value; ties in the order of the unique key."""
    parts = parts or bucket_count(df)
    df = df.withColumn("_value", -F.col(value) if descending else F.col(value))
    cuts, key_cuts = quantiles(df, ["_value", key], parts, key)
    bounds, key_bounds = sorted(set(cuts)), sorted(set(key_cuts))
    if not bounds:
        return running_total(df, F.lit(0), [F.col("_value"), F.col(key)], **options).drop("_value")
    place = below(F.col("_value"), bounds)
    heavy = F.coalesce(F.get(F.array(*[F.lit(b) for b in bounds]), place) == F.col("_value"), F.lit(False))
    weight = F.get(F.array(*[F.lit(cuts.count(b)) for b in bounds]), place)
    # the key's bucket, scaled down to as many parts as the value weighs
    sub = F.floor(below(F.col(key), key_bounds) * weight / F.lit(len(key_bounds) + 1))
    df = df.withColumn("_place", place).withColumn("_heavy", heavy)
    bucket = (2 * F.col("_place") + F.col("_heavy").cast("int")).cast("bigint") * parts
    bucket += F.when(F.col("_heavy"), sub).otherwise(F.lit(0))
    ordered = running_total(df, bucket, [F.col("_value"), F.col(key)], **options)
    return ordered.drop("_value", "_place", "_heavy")


def in_row_order(df: DataFrame, key: str, total: str = "n_rows", name: str = "ordinal") -> DataFrame:
    """Ordinal in key order together with the number of rows."""
    return by_key(df, key, name=name, total=total)


def chunk_of(ordinal: Column, size: int) -> Column:
    """Fixed-size chunks in row order."""
    return F.floor(ordinal / F.lit(size))


def part_of(ordinal: Column, total: Column, parts: int) -> Column:
    """``parts`` slices with boundaries ``i * n // parts``."""
    return F.floor(((ordinal + 1) * parts - 1) / total)


def worker_chunk(ordinal: Column, total: Column, workers: int) -> Column:
    """Chunks of ``n // workers`` rows, at least one row each."""
    size = F.greatest(F.lit(1).cast("bigint"), F.floor(total / F.lit(workers)))
    return F.floor(ordinal / size)


def row_range(df: DataFrame, start: int, size: int = 505, ordinal: str = "ordinal") -> DataFrame:
    """One work unit, rows ``start`` to ``start + size - 1``."""
    return df.filter(F.col(ordinal).between(start, start + size - 1))
