"""Counts, published tables and simple reductions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import count_with_percent, total_length


def totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """A1: rows and exact distinct counts, taken over the distinct key rows."""
    reduced = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return reduced.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"),
        *[F.count_distinct(F.col(k)).alias(f"n_{k}") for k in keys],
    )


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Counts per group, groups with a null key left out."""
    return df.dropna("any", subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _by_entity(
    df: DataFrame, split: str, study: str, subject: str, flags: DataFrame, flag: str, *counts: Column
) -> DataFrame:
    """One row per (split, study, subject), with the study's flag.

    Rows are reduced before they meet the flags, so a study that owns most of
    them joins as a single row.
    """
    entities = df.groupBy(split, study, subject).agg(*(counts or [F.count(F.lit(1)).alias("_n")]))
    flagged = flags.select(study, F.col(flag).cast("boolean").alias("_hit"))
    return entities.join(flagged, study, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _distinct(keys: list[str]) -> list[Column]:
    return [
        c
        for k in keys
        for c in (
            F.count_distinct(F.col(k)).alias(f"n_{k}"),
            F.count_distinct(F.when(F.col("_hit"), F.col(k))).alias(f"n_{k}_with_finding"),
        )
    ]


def distinct_by_split(
    df: DataFrame, split: str, study: str, subject: str, flags: DataFrame, flag: str = "flag"
) -> DataFrame:
    """A3: distinct studies and subjects per split, overall and with a flagged study.

    One pass over the input; distinct values are spread by value, so a split
    with most of the rows fills no one task. ``flags`` has one row per study.
    """
    return _by_entity(df, split, study, subject, flags, flag).groupBy(split).agg(*_distinct([study, subject]))


def cohort_table(
    df: DataFrame, split: str, view: str, study: str, subject: str, flags: DataFrame, splits: list[str],
    views: list[str], flag: str = "flag",
) -> DataFrame:
    """A4: measures as rows, splits as columns, cells ``N`` or ``N (p%)``.

    One pass over the input; everything after works on one row per split.
    """
    seen = F.col(view).isin(*views)
    counted = [F.count_if(seen).alias("images")]
    counted += [F.count_if(F.col(view) == v).alias(f"view_{i}") for i, v in enumerate(views)]
    names = ["images", *[f"view_{i}" for i in range(len(views))]]
    entities = _by_entity(df.filter(F.col(split).isin(*splits)), split, study, subject, flags, flag, *counted)
    row = entities.groupBy(split).agg(*[F.sum(n).alias(n) for n in names], *_distinct([study, subject]))
    share = lambda n, of: count_with_percent(F.col(n), F.col(of))
    plain = lambda n: F.col(n).cast("string")
    measures = [("Number of images", plain("images"))]
    measures += [(v, share(f"view_{i}", "images")) for i, v in enumerate(views)]
    measures += [
        ("Number of studies", plain(f"n_{study}")),
        ("  with a finding (studies)", share(f"n_{study}_with_finding", f"n_{study}")),
        ("Number of patients", plain(f"n_{subject}")),
        ("  with a finding (patients)", share(f"n_{subject}_with_finding", f"n_{subject}")),
    ]
    cells = F.array(
        *[F.struct(F.lit(i).alias("line"), F.lit(m).alias("measure"), c.alias("cell")) for i, (m, c) in enumerate(measures)]
    )
    long = row.select(split, F.inline(cells))
    return long.groupBy("line", "measure").pivot(split, splits).agg(F.first("cell"))


def label_frequency(df: DataFrame, findings: list[str], names: list[str]) -> DataFrame:
    """A5: for each finding, ``N (p%)`` of every label name; none leaves null."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(f"`{f}`") == n).alias(f"c{i}_{j}") for i, f in enumerate(findings) for j, n in enumerate(names)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("finding"),
                *[F.col(f"c{i}_{j}").alias(n) for j, n in enumerate(names)],
            )
            for i, f in enumerate(findings)
        ]
    )
    long = counts.select("_n", F.inline(rows))
    shown = [
        F.when(F.col(n) > 0, count_with_percent(F.col(n), F.col("_n"), thousands=True)).alias(n) for n in names
    ]
    return long.select("finding", *shown)


def coverage(sections: DataFrame, study: str, steps: list[str], total: Column) -> DataFrame:
    """How many reports have the first section, of the rest the second, and so on."""
    have = [F.nullif(F.col(s), F.lit("")).isNotNull() for s in steps]
    left, counts = F.col(study).isNotNull(), []
    for s, h in zip(steps, have, strict=True):
        counts.append(F.count_if(left & h).alias(s))
        left = left & ~h
    row = sections.agg(*counts)
    lines = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("n")) for s in steps])
    long = row.select(F.inline(lines)).withColumn("_total", total)
    return long.select("section", "n", count_with_percent(F.col("n"), F.col("_total"), True).alias("shown"))


def json_keys(df: DataFrame, text: str) -> DataFrame:
    """Distinct top-level keys as numbers."""
    keys = df.select(F.explode(F.json_object_keys(text)).alias("key")).distinct()
    return keys.select(F.col("key").cast("bigint").alias("key"))


def longest(df: DataFrame, text: str, n_images: Column, tokens_per_image: int, count_tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """The largest total length (T15), one number; null of no rows."""
    length = total_length(F.col(text), n_images, tokens_per_image, count_tokens)
    return df.agg(F.max(length).cast("bigint").alias("longest"))


def mean_loss(df: DataFrame, loss: str, rows: str | None = None) -> DataFrame:
    """Mean loss and perplexity, equal per batch or weighted by rows.

    ``exp`` gives infinity where the mean is too large, as wanted. Weighted by
    rows, an empty input has infinite loss.
    """
    if rows is None:
        mean = F.avg(loss)
    else:
        mean = F.coalesce(F.try_divide(F.sum(F.col(loss) * F.col(rows)), F.sum(rows)), F.lit(float("inf")))
    return df.agg(mean.alias("loss")).withColumn("perplexity", F.exp("loss"))


def rows_per_split(df: DataFrame, split: str) -> DataFrame:
    """Rows per split, and in all (null split)."""
    counted = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    return counted.rollup(split).agg(F.sum("n").alias("n"), F.grouping(split).cast("int").alias("is_total"))


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """U2."""
    return df.select(key).distinct()


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """O1, O2: global sort, range-partitioned."""
    return df.orderBy(*keys)
