"""Joins, reconciliation and the join that splits heavy keys.

No join here carries a broadcast hint for a table whose size is not proven:
the optimiser broadcasts what it measures as small and sorts the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.plans.ordinals import by_key
from reportlake.session import stage

HEAVY_SHARE = 1000  # a part of a heavy key holds at most one row in so many
LEAST_PART = 16  # rows below which a part is not cut further


def split_heavy(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    keys: DataFrame | None = None,
    row: list[str] | None = None,
) -> DataFrame:
    """Join where single keys may hold a large share of the left rows.

    A key is heavy when it holds more than one row in ``HEAVY_SHARE``, so there
    are fewer than ``HEAVY_SHARE`` of them and that list is safe to broadcast.
    Heavy left rows are spread over parts in proportion to the key's share and
    only the matching right rows are repeated. Exact for inner, left, left_semi
    and left_anti. ``row`` names columns that tell the left rows of a key apart;
    without it, all columns that can be hashed do.

    ``keys`` may name a cheaper table with much the same keys to count, such as
    the scan below a derived ``left``; it only decides what is spread.
    """
    counted = (left if keys is None else keys).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    # over the counts, so that their shuffle serves both
    total = counted.select(F.sum("_n").alias("n")).scalar()
    parts = F.ceil(F.least(F.col("_n") * HEAVY_SHARE / total, F.col("_n") / LEAST_PART)).cast("int")
    heavy = counted.filter(F.col("_n") * HEAVY_SHARE > total).select(*on, parts.alias("_parts")).filter("_parts > 1")
    row = row or [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*row), F.col("_parts")).cast("int")
    left = left.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.coalesce(spread, F.lit(0)))
    last = F.coalesce(F.col("_parts") - 1, F.lit(0))
    right = right.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return left.drop("_parts").join(right.drop("_parts"), [*on, "_salt"], how).drop("_salt")


def join_metadata(split: DataFrame, metadata: DataFrame, on: str, repeated: list[str]) -> DataFrame:
    """Inner join, without the keys that both tables carry."""
    return split.join(metadata.drop(*repeated), on, "inner")


def join_labels(images: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Study labels onto image rows; one study may own most images."""
    return split_heavy(images, labels, [on], "left")


def join_suffixed(left: DataFrame, right: DataFrame, on: str, suffix: str = "_cx") -> DataFrame:
    """Left join; columns of the right table get the suffix where names collide."""
    clash = {c: c + suffix for c in right.columns if c != on and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), on, "left")


def keep_listed(df: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    """Semi join. The list is reduced first, so a key that fills it meets the rows once."""
    on = [on] if isinstance(on, str) else on
    return df.join(listed.select(*on).distinct(), on, "left_semi")


def missing(df: DataFrame, listing: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows without a partner in the listing; one key may stand in most rows of either."""
    on = [on] if isinstance(on, str) else on
    return split_heavy(df, listing.select(*on).distinct(), on, "left_anti", keys=df.select(*on))


def keep_existing_items(
    df: DataFrame, key: str, items: str, listing: DataFrame, path: str = "path", absent: DataFrame | None = None
) -> DataFrame:
    """Drop list items that are not listed (or are known to be absent).

    Order inside the list is kept; rows left without an item keep an empty list.
    One path may stand in most rows, so the join splits heavy paths. The narrow
    (key, place, path) rows are written once, as they are both counted and joined.
    """
    present = listing.select(path).distinct()
    if absent is not None:
        present = present.join(absent.select(path).distinct(), path, "left_anti")
    exploded = stage(df.select(key, F.posexplode(items).alias("_pos", path)), "items")
    exploded = split_heavy(exploded, present, [path], "left_semi", row=[key, "_pos"])
    kept = exploded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", path))).alias("_kept"))
    return (
        df.drop(items)
        .join(kept, key, "left")
        .withColumn(items, F.coalesce(F.transform("_kept", lambda s: s[path]), F.array().cast("array<string>")))
        .drop("_kept")
    )


def labels_by_text(labels: DataFrame, reports: DataFrame, label_text: str, report_text: str, key: str) -> DataFrame:
    """Give labels the report ids by equal full text, without duplicate rows.

    Texts are compared by SHA-256, so 32 bytes travel instead of the report.
    Both sides are reduced to distinct rows first: copies of a text meet one
    label row and not each other. Reports of one heavy text are split.
    """
    digest = lambda text: F.sha2(F.col(text), 256)
    left = reports.select(key, digest(report_text).alias("_text")).dropDuplicates()
    right = labels.withColumn("_text", digest(label_text)).drop(label_text).dropDuplicates()
    return split_heavy(left, right, ["_text"], "inner").drop("_text")


def aligned(truth: DataFrame, table: DataFrame, on: str, strict: bool = True, place: str | None = None) -> DataFrame:
    """The table's rows for the ids of the truth; a missing id is an error.

    ``place`` names a column of the truth that says where its row stands; it goes
    with the rows, so that all tables of one truth can be brought in its order.
    """
    found = table.withColumn("_found", F.lit(True))
    joined = truth.select(on, *([place] if place else [])).join(found, on, "left")
    if not strict:
        return joined.drop("_found")
    message = F.concat(F.lit("no row for id "), F.col(on).cast("string"))
    kept = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.filter(kept).drop("_found")


def join_chain(records: DataFrame, tables: list[DataFrame], on: str) -> DataFrame:
    """Left joins in a row."""
    for t in tables:
        records = records.join(t, on, "left")
    return records


def side_by_side(first: DataFrame, second: DataFrame, on: str, names: tuple[str, str], shared: list[str]) -> DataFrame:
    """Two score tables next to each other; ``shared`` columns of the second go."""
    a = first.withColumnsRenamed({c: f"{c}_{names[0]}" for c in first.columns if c != on})
    b = second.drop(*shared).withColumnsRenamed({c: f"{c}_{names[1]}" for c in second.columns if c != on})
    return a.join(b, on, "inner")


def zip_in_order(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pair rows by their place in key order; the longer side loses its end."""
    a = by_key(left, left_key, name="_place")
    b = by_key(right, right_key, name="_place")
    return a.join(b, "_place", "inner").drop("_place")


def overridden(df: DataFrame, overrides: DataFrame, on: str, column: str, replacement: str) -> DataFrame:
    """Replace a column for the keys listed in a table."""
    listed = overrides.select(on, F.col(replacement).alias("_new"))
    return (
        df.join(listed, on, "left")
        .withColumn(column, F.coalesce("_new", column))
        .drop("_new")
    )


def first_existing(df: DataFrame, listing: DataFrame, candidates: list[Column], path: str = "path", out: str = "found") -> DataFrame:
    """The first candidate path that is listed, else null."""
    listed, base = listing.select(path).distinct(), df
    for i, c in enumerate(candidates):
        partner = listed.select(F.col(path).alias(f"_c{i}"), F.lit(True).alias(f"_f{i}"))
        wanted = base.select(c.alias(f"_c{i}"))
        df = split_heavy(df.withColumn(f"_c{i}", c), partner, [f"_c{i}"], "left", keys=wanted)
    hits = [F.when(F.col(f"_f{i}"), F.col(f"_c{i}")) for i in range(len(candidates))]
    extra = [f"_{x}{i}" for x in "cf" for i in range(len(candidates))]
    return df.withColumn(out, F.coalesce(*hits)).drop(*extra)
