"""Registered queries: each a Spark job over the given tables, most with SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportlake.plans import folds
from reportlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``{name}`` in the SQL stands for a derived table."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if sql is not None:
            text = sql
            for derived in DERIVED:
                text = text.replace("{" + derived + "}", derived_sql(derived))
            ORACLES[name] = text
        return query

    return add


# Inputs derived from the given tables, in expressions that both engines read
# alike: derived name -> (table, expressions, filter).
FS = [f"f{i:02d}" for i in range(14)]


def _label(key: str, a: int, b: str, name: str) -> str:
    return (
        f"CAST(CASE ({key} * {a} + {b}) % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE NULL END AS INT) AS {name}"
    )


_A = "substr(text, 1, CAST(floor(length(text) / 3) AS INT))"
_B = "substr(text, 1 + CAST(floor(length(text) / 3) AS INT), CAST(floor(length(text) / 3) AS INT))"
_C = "substr(text, 1 + 2 * CAST(floor(length(text) / 3) AS INT))"
_N = "chr(10)"
REPORT = f"""CASE doc_id % 9
 WHEN 0 THEN concat({_A}, {_N}, ' FINDINGS: ', {_B}, {_N}, ' IMPRESSION: ', {_C})
 WHEN 1 THEN concat({_A}, {_N}, ' FINDINGS:  ', {_N}, ' COMPARISON: ', {_B}, {_N}, ' ', {_N}, {_C})
 WHEN 2 THEN concat({_A}, {_N}, ' CHEST, PA AND LATERAL: ', {_B}, {_N}, ' ', {_N}, {_C})
 WHEN 3 THEN concat({_A}, {_N}, ' INDICATION: ', {_B}, {_N}, ' ', {_N}, ' ', {_C}, ' ')
 WHEN 4 THEN text
 WHEN 5 THEN concat({_A}, {_N}, ' IMPRESSON: ', {_B}, {_N}, ' FINDINGS:', {_N}, ' IMPRESSION: ', {_N}, {_C})
 WHEN 6 THEN concat({_A}, {_N}, ' COMPARISON: ', {_B}, {_C})
 WHEN 7 THEN concat({_A}, {_N}, ' FINDINGS AND CONCLUSIONS: ', {_B}, {_N}, ' RECOMMENDATION(S): ', {_C})
 ELSE concat({_A}, {_N}, ' EXAM: ', {_B}, {_N}, ' FRONTAL UPRIGHT VIEW (PORTABLE): ', {_C}) END AS text"""

DERIVED: dict[str, tuple[str, list[str], str | None]] = {
    "reports": ("documents", ["doc_id", REPORT], None),
    "images": (
        "orders",
        [
            "o_orderkey AS dicom_id",
            "o_custkey AS study_id",
            "o_custkey % 700 AS subject_id",
            "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validate' ELSE 'test' END AS split",
        ],
        None,
    ),
    "metadata": (
        "orders",
        [
            "o_orderkey AS dicom_id",
            "o_custkey AS study_id",
            "o_custkey % 700 AS subject_id",
            "CASE o_orderkey % 7 WHEN 0 THEN 'AP' WHEN 1 THEN 'PA' WHEN 2 THEN 'LATERAL' WHEN 3 THEN 'LPO'"
            " WHEN 4 THEN 'SWIMMERS' WHEN 5 THEN 'UNKNOWN' ELSE NULL END AS ViewPosition",
            "CASE o_custkey % 6 WHEN 0 THEN 'CHEST, LATERAL' WHEN 1 THEN 'CHEST PA' WHEN 2 THEN 'SHOULDER'"
            " WHEN 3 THEN 'NOT LISTED' ELSE NULL END AS Description",
        ],
        None,
    ),
    "first_labels": (
        "customer",
        ["c_custkey AS study_id", *[_label("c_custkey", i + 2, str(i), f) for i, f in enumerate(FS)]],
        None,
    ),
    "second_labels": (
        "customer",
        [
            "c_custkey AS study_id",
            *[_label("c_custkey", i + 2, f"{i} + (CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END)", f) for i, f in enumerate(FS)],
        ],
        "c_custkey % 7 <> 0",
    ),
    "truth": (
        "labels",
        [
            "doc_id",
            *[_label("doc_id", i + 1, f"{i} + 2 * quality + toxic", f) for i, f in enumerate(FS[:13])],
            "CAST(NULL AS INT) AS f13",
        ],
        None,
    ),
    "first_labeler": (
        "labels",
        [
            "doc_id",
            *[_label("doc_id", i + 1, f"{i} + 2 * quality + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE toxic END)", f) for i, f in enumerate(FS)],
        ],
        None,
    ),
    "second_labeler": (
        "labels",
        ["doc_id", *[_label("doc_id", i + 1, f"{i} + 2 + (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)", f) for i, f in enumerate(FS)]],
        None,
    ),
    "sized": (
        "documents",
        ["doc_id AS row_key", "CAST(n_chars AS INT) AS length", "CAST(1 + doc_id % 2 AS INT) AS n_images",
         "CAST(CASE WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END AS INT) AS signed"],
        None,
    ),
}


def derived_sql(name: str) -> str:
    source, expressions, where = DERIVED[name]
    return f"(SELECT {', '.join(expressions)} FROM {source}{' WHERE ' + where if where else ''})"


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, expressions, where = DERIVED[name]
    df = documents(spark, folder) if name == "reports" else table(spark, folder, source)
    return (df.filter(where) if where else df).selectExpr(*expressions)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, dealt to all cores: the given file is one row group, which a scan cannot cut."""
    return table(spark, folder, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id")


def drawn_sql(source: str, key: str, items: str, rate: float) -> str:
    """``source`` with a row for each item that W4 draws: its place ``i`` among them and the item ``x``.

    Every swap of the permutation is a nested query.
    """
    base = f"(CAST('0x' || substr(md5('42:' || {key}), 1, 8) AS BIGINT) % {folds.PRIME - 1} + 1)"
    out = f"(SELECT *, CAST(len({items}) AS BIGINT) AS n_, greatest(1, CAST(floor({rate}::DOUBLE * len({items})) AS BIGINT)) AS k_ FROM {source})"
    out = f"(SELECT *, unnest(range(k_)) AS i FROM {out} WHERE n_ > 0)"
    out = f"(SELECT *, {base} AS base_, i AS p_ FROM {out})"
    for r in range(1, folds.SWAPS + 1):
        key_ = f"(base_ * {pow(folds.KEY_ROOT, r, folds.PRIME)} % {folds.PRIME})"
        out = f"(SELECT *, {key_} AS key_, ({key_} % n_ + n_ - p_) % n_ AS o_ FROM {out})"
        bit = f"((((greatest(p_, o_) % {folds.PRIME} * {folds.MIX} + key_) % {folds.PRIME} * {folds.SECOND_MIX}) % {folds.PRIME}) >> 16) % 2"
        out = f"(SELECT * EXCLUDE (key_, o_) REPLACE (CASE WHEN {bit} = 1 THEN o_ ELSE p_ END AS p_) FROM {out})"
    return f"(SELECT *, {items}[p_ + 1] AS x FROM {out})"
