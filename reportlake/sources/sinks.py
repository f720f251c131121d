"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 10_000


def save_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, one folder per split. A split may be written by many tasks."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def _csv(df: DataFrame, header: bool):
    options = {"header": str(header).lower(), "quote": '"', "escape": '"'}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return df.write.options(**options)


def save_csv(df: DataFrame, path: str, header: bool = True, gzip: bool = False) -> None:
    """CSV with doubled quotes, optionally gzip."""
    writer = _csv(df, header)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def save_csv_parts(df: DataFrame, path: str, rows: int = ROWS_PER_FILE) -> None:
    """CSV without header in files of at most ``rows`` rows."""
    _csv(df, False).option("maxRecordsPerFile", rows).csv(path)


def save_csv_single(df: DataFrame, path: str) -> None:
    """One file, by wish of the caller: it is written by one task."""
    _csv(df.repartition(1), False).csv(path)


def save_csv_splits(df: DataFrame, path: str) -> None:
    """CSV, one folder per split."""
    _csv(df, True).partitionBy("split").csv(path)


def flat_columns(df: DataFrame) -> DataFrame:
    """Struct columns laid out as ``a_b`` columns, at any depth."""
    picked = []

    def walk(prefix: str, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{prefix}.`{f.name}`", f"{name}_{f.name}", f.dataType)
        else:
            picked.append(F.col(prefix).alias(name))

    for f in df.schema.fields:
        walk(f"`{f.name}`", f.name, f.dataType)
    return df.select(*picked)


def sorted_fields(df: DataFrame) -> DataFrame:
    """Top-level columns in name order, as JSON reports are written."""
    return df.select(*sorted(df.columns))


def save_report(df: DataFrame, folder: str, prefix: str, stamp: str) -> None:
    """The report as JSON with sorted keys and as a flat CSV, in stamped folders."""
    sorted_fields(df).write.mode("append").json(f"{folder}/{prefix}_{stamp}.json")
    save_csv(flat_columns(df), f"{folder}/{prefix}_{stamp}.csv")
