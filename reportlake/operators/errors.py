"""Rows that cannot be read keep their text and the class of their error.

Parsing never ends a job and never loses a row: good and bad rows leave in one pass, counted on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reportlake.functions.text import is_blank
from reportlake.operators.columns import as_list, as_pairs
from reportlake.sources.files import SAMPLES

GOOD = "good"
# why a sample cannot be used, in the order they are looked for
MALFORMED, NO_ID, BAD_IMAGES, NO_PAIR, BAD_PAIRS = "malformed_json", "no_id", "bad_images", "no_pair", "bad_pairs"
ERRORS = [MALFORMED, NO_ID, BAD_IMAGES, NO_PAIR, BAD_PAIRS]


def first_error(**checks: Column) -> Column:
    """The name of the first check that is true, null if none is."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(list(checks.items())):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out


def parsed_samples(lines: DataFrame, line: str = "value") -> DataFrame:
    """S6, P13 with an error channel: (unique_id, images, pairs, line, error) of JSON lines.

    A good row has its lists and neither ``line`` nor ``error``; a bad one keeps the whole line and what could be read.
    Blank and null lines are no samples and no errors.
    """
    corrupt = "_corrupt_record"
    raw = F.from_json(line, f"{SAMPLES}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt})
    df = lines.filter(F.col(line).isNotNull() & ~is_blank(line)).select(F.col(line).alias("line"), raw.alias("raw"))
    df = df.withColumn("images", as_list("raw.image_path")).withColumn("pairs", as_pairs("raw.qa_pair"))
    error = first_error(
        **{
            MALFORMED: F.col("raw").isNull() | F.col(f"raw.{corrupt}").isNotNull(),
            NO_ID: F.col("raw.unique_id").isNull() | is_blank("raw.unique_id"),
            # no path at all is allowed; text that starts a list and ends in nothing is not
            BAD_IMAGES: F.col("raw.image_path").isNotNull() & F.col("images").isNull(),
            NO_PAIR: F.col("raw.qa_pair").isNull() | F.col("raw.qa_pair").isin("", "[]"),
            BAD_PAIRS: F.col("pairs").isNull() | F.exists("pairs", lambda p: (p["q"] == "") & (p["a"] == "")),
        }
    )
    df = df.withColumn("error", error)
    return df.select(
        F.col("raw.unique_id").alias("unique_id"), "images", "pairs", F.when(F.col("error").isNotNull(), F.col("line")).alias("line"), "error"
    )


def save_with_errors(df: DataFrame, path: str, errors: list[str] | None = None) -> dict[str, int]:
    """write good and bad rows side by side in one pass; returns the counts by class, taken as the rows pass.

    The folder is partitioned by ``outcome``: ``good`` or the class of the error, so neither side opens the other's files.
    """
    seen = Observation("outcomes")
    counts = [F.count_if(F.col("error").isNull()).alias(GOOD), *[F.count_if(F.col("error") == e).alias(e) for e in errors or ERRORS], F.count(F.lit(1)).alias("rows")]
    df.observe(seen, *counts).withColumn("outcome", F.coalesce("error", F.lit(GOOD))).write.partitionBy("outcome").parquet(path)
    return seen.get


def good_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("outcome") == GOOD).drop("line", "error", "outcome")


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """(unique_id, line, error): what to mend and read again."""
    return spark.read.parquet(path).filter(F.col("outcome") != GOOD).select("unique_id", "line", "error")
