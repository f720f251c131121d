"""Process only what has not been processed yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reportlake.operators.joins import missing


# Fixed value: what Spark's source of whole files gives.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str | None,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    kind: str = "parquet",
    glob: str | None = None,
    files_per_trigger: int | None = None,
    **options: str,
) -> None:
    """Run ``transform`` over new files until none is left, then stop.

    The checkpoint remembers the files seen, so a second run adds nothing and a
    run cut short continues. ``transform`` is any row-wise operator. Without a
    schema the source is taken to be whole files (``kind="binaryFile"``).
    """
    reader = spark.readStream.format(kind).options(**options).schema(schema or FILE_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    query = (
        transform(reader.load(source))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()


def not_done(inputs: DataFrame, outputs: DataFrame, on: str | list[str]) -> DataFrame:
    """The batch form: inputs that have no output yet."""
    return missing(inputs, outputs, on)
