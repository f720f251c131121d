"""System prompts by task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions.prompt_values import PROMPTS
from reportlake.functions.text import digest_int

PROMPT_SCHEMA = "task string, prompts array<string>"


def default_prompts(spark: SparkSession) -> DataFrame:
    """The built-in table: one row per task."""
    return spark.createDataFrame(list(PROMPTS.items()), PROMPT_SCHEMA)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A prompt table kept as JSON lines: {"task": ..., "prompts": [...]}."""
    return spark.read.schema(PROMPT_SCHEMA).json(path)


def by_place(prompts: DataFrame) -> DataFrame:
    """The long form (task, place, prompt), with places from 0 on."""
    return prompts.select("task", F.posexplode("prompts").alias("place", "prompt"))


def all_tasks(prompts: DataFrame) -> DataFrame:
    return prompts.select("task").distinct()


def prompts_for(placed: DataFrame, task: str) -> DataFrame:
    return placed.filter(F.col("task") == task).orderBy("place").select("prompt")


def task_name(task: Column | str) -> Column:
    """The task without its brackets."""
    return F.btrim(F.col(task) if isinstance(task, str) else task, F.lit("[]"))


def with_prompt(
    df: DataFrame, placed: DataFrame, key: str, task: str = "task", seed: int = 42, out: str = "prompt"
) -> DataFrame:
    """Add one prompt per row, drawn by the row's digest; empty if the task is unknown.

    The row draws a place and meets that one prompt, so no list of prompts is
    ever gathered and rows of one task are spread over its prompts.
    """
    sizes = placed.groupBy(F.col("task").alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    drawn = df.join(sizes, task_name(task) == F.col("_task"), "left").withColumn(
        "_place", F.pmod(digest_int(seed, key), F.col("_n"))
    )
    listed = placed.select(
        F.col("task").alias("_task"), F.col("place").cast("bigint").alias("_place"), F.col("prompt").alias("_prompt")
    )
    return (
        drawn.join(listed, ["_task", "_place"], "left")
        .withColumn(out, F.coalesce("_prompt", F.lit("")))
        .drop("_task", "_n", "_place", "_prompt")
    )
