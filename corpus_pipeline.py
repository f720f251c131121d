"""From raw documents to encoded ones: quality, near-duplicates, secrets, mix, tokens.

Each stage works on what its predecessor kept. All but the last return the columns of documents:
the quality rules and the near-duplicate stage drop rows, the secret scan masks what it finds
inside the texts, the mix repeats the documents of rare sources. The last stage returns the token counts and
digests of each remaining row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportlake.llm import bpe, ledger, mixing, neardup, quality
from reportlake.llm.queries import TOKENIZER
from reportlake.session import stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ledger.masked(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encoded(docs, bpe.read_definition(str(TOKENIZER)))
    return out.select("doc_id", "lang", "source", *[part.split()[0] for part in bpe.RESULT.split(", ")])


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mix", mixed_sources),
    ("tokens", encoded),
]

# the first, second and last stage have no SQL form; tests hold the whole against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
