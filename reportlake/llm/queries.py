"""Registered queries of the operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import bpe, collocations, ledger, licenses, mixing, neardup, negatives, ogg, packing, quality, suffixes, urls, warc
from reportlake.session import table

TOKENIZER = Path(public_tokenizers.path("byte_bpe_50k.json"))  # a parameter of the operator; read where the query is planned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


@register("op2_distribution_divergence")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = quality.measured(docs, quality.references(docs))
    return out.select("doc_id", *[m.split()[0] for m in quality.MEASURES.split(", ")])


@register("op9_hyperminhash_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.linked(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@register("op1_incremental_blob_ledger", ledger.oracle())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = ledger.secrets(table(spark, folder, "documents"))
    return ledger.digests(found)


@register("op7_prefix_trie_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    out = bpe.encoded(table(spark, folder, "documents"), bpe.read_definition(str(TOKENIZER)))
    return out.select("doc_id", *[part.split()[0] for part in bpe.RESULT.split(", ")])


@register("op10_temperature_mixing", mixing.oracle())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    draws = mixing.mixed(docs.withColumn("n_tokens", mixing.tokens_of("text")))
    return draws.select("doc_id", "source", "n_tokens", F.col("__epoch").alias("epoch"), F.col("__block").alias("block"))


@register("op3_sequential_warc_reader", warc.oracle())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archived(table(spark, folder, "pages"), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_ogg_pages")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = ogg.media(table(spark, folder, "documents"))
    return out.select("doc_id", *[part.split()[0] for part in ogg.RESULT.split(", ")])


@register("op6_redirect_equivalence", urls.oracle())
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"))


@register("op4_rare_token_index", licenses.oracle())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licensed(table(spark, folder, "documents"))


@register("op8_hash_compared_suffix_sort")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, folder, "documents"))


@register("op12_hat_trie_collocations", collocations.oracle())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@register("op13_inverted_multi_index_negatives", negatives.oracle())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.hard_negatives(table(spark, folder, "embeddings"), label=label)


@register("op11_karmarkar_karp_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), bpe.read_definition(str(TOKENIZER))).drop("ids")
