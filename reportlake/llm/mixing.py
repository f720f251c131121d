"""Mixing of sources to target weights by a temperature.

A source with token share p gets the weight p^a / sum(p^a). The exponent a in [0, 1] is bisected
until the weights have a wanted entropy, or no source is repeated more often than allowed. The
weights times the budget are quotas; a quota is realised as whole permutations of the source's
documents (epochs) and the beginning of one more. Every draw has a place in its source's
sequence, and equal shares of all sequences form the blocks of the mix, so each block
holds the sources by weight.

Everything is column expressions. The exponent is found from sums over the table of sources,
several exponents in one aggregate; running token counts go through buckets of the random order, as
many as the square root of the source's documents, so the largest source is spread over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text
from reportlake.session import stage


@dataclass(frozen=True)
class Target:
    """``max_repetition`` or ``entropy`` (share of the most that the sources allow, 0 to 1) decides the exponent.

    ``budget`` is in tokens; without one, it is the least that draws every document at least once.
    """

    max_repetition: float | None = 2.0
    entropy: float | None = None
    budget: float | None = None
    block_tokens: int = 250_000


POINTS = 15  # exponents tried in one aggregate
ROUNDS = 10  # each narrows the bracket 16-fold


def tokens_of(text: str) -> Column:
    """Words of the text, one at least."""
    return F.greatest(F.size(F.regexp_extract_all(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long"), F.lit(1).cast("long"))


def units(docs: DataFrame, key: str, text: str, source: str, tokens: Column | None) -> DataFrame:
    """One row for rows that are equal in key, text and source: (row, source, tokens)."""
    row = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(whole_text(text))))
    # a null source is a source of its own, told from any name by its first letter
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    narrow = docs.select(row.alias("row"), name.alias("source"), (tokens if tokens is not None else tokens_of(text)).alias("tokens"))
    return narrow.groupBy("row", "source").agg(F.sum("tokens").alias("tokens"))


def _bisected(sources: DataFrame, target: Target, total: int, least: int, most: int, n: int) -> float:
    """The exponent, to nine places."""
    share = F.col("t") / F.lit(float(total))

    def reached(a: float, z: float, s: float) -> bool:
        """Whether exponent a still meets the target from above: false means that a is too small."""
        if target.entropy is not None:
            return math.log(z) - a * s / z <= target.entropy * math.log(n)
        if target.budget is None:
            return (most / least) ** (1 - a) <= target.max_repetition
        return target.budget * (least / total) ** a / z / least <= target.max_repetition

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (POINTS + 1)
        tried = [low + step * (i + 1) for i in range(POINTS)]
        sums = [F.sum(F.pow(share, F.lit(a))) for a in tried] + [F.sum(F.pow(share, F.lit(a)) * F.log(share)) for a in tried]
        found = sources.agg(*[s.alias(f"x{i}") for i, s in enumerate(sums)]).first()
        good = [reached(a, found[i], found[POINTS + i]) for i, a in enumerate(tried)]
        first = good.index(True) if True in good else POINTS
        low, high = ([low, *tried][first], [*tried, high][first])
    return round((low + high) / 2, 9)


def weights(sources: DataFrame, target: Target) -> DataFrame:
    """sources (source, t tokens, n units) with ``weight``, ``repetition`` and the scalars of the mix."""
    if (target.entropy is None) == (target.max_repetition is None):
        raise ValueError("give either an entropy or a repetition limit")
    facts = sources.agg(F.sum("t"), F.min("t"), F.max("t"), F.count("*")).first()
    total, least, most, n = facts
    if not n:
        return sources.withColumn("repetition", F.lit(0.0)).withColumn("blocks", F.lit(1).cast("long"))
    if target.budget is not None and target.max_repetition is not None and target.budget > target.max_repetition * total:
        raise ValueError("the budget repeats the corpus more often than allowed")
    a = _bisected(sources, target, total, least, most, n) if n > 1 else 1.0
    power = F.pow(F.col("t") / F.lit(float(total)), F.lit(a))
    scale = sources.agg(F.sum(power).alias("z"), F.max(F.col("t") / power).alias("all_once")).first()
    budget = target.budget if target.budget is not None else scale.z * scale.all_once
    blocks = max(1, math.ceil(round(budget / target.block_tokens, 6)))
    weighted = sources.withColumn("weight", power / F.lit(scale.z))
    return weighted.withColumn("repetition", F.round(F.lit(budget) * F.col("weight") / F.col("t"), 9)).withColumn("blocks", F.lit(blocks).cast("long"))


def drawn(docs: DataFrame, target: Target = Target(), key: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """(row, source, tokens, epoch, block), one row for each draw of a unit.

    Null keys and texts count as empty, a null source is a source; a document has one token at
    least. Rows equal in key, text and source are drawn together. No documents, no draws.
    """
    rows = stage(units(docs, key, text, source, tokens), "units")
    sources = stage(rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "sources")
    mix = weights(sources, target)
    mix = mix.withColumn("whole", F.floor("repetition")).withColumn("rest", F.floor((F.col("repetition") - F.col("whole")) * F.col("t")))
    mix = mix.withColumn("parts", F.ceil(F.sqrt("n"))).select("source", "t", "repetition", "whole", "rest", "parts", "blocks")

    # sources are few against documents; Spark sends them along or splits the large ones
    each = rows.join(mix, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    each = each.filter((F.col("epoch") < F.col("whole")) | (F.col("rest") > 0))
    each = each.withColumn("order", F.md5(F.concat_ws(":", "row", "epoch")))
    at = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    each = each.withColumn("bucket", F.floor(at * F.col("parts") / F.lit(2**32)))
    place = ["source", "epoch", "bucket"]
    sums = each.groupBy(*place).agg(F.sum("tokens").alias("in_bucket"))
    running = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*place, F.coalesce(F.sum("in_bucket").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*place).orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, place)
    each = each.withColumn("from", F.col("before") + F.col("inside"))
    each = each.filter((F.col("epoch") < F.col("whole")) | (F.col("from") + F.col("tokens") <= F.col("rest")))
    progress = (F.col("epoch") + F.col("from") / F.col("t")) / F.col("repetition")
    return each.select("row", "source", "tokens", "epoch", F.floor(progress * F.col("blocks")).alias("block"))


def mixed(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The documents, each as often as it is drawn, with ``epoch`` and ``block`` behind their columns."""
    marked = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    draws = drawn(marked, target, place["doc_id"], place["text"], place["source"])
    draws = draws.groupBy("row", "source").agg(F.collect_list(F.struct("epoch", "block")).alias("draws"))
    row = F.md5(F.concat_ws("|", F.coalesce(F.col(place["doc_id"]).cast("string"), F.lit("")), F.md5(whole_text(place["text"]))))
    name = F.coalesce(F.concat(F.lit("s"), F.col(place["source"]).cast("string")), F.lit("n"))
    rows = marked.withColumn("row", row).withColumn("source", name).join(draws, ["row", "source"])
    out = rows.select(*[F.col(f"_{i}") for i in range(len(docs.columns))], F.explode("draws").alias("draw"))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("draw.epoch").alias("__epoch"), F.col("draw.block").alias("__block"))


def mix(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """As ``mixed``, with the columns of ``docs`` only."""
    return mixed(docs, target).drop("__epoch", "__block")


def oracle(target: Target = Target()) -> str:
    """DuckDB SQL for (doc_id, source, n_tokens, epoch, block) with a repetition limit and no budget given."""
    return f"""WITH RECURSIVE d AS (
  SELECT md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS row, doc_id, source,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS n FROM documents),
u AS (SELECT row, any_value(doc_id) AS doc_id, source, sum(n)::BIGINT AS tokens FROM d GROUP BY row, source),
s AS (SELECT source, sum(tokens)::BIGINT AS t FROM u GROUP BY source),
x AS (SELECT sum(t)::DOUBLE AS total, min(t)::DOUBLE AS least, max(t)::DOUBLE AS most, count(*) AS n FROM s),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
  SELECT i + 1, CASE WHEN good THEN low ELSE mid END, CASE WHEN good THEN mid ELSE high END FROM (
    SELECT i, low, high, (low + high) / 2 AS mid, pow(most / least, 1 - (low + high) / 2) <= {target.max_repetition} AS good FROM b, x) WHERE i < 45),
a AS (SELECT CASE WHEN x.n > 1 THEN round((low + high) / 2, 9) ELSE 1.0 END AS a FROM b, x WHERE i = 45),
p AS (SELECT source, t, pow(t / total, a) AS power FROM s, x, a),
z AS (SELECT sum(power) AS z, max(t / power) AS once FROM p),
w AS (SELECT source, t, round(z * once * (power / z) / t, 9) AS rep, greatest(1, ceil(round(z * once / {target.block_tokens}, 6))) AS blocks FROM p, z),
m AS (SELECT *, floor(rep)::BIGINT AS whole, floor((rep - floor(rep)) * t)::BIGINT AS rest FROM w),
e AS (SELECT u.*, m.t, rep, whole, rest, blocks, unnest(range(0, whole + 1)) AS epoch FROM u JOIN m ON u.source IS NOT DISTINCT FROM m.source),
o AS (SELECT *, md5(row || ':' || epoch) AS ord FROM e),
f AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY ord, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM o)
SELECT doc_id, source, tokens AS n_tokens, epoch, floor((epoch + start / t) / rep * blocks)::BIGINT AS block
FROM f WHERE epoch < whole OR start + tokens <= rest"""
