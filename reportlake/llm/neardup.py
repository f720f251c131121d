"""Near-duplicates of documents: HyperMinHash sketches, banded, estimated, then verified.

A sketch register belongs to one random permutation of the shingle hashes and keeps its
minimum in 16 bits: the number of leading zeros (6) and the ten bits after the first one.
A permutation for each register, not a share of one, keeps every register filled
however short the text is. Bands of compressed registers are hashed into buckets.

1. Texts with equal shingle sets are one class; only the smallest row of a class goes on.
2. Every class is paired with the smallest class of each bucket it is in (a star, never all pairs).
   Pairs pass the exact size rule and the collision-corrected estimate, and are then verified
   on the full shingle sets.
3. Buckets whose members are still in different components are compared inside the task, large
   buckets cut in blocks: members outside the largest component look at the others by falling
   estimate and are verified there on the full shingle sets. Only links that join components
   leave the task, never more than there are members.
4. Components of all verified links.

A pair of similarity 0.75 shares no band with a probability of 5e-6 for 32 bands of 4 registers,
and falls below the estimate's margin, four standard deviations, with one of about 2e-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import like_documents, whole_text
from reportlake.llm.components import components
from reportlake.session import stage

SHINGLE = 5
MANTISSA = 10


@dataclass(frozen=True)
class Setting:
    bands: int = 32
    rows: int = 4
    percent: int = 75  # 100 * intersection >= percent * union
    margin: float = 0.16  # the estimate may be so much lower than the similarity asked for
    block: int = 1000  # members of a bucket that are compared at a time
    seed: int = 7

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; words are lower-cased in A-Z."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], dtype=np.uint64)
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.array([known[w] for w in words], dtype=np.uint64)
    n = len(ids) - SHINGLE + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):  # each step mixes in one more word
        out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def multipliers(setting: Setting) -> np.ndarray:
    """Odd multipliers, one permutation of the hashes each."""
    return np.random.default_rng(setting.seed).integers(0, 2**64, setting.registers, dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray, odd: np.ndarray) -> bytes:
    """Leading-zero count and mantissa of each permutation's minimum; big-endian 16-bit registers."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 512):  # 512 rows stay in the processor's cache
        mixed = hashes[i : i + 512, None] * odd[None, :]
        np.minimum(low, mixed.min(axis=0), out=low)
    part, exponent = np.frexp(np.maximum(low, np.uint64(1)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    mantissa = ((2 * part - 1) * (1 << MANTISSA)).astype(np.uint16)
    return ((zeros << np.uint16(MANTISSA)) | mantissa).astype(">u2").tobytes()


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers that agree by chance between disjoint sets of n and m shingles."""
    zeros = np.arange(64, dtype=np.float64)

    def cell(size: np.ndarray) -> np.ndarray:  # probability of each leading-zero count of the minimum
        size = size[:, None]
        return np.exp(size * np.log1p(-np.exp2(-zeros - 1))) - np.exp(size * np.log1p(-np.minimum(np.exp2(-zeros), 1 - 1e-12)))

    return (cell(n) * cell(m)).sum(axis=1) / (1 << MANTISSA)


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches (rows of registers), corrected for chance matches."""
    chance = chance_matches(n.astype(np.float64), m.astype(np.float64))
    return np.maximum(0.0, ((a == b).mean(axis=1) - chance) / (1 - chance))


def sketches(docs: DataFrame, setting: Setting = Setting(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, digest of the shingle set, sketch); the last two are null for empty sets."""
    odd = multipliers(setting)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                found = shingles(text)
                rows.append((key, len(found), *((xxhash.xxh3_128_digest(found.tobytes()), sketch(found, odd)) if len(found) else (None, None))))
            yield pd.DataFrame(rows, columns=["id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text")).mapInPandas(
        run, "id long, n_shingles long, digest binary, sketch binary"
    )


def _estimated(pairs: DataFrame, classes: DataFrame, setting: Setting) -> DataFrame:
    """Pairs (a, b) that the size rule and the estimate let through."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = both.filter(100 * smaller >= setting.percent * larger)
    registers = setting.registers

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        wide = [np.frombuffer(b"".join(x), dtype=">u2").reshape(-1, registers) for x in (a, b)]
        return pd.Series(estimates(*wide, n.to_numpy(), m.to_numpy()))

    least = setting.percent / 100 - setting.margin
    return both.withColumn("estimate", estimate("s_a", "s_b", "n_a", "n_b")).filter(F.col("estimate") >= least).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, setting: Setting) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. texts: (id, text)."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    percent = setting.percent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            good = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["t_a"], batch["t_b"], strict=True):
                if a != last:
                    last, first = a, shingles(text_a)
                second = shingles(text_b)
                common = len(np.intersect1d(first, second, assume_unique=True))
                if 100 * common >= percent * (len(first) + len(second) - common):
                    good.append((a, b))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    return both.mapInPandas(run, "a long, b long")


def _links_across(members: DataFrame, setting: Setting) -> DataFrame:
    """Verified links (a, b) between different components of a bucket, enough to join all that are linked.

    members: (bucket, id, component, blocks, n_shingles, sketch, hashes). A bucket of more than one
    block is dealt out as pairs of blocks. Members outside the largest component look at all
    others that pass size rule and estimate and are not joined to them yet.
    """
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    dealt = members.withColumn("own", block).withColumn("other", other)
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.select("bucket", "i", "j", "own", "id", "component", "n_shingles", "sketch", "hashes")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    registers, least, percent = setting.registers, setting.percent / 100 - setting.margin, setting.percent

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, n, own = (group[c].to_numpy() for c in ("id", "n_shingles", "own"))
        wide = np.frombuffer(b"".join(group["sketch"]), dtype=">u2").reshape(-1, registers).astype(np.uint16)
        sets = [np.frombuffer(h, dtype=np.uint64) for h in group["hashes"]]
        mixed = group["i"].iloc[0] != group["j"].iloc[0]
        _, part, sizes = np.unique(group["component"].to_numpy(), return_inverse=True, return_counts=True)
        found = []
        for x in np.flatnonzero(part != np.argmax(sizes)):
            small, large = np.minimum(n[x], n), np.maximum(n[x], n)
            near = (part != part[x]) & (100 * small >= percent * large)
            if mixed:
                near &= own != own[x]
            rest = np.flatnonzero(near)
            if not len(rest):
                continue
            e = estimates(wide[rest], wide[x][None, :], n[rest], np.full(len(rest), n[x]))
            for y in rest[np.argsort(-e)][: int((e >= least).sum())]:  # most similar first
                if part[y] != part[x]:
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (n[x] + n[y] - common):
                        found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                        part[part == part[y]] = part[x]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            starts = np.flatnonzero(kept[["bucket", "i", "j"]].ne(kept[["bucket", "i", "j"]].shift()).any(axis=1).to_numpy())
            for start, end in zip(starts, starts[1:], strict=False):
                if end - start > 1:
                    yield compare(kept.iloc[start:end])
            kept = kept.iloc[starts[-1] :] if len(starts) else kept
        if kept is not None and len(kept) > 1:
            yield compare(kept)

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _hashed(texts: DataFrame) -> DataFrame:
    """(id, hashes): the full shingle sets, sorted, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "hashes": [shingles(t).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(run, "id long, hashes binary")


def linked(docs: DataFrame, setting: Setting = Setting(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat an id
    are one document if their texts are equal; an id with different texts joins their groups. A
    null id stays, linked with nothing. An empty table gives an empty result.
    """
    all_rows = stage(sketches(docs, setting, key, text), "sketches")
    usable = all_rows.filter("digest IS NOT NULL AND id IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("id").alias("first"))
    members = usable.join(classes, "digest")  # rows to the smallest of their class
    heads = stage(members.filter("id = first").dropDuplicates(["digest"]).select("id", "n_shingles", "sketch"), "classes")

    width = 2 * setting.rows
    band = F.explode(F.sequence(F.lit(0), F.lit(setting.bands - 1)))
    banded = heads.select("id", "sketch", band.alias("band"))
    banded = banded.select("id", F.xxhash64("band", F.substring("sketch", F.col("band") * width + 1, F.lit(width))).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    held = stage(banded.join(shared, "bucket"), "buckets")

    # texts of those that share a bucket; only these are ever compared in full
    wanted = held.select("id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("text"))
    texts = stage(texts.join(wanted.hint("shuffle_hash"), "id", "left_semi"), "texts")
    star = held.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(_verified(_estimated(star, heads, setting), texts, setting), "links")
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    blocks = F.ceil(F.col("size") / setting.block).alias("blocks")
    narrow = held.filter("size > 2 AND id <> leader").select("bucket", "id", blocks)  # the leader has met everyone already
    labelled = narrow.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # buckets of the same members need one look
    members = F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")
    open_buckets = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), members, F.count("*").alias("n"))
    open_buckets = open_buckets.filter("least <> most").groupBy("members", "n").agg(F.min("bucket").alias("bucket"))
    open_rows = stage(labelled.join(open_buckets.select("bucket"), "bucket", "left_semi"), "open")
    if not open_rows.isEmpty():
        sets = _hashed(texts.join(open_rows.select("id").distinct(), "id", "left_semi"))
        more = stage(_links_across(open_rows.join(heads, "id").join(sets, "id"), setting), "links")
        # the components that they join are few, so only these are contracted further
        to = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        joined = more.join(to("a"), "a", "left").join(to("b"), "b", "left")
        joined = joined.select(F.coalesce("c_a", "a").alias("u"), F.coalesce("c_b", "b").alias("v"))
        over = components(joined).withColumnRenamed("component", "top")
        own = found.unionByName(joined.select(F.explode(F.array("u", "v")).alias("node")).select("node", F.col("node").alias("component"))).distinct()
        found = own.join(over.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))

    # every row finds its class, and the class its component
    named = classes.join(found.withColumnRenamed("node", "first"), "first", "left")
    named = named.select("digest", F.coalesce("component", "first").alias("component_id"))
    out = all_rows.join(named, "digest", "left")
    return out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """One document of each group stays, the one with the smallest id; columns as they came.

    Rows without an id stay. Rows that repeat the id of a group's first document stay together.
    """
    found = linked(docs, setting).filter("id <> component_id").select("id").distinct()
    key = "__kept_id"
    return like_documents(docs.withColumn(key, F.col("doc_id").cast("long")).join(found.withColumnRenamed("id", key), key, "left_anti"), docs)
