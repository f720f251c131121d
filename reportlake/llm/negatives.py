"""Hard negatives by an inverted multi-index.

The vectors' components become whole numbers, and a vector is cut in two halves. Each half has a codebook, fit by
k-means on a bounded sample; the pair of nearest codewords is a row's cell. Rows lie in shards of bounded
size in the order of their cells, so a shard holds few cells and a crowded cell fills several shards.

A task holds one shard and looks at the anchors one after the other. For an anchor, each codeword of a half has a
bound on the half score: its product with the codeword, plus the anchor's length times the largest
distance of a row from that codeword (the radius, measured over the shard). A heap takes cells in falling order of the
summed bounds (multi-sequence order), and the search ends when no open cell can change the result: the wanted
number of rows is found and the last of them beats the next bound, or the bound lies below the
window of wanted scores. So results are exact, and the index decides only how much is read.

Two passes: the first finds the anchors' positives, the second the negatives in the windows that the positives'
scores define. Anchors are the query set, one row in ``every``; they are dealt to every shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.session import stage

EXACT = 1 << 53  # doubles are exact below


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    low_percent: int = 80  # of the positive's score, the least a negative may have
    high_percent: int = 100  # the most
    scale: int = 256  # components become floor(scale * x)
    sample: int = 4096  # rows that the codebooks are fit on, at most
    shard_rows: int = 16384
    rows_a_cell: int = 64  # wanted; decides the size of the codebooks within 2 to 64 words
    steps: int = 8  # of k-means


def codebook(points: np.ndarray, words: int, steps: int) -> np.ndarray:
    """k-means from evenly spaced points; the same points give the same words."""
    centres = points[np.linspace(0, len(points) - 1, words).astype(int)].astype(float)
    for _ in range(steps):
        nearest = nearest_word(points, centres)
        for i in range(words):
            mine = points[nearest == i]
            if len(mine):
                centres[i] = mine.mean(axis=0)
    return centres


def nearest_word(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2.0 * (points @ centres.T), axis=1)


def vectors_of(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, short ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))
    for i in range(len(column)):
        out[i, : lengths[i]] = flat[at[i] : at[i + 1]]
    return out


class Shard:
    """Rows of one shard in cell order, with the radii of the codewords over these rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.half = vectors.shape[1] // 2
        self.books = first, second
        codes = [nearest_word(v, book) for v, book in ((vectors[:, : self.half], first), (vectors[:, self.half :], second))]
        cells = codes[0] * len(second) + codes[1]
        order = np.lexsort((ids, cells))
        self.ids, self.labels, self.cells = ids[order], labels[order], cells[order]
        self.longest = int(np.abs(vectors).max(initial=0)) ** 2 * max(1, vectors.shape[1])
        self.whole, self.vectors = vectors[order], vectors[order].astype(float)
        starts = np.flatnonzero(np.diff(self.cells, prepend=-1))
        ends = np.append(starts[1:], len(self.cells))
        self.span = {int(self.cells[s]): (int(s), int(e)) for s, e in zip(starts, ends, strict=True)}
        self.radii = []
        for part, code, book in ((self.vectors[:, : self.half], codes[0][order], first), (self.vectors[:, self.half :], codes[1][order], second)):
            radius = np.full(len(book), -1.0)  # of words without rows
            np.maximum.at(radius, code, np.linalg.norm(part - book[code], axis=1))
            self.radii.append(radius)

    def half_bounds(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per half: used codewords in falling order of their bound, and the bounds."""
        for part, book, radius in zip((anchor[: self.half], anchor[self.half :]), self.books, self.radii, strict=True):
            used = np.flatnonzero(radius >= 0)
            length = float(np.linalg.norm(part))
            bound = book[used] @ part + length * radius[used]
            bound += 1e-9 * (np.abs(bound) + length * (radius[used] + 1)) + 1e-6  # above any rounding
            order = np.argsort(-bound, kind="stable")
            yield used[order], bound[order]

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[float, tuple[int, int] | None]]:
        """(bound, rows) of cells in falling order of their bound; None for a cell without rows."""
        (one, high), (two, low) = self.half_bounds(anchor)
        if not len(one):
            return
        heap, met = [(-(high[0] + low[0]), 0, 0)], {(0, 0)}
        width = len(self.books[1])
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, self.span.get(int(one[i]) * width + int(two[j]))
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(one) and b < len(two) and (a, b) not in met:
                    met.add((a, b))
                    heapq.heappush(heap, (-(high[a] + low[b]), a, b))

    def exact(self, anchor: np.ndarray) -> np.ndarray:
        """The anchor as doubles where all sums stay whole in them, else as it is."""
        fits = self.longest < EXACT and int(np.abs(anchor).max(initial=0)) ** 2 * len(anchor) < EXACT
        return anchor.astype(float) if fits else anchor

    def scores(self, anchor: np.ndarray, span: tuple[int, int]) -> np.ndarray:
        rows = slice(*span)
        if anchor.dtype == float:
            return (self.vectors[rows] @ anchor).astype(np.int64)
        return self.whole[rows] @ anchor

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """The best rows of the label as (score, id)."""
        best: list[tuple[int, int]] = []  # (-score, id), sorted
        anchor = self.exact(anchor)
        for bound, span in self.visits(anchor):
            if len(best) == wanted and -best[-1][0] > bound:
                break
            if span is None:
                continue
            score, rows = self.scores(anchor, span), slice(*span)
            fits = (self.labels[rows] == label) & (self.ids[rows] != anchor_id)
            if len(best) == wanted:
                fits &= score >= -best[-1][0]
            best = merged(best, score[fits], self.ids[rows][fits], wanted)
        return [(-s, i) for s, i in best]

    def negatives(self, label: int, anchor: np.ndarray, tops: list[int], mining: Mining) -> dict[int, list[tuple[int, int]]]:
        """For every positive score, the best rows of other labels in its window as (score, id)."""
        low, high, wanted = mining.low_percent, mining.high_percent, mining.negatives
        anchor = self.exact(anchor)
        # an empty window has nothing to look for
        open_: dict[int, list[tuple[int, int]]] = {p: [] for p in tops if low * p <= high * p}
        found: dict[int, list[tuple[int, int]]] = {}
        for bound, span in self.visits(anchor):
            for p in list(open_):
                best = open_[p]
                if 100 * bound < low * p or (len(best) == wanted and -best[-1][0] > bound):
                    found[p] = open_.pop(p)
            if not open_:
                break
            if span is None:
                continue
            score, rows = self.scores(anchor, span), slice(*span)
            # the least score that any open window still wants
            least = min(max(-(-low * p // 100), -best[-1][0] if len(best) == wanted else -(-low * p // 100)) for p, best in open_.items())
            fits = np.flatnonzero((score >= least) & (self.labels[rows] != label))
            if not len(fits):
                continue
            score, ids = score[fits], self.ids[rows][fits]
            for p, best in open_.items():
                least = max(-(-low * p // 100), -best[-1][0]) if len(best) == wanted else -(-low * p // 100)
                inside = (score <= high * p // 100) & (score >= least)
                if inside.any():
                    open_[p] = merged(best, score[inside], ids[inside], wanted)
        return {p: [(-s, i) for s, i in best] for p, best in (found | open_).items()}


def merged(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    if not len(scores):
        return best
    if len(scores) > 4 * wanted:
        keep = scores >= np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
        scores, ids = scores[keep], ids[keep]
    return sorted([*best, *zip((-scores).tolist(), ids.tolist(), strict=True)])[:wanted]


def prepared(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part, one for each id."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & label.isNotNull()
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))
    rows = df.filter(good & finite).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("row")).select("id", "row.label", "row.q")


@dataclass(frozen=True)
class Index:
    """Rows (id, label, q, shard), written in the shared folder, and the codebooks."""

    rows: DataFrame
    books: tuple[np.ndarray, np.ndarray]
    width: int
    shards: int


def index(rows: DataFrame, mining: Mining) -> Index:
    rows = stage(rows, "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    n, width = facts.n, max(2, facts.width or 0)
    words = min(64, max(2, math.isqrt(n // mining.rows_a_cell)))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(mining.sample).select("q").collect()
    sample = np.zeros((max(1, len(picked)), width))
    for i, r in enumerate(picked):
        sample[i, : len(r.q)] = r.q
    half = width // 2
    books = codebook(sample[:, :half], words, mining.steps), codebook(sample[:, half:], words, mining.steps)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = vectors_of(batch.column("q"), width).astype(float)
            cell = nearest_word(v[:, :half], books[0]) * words + nearest_word(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    coded = stage(rows.mapInArrow(cells, "id long, label long, q array<long>, cell int"), "cells")
    # one number for each cell, at most 64 * 64: where the cell's rows begin in the order of cells
    sizes = {r.cell: r["count"] for r in coded.groupBy("cell").count().collect()}
    begins, at = {}, 0
    for cell in sorted(sizes):
        begins[cell] = (at, sizes[cell])
        at += sizes[cell]
    shards = max(1, -(-n // mining.shard_rows))
    if begins:
        place = F.create_map(*[F.lit(x) for c, b in begins.items() for x in (c, f"{b[0]},{b[1]}")])[F.col("cell")]
        begin, size = F.split(place, ",")[0].cast("long"), F.split(place, ",")[1].cast("long")
        within = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * size / F.lit(1 << 20)
        shard = F.floor((begin + within) / F.lit(mining.shard_rows)).cast("int")
    else:
        shard = F.lit(0)
    return Index(coded.withColumn("shard", shard).drop("cell"), books, width, shards)


def searched(idx: Index, anchors: DataFrame, look: Callable, schema: str) -> DataFrame:
    """Deals the anchors (id, label, q, tops) to every shard and yields what ``look`` finds there.

    A shard's rows come first and are kept, its anchors follow in batches, so a task holds one shard.
    """
    books, width = idx.books, idx.width
    shards = F.explode(F.sequence(F.lit(0), F.lit(idx.shards - 1)))
    dealt = anchors.select("id", "label", "q", "tops", shards.alias("shard")).withColumn("query", F.lit(1))
    rows = idx.rows.select("id", "label", "q", F.expr("CAST(NULL AS array<bigint>)").alias("tops"), "shard", F.lit(0).alias("query"))
    both = rows.unionByName(dealt).repartition(idx.shards, "shard").sortWithinPartitions("shard", "query", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shard = None, [], None
        for batch in batches:
            codes, query = batch.column("shard").to_numpy(), batch.column("query").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes * 2 + query)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if codes[a] != number:
                    number, held, shard = codes[a], [], None
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                vectors = vectors_of(part.column("q"), width)
                if not query[a]:
                    held.append((ids, labels, vectors))
                    continue
                if shard is None:
                    if not held:  # a shard without rows
                        continue
                    shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), *books)
                    held = held[:1]
                tops = part.column("tops").to_pylist()
                found = [x for k in range(b - a) for x in look(shard, int(ids[k]), int(labels[k]), vectors[k], tops[k])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return both.mapInArrow(run, schema)


def first(df: DataFrame, by: list[str], score: str, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {int(n)}")


def hard_negatives(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100, mining: Mining = Mining()
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose key is divisible by ``every``; their positives are the best other rows of their
    label, the negatives the best rows of other labels whose score lies in the positive's window. Scores are whole inner
    products and must fit 64 bits; ties go to the smaller key.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Of rows that share a key the
    one with the smallest label, then vector, counts; equal rows therefore count once. Vectors of unequal length
    are filled with zeros; an empty one scores 0 with all. An anchor without positives, or a positive
    without a row in its window (always so below zero), gives no rows. Empty table: no rows. Other columns are not
    looked at. The index (rows with their cell) and the positives are written to the shared folder.
    """
    column = F.col(label) if isinstance(label, str) else label
    idx = index(prepared(df, key, vector, column, mining.scale), mining)
    anchors = idx.rows.filter(F.col("id") % every == 0).select("id", "label", "q")

    def look_positives(shard: Shard, anchor_id: int, label: int, anchor: np.ndarray, tops: None) -> list[tuple]:
        return [(anchor_id, score, found) for score, found in shard.positives(anchor_id, label, anchor, mining.positives)]

    def look_negatives(shard: Shard, anchor_id: int, label: int, anchor: np.ndarray, tops: list[int]) -> list[tuple]:
        found = shard.negatives(label, anchor, sorted(set(tops)), mining)
        return [(anchor_id, p, score, negative) for p, best in found.items() for score, negative in best]

    no_tops = anchors.withColumn("tops", F.expr("CAST(NULL AS array<bigint>)"))
    local = searched(idx, no_tops, look_positives, "anchor_id long, positive_score long, positive_id long")
    positives = stage(first(local, ["anchor_id"], "positive_score", "positive_id", mining.positives).drop("rank"), "positives")
    tops = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("tops"))
    windows = searched(idx, anchors.join(tops, "id"), look_negatives, "anchor_id long, positive_score long, negative_score long, negative_id long")
    ranked = first(windows, ["anchor_id", "positive_score"], "negative_score", "negative_id", mining.negatives)
    return positives.join(ranked, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def oracle() -> str:
    """The stated query set against all rows."""
    return """
WITH q AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scores WHERE label = anchor_label)
  WHERE place <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
    id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id
  WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""
