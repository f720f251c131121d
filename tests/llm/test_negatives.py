"""Hard negatives against all pairs, and the order and bounds of the cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, shard long, tops string"


def brute(rows, every=100, low=80, high=100):
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known[i] = min(known.get(i, (math.inf,)), (label, [math.floor(256 * x) for x in v]))
    out = set()
    for a, (label, v) in known.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in known.items() if i != a)
        for minus_p, p in [x for x in scores if known[x[1]][0] == label][:5]:
            fits = [(-s, i) for s, i in scores if known[i][0] != label and low * -minus_p <= 100 * -s <= high * -minus_p]
            out |= {(a, p, k + 1, i, -minus_p, s) for k, (s, i) in enumerate(fits[:5])}
    return out


def result(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def vectors(seed, n, d=6, crowd=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        if rng.random() < crowd:
            v = [0.5] * d  # one vector in a third of the rows
        else:
            v = [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]
        rows.append((i, v, rng.randrange(4)))
    return rows


@pytest.mark.parametrize("mining", [neg.Mining(), neg.Mining(shard_rows=60, rows_a_cell=4, sample=50)])
def test_against_all_pairs(spark, mining):
    rows = vectors(1, 400)
    odd = [(None, [1.0] * 6, 1), (401, None, 1), (402, [1.0] * 6, None), (403, [1.0, None] * 3, 1), (404, [math.nan] * 6, 1), (405, [math.inf] * 6, 1)]
    odd += [(500, [], 2), (501, [9.0], 2), (600, [-1e-9] * 6, 0), (700, rows[3][1], rows[3][2]), (700, rows[4][1], rows[4][2])]
    everything = rows + odd + rows[:30]
    got = result(neg.hard_negatives(frame(spark, everything).repartition(3), every=20, mining=mining))
    want = brute(everything, every=20)
    assert got == want and len(want) > 100


def test_empty_and_alone(spark):
    empty = frame(spark, []).limit(0)
    assert neg.hard_negatives(empty).count() == 0
    assert neg.hard_negatives(frame(spark, [(0, [1.0, 2.0], 1)])).count() == 0
    one = frame(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2)])
    assert [tuple(r) for r in neg.hard_negatives(one).collect()] == [(0, 1, 1, 2, 256**2 + 512**2, 256 * 256 + 512 * 486)]


def test_large_components_are_exact(spark):
    rows = [(0, [1e7, 3.0], 1), (1, [1e7, 2.0], 1), (2, [1e7, 1.0], 2), (3, [1e7, 1.5], 2)]
    assert result(neg.hard_negatives(frame(spark, rows))) == brute(rows)


def test_cells_come_in_falling_order_and_bounds_hold():
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (500, 8))
    shard = neg.Shard(np.arange(500), np.zeros(500, np.int64), v, neg.codebook(v[:, :4], 5, 4), neg.codebook(v[:, 4:], 5, 4))
    for q in v[:20]:
        visits = list(shard.visits(q))
        bounds = [b for b, _ in visits]
        assert bounds == sorted(bounds, reverse=True)
        spans = [s for _, s in visits if s]
        assert sum(e - s for s, e in spans) == 500 and len(set(spans)) == len(spans)
        assert all(shard.scores(q, s).max() <= b for b, s in visits if s)


def test_search_stops_early():
    """Two far clusters: an anchor of one never reads the other's cells."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(900, 1000, (200, 8)), rng.integers(-1000, -900, (200, 8))])
    shard = neg.Shard(np.arange(400), np.arange(400) % 2, v, neg.codebook(v[:, :4], 4, 5), neg.codebook(v[:, 4:], 4, 5))
    read = []
    scores = shard.scores
    shard.scores = lambda q, span: read.append(span[1] - span[0]) or scores(q, span)
    best = shard.positives(0, 0, v[0], 5)
    assert len(best) == 5 and sum(read) <= 200
    read.clear()
    assert all(len(x) == 5 for x in shard.negatives(0, v[0], [s for s, _ in best], neg.Mining()).values()) and sum(read) <= 200


def test_label_expression(spark):
    rows = vectors(7, 200)
    changed = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    assert result(neg.hard_negatives(frame(spark, rows), label=label)) == brute(changed)
