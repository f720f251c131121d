"""Folds of even size with whole groups, and the permutation that samples list items."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from reportlake.plans import folds


@pytest.mark.parametrize("k", [2, 3, 5])
def test_sizes_and_whole_groups(spark, k):
    sizes = {"a": 400, "b": 250, "c": 90, **{f"t{i}": 1 + i % 7 for i in range(150)}, None: 5}
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = folds.balanced_folds(df, "g", k).collect()
    assert Counter((r.g, r.i) for r in got) == Counter(rows)
    where = {}
    for r in got:
        assert where.setdefault(r.g, r.fold) == r.fold and 0 <= r.fold < k
    loads = Counter(r.fold for r in got)
    # no fold passes what the heaviest group or an even share asks for by more than a light group
    most = max(400, -(-len(rows) // k))
    assert max(loads.values()) <= most + -(-len(rows) // (k * folds.HEAVY_PARTS)) + 1
    if k == 2:
        assert max(loads.values()) - min(loads.values()) <= 20
    assert folds.balanced_folds(df.limit(0), "g", k).count() == 0


def test_only_heavy_groups(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10 + [("c",)] * 9, "g string")
    assert sorted(Counter(r.fold for r in folds.balanced_folds(df, "g", 3).collect()).values()) == [9, 10, 10]


def test_room():
    assert folds.room([0, 0], 7) == [4, 8]
    assert folds.room([10, 0, 2], 6) == [0, 4, 6]
    assert folds.room([3, 3], 0) == [0, 0]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutation(spark, size):
    df = spark.range(size).withColumn("keys", folds.swap_keys(F.lit("k"), 7))
    images = [r.p for r in df.select(folds.permuted_place(F.col("id"), F.lit(size).cast("bigint"), F.col("keys")).alias("p")).collect()]
    assert sorted(images) == list(range(size))
    if size == 1000:
        assert images != sorted(images) and sum(i == p for i, p in enumerate(images)) < 20


def test_sampled_items(spark):
    df = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate([0, 1, 5, 40, 999])] + [(9, None)], "id int, x array<int>")
    rows = {r.id: r.s for r in df.select("id", folds.sample_items("x", 0.1, "id").alias("s")).collect()}
    assert [len(rows[i]) for i in range(5)] == [0, 1, 1, 4, 99] and rows[9] is None
    assert len(set(rows[4])) == 99 and max(rows[4]) < 999
    # even over many rows: each of ten items is drawn about as often
    many = spark.range(3000).select(F.explode(folds.sample_items(F.sequence(F.lit(0), F.lit(9)), 0.2, "id")).alias("x"))
    counts = [r["count"] for r in many.groupBy("x").count().collect()]
    assert len(counts) == 10 and 450 < min(counts) and max(counts) < 750
