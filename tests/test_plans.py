"""Ordinals, batch plans, packing, folds: exact orders and the published rules."""

import pytest
from pyspark.sql import functions as F

from reportlake.functions.text import digest
from reportlake.plans import batches as B
from reportlake.plans import folds
from reportlake.plans import ordinals as W
from reportlake.plans.packing import pack


def table_of(spark, lengths, n_images=None, parts=4):
    rows = [(i, n, (n_images or [1 + i % 2 for i in range(len(lengths))])[i]) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "row_key long, length int, n_images int").repartition(parts)


def digest_order(spark, keys, seed):
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", digest(seed, "k").alias("d"))
    return [r.k for r in sorted(df.collect(), key=lambda r: (r.d, r.k))]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ordinals_do_not_depend_on_partitions(spark, parts):
    values = [7 if i % 3 == 0 else i * 37 % 101 for i in range(500)]
    df = spark.createDataFrame([(i * i, v) for i, v in enumerate(values)], "k long, v int").repartition(parts)
    by_key = {r.k: r.ordinal for r in W.by_key(df, "k", parts=8).collect()}
    assert [by_key[i * i] for i in range(500)] == list(range(500))
    by_value = {r.k: r.ordinal for r in W.by_value(df, "v", "k", descending=True, parts=8).collect()}
    wanted = sorted(range(500), key=lambda i: (-values[i], i))
    assert [by_value[i * i] for i in wanted] == list(range(500))
    random = {r.k: r.ordinal for r in W.by_digest(df, "k", 3).collect()}
    assert sorted(random, key=random.get) == digest_order(spark, [i * i for i in range(500)], 3)


def test_lopsided_keys_and_empty_input(spark):
    keys = [*range(50), 10**12, 10**15, -(10**15)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.ordinal for r in W.by_key(df, "k", parts=16, total="n").collect()}
    assert [got[k] for k in sorted(keys)] == list(range(len(keys)))
    assert W.by_key(df.filter("k IS NULL"), "k").count() == 0


def test_ten_parts_have_floor_boundaries(spark):
    df = W.in_row_order(spark.range(13), "id").select(W.part_of(F.col("ordinal"), F.col("n_rows"), 10).alias("p"))
    sizes = [r["count"] for r in df.groupBy("p").count().orderBy("p").collect()]
    assert sizes == [(i + 1) * 13 // 10 - i * 13 // 10 for i in range(10)]


@pytest.mark.parametrize("size,per_batch", [(1, (1, 0)), (2, (0, 1)), (4, (1, 3)), (6, (2, 4)), (7, (3, 4))])
def test_image_mix(size, per_batch):
    assert B.image_mix(size) == per_batch


def test_image_balanced(spark):
    df = table_of(spark, [5] * 20, [1] * 4 + [2] * 16)
    plan = B.image_balanced(df, 4).join(df, "row_key").collect()
    assert len({r.row_key for r in plan}) == len(plan) == 16
    for b in range(4):
        batch = sorted((r for r in plan if r.batch_id == b), key=lambda r: r.slot)
        assert [r.n_images for r in batch] == [2, 2, 2, 1]


def test_batch_of_two_falls_back_to_two_image_rows(spark):
    df = table_of(spark, [5] * 9, [1] * 4 + [2] * 5)
    plan = B.image_balanced(df, 2).join(df, "row_key").collect()
    assert sorted((r.batch_id, r.slot) for r in plan) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert {r.n_images for r in plan} == {2}
    filled = B.image_balanced(df, 2, drop_last=False).collect()
    assert len(filled) == 10 and all(len({r.row_key for r in filled if r.batch_id == b}) == 1 for b in range(5))


def test_too_few_rows_of_a_class_give_no_batch(spark):
    assert B.image_balanced(table_of(spark, [5] * 8, [2] * 8), 4).count() == 0
    assert B.image_balanced(table_of(spark, [5] * 8, [1] * 8), 2).count() == 0


def test_other_image_counts_are_an_error(spark):
    with pytest.raises(Exception, match="n_images must be 1 or 2"):
        B.image_balanced(table_of(spark, [5] * 4, [1, 2, 3, 1]), 1).collect()


def deal(lengths, chunks):
    """Independent form of the dealing rule, on (length, key) pairs in order."""
    if len(lengths) % chunks:
        return [[k for i, (_, k) in enumerate(lengths) if i % chunks == c] for c in range(chunks)]
    room, out = len(lengths) // chunks, [[] for _ in range(chunks)]
    for n, k in lengths:
        open_chunks = [c for c in range(chunks) if len(out[c]) < room]
        out[min(open_chunks, key=lambda c: (sum(x for x, _ in out[c]), c))].append((n, k))
    return [[k for _, k in c] for c in out]


@pytest.mark.parametrize("n,parts", [(64, 1), (64, 17), (61, 4), (5, 4)])
def test_length_grouped(spark, n, parts):
    lengths = [(i * 7919) % 97 + 1 for i in range(n)]
    plan = B.length_grouped(table_of(spark, lengths, parts=parts), 4, 4, seed=9).collect()
    order = digest_order(spark, range(n), 9)
    wanted = []
    for start in range(0, n, 16):
        group = sorted(order[start : start + 16], key=lambda k: -lengths[k])
        wanted += [k for c in deal([(lengths[k], k) for k in group], 4) for k in c]
    assert [r.row_key for r in sorted(plan, key=lambda r: r.position)] == wanted
    assert sorted(r.position for r in plan) == list(range(n))


@pytest.mark.parametrize("n", [100, 96, 3])
def test_variable_length_uses_each_row_once(spark, n):
    plan = B.variable_length_grouped(table_of(spark, [i % 13 + 1 for i in range(n)]), 2, 2, mult=3).collect()
    assert sorted(r.position for r in plan) == list(range(n))
    assert sorted(r.row_key for r in plan) == list(range(n))


def test_modality_grouped(spark):
    lengths = [(-1 if i % 3 == 0 else 1) * (i % 17 + 1) for i in range(90)]
    plan = sorted(B.modality_grouped(table_of(spark, lengths), 4, 2).collect(), key=lambda r: r.position)
    keys = [r.row_key for r in plan]
    assert sorted(keys) == list(range(90))
    # 60 image rows leave 4, 30 text rows leave 6
    assert keys[-10:] == sorted(keys[-10:])
    for start in range(0, 80, 8):
        assert len({lengths[k] > 0 for k in keys[start : start + 8]}) == 1
    auto = B.modality_grouped_auto(table_of(spark, lengths), 4, 2).collect()
    assert sorted(r.position for r in auto) == list(range(56 + 24))


def test_full_last_group_is_still_the_leftover(spark):
    lengths = [1] * 16 + [-1] * 16
    auto = B.modality_grouped_auto(table_of(spark, lengths), 4, 2).collect()
    assert len(auto) == 16


def test_zero_length_is_an_error(spark):
    with pytest.raises(Exception, match="length must not be zero"):
        B.modality_grouped(table_of(spark, [1, 0, -2]), 1, 1).collect()


@pytest.mark.parametrize("n,world", [(10, 4), (8, 4), (2, 5)])
def test_shards_wrap_around(spark, n, world):
    got = sorted((r["rank"], r.step, r.id) for r in B.shard(spark.range(n), world, "id").collect())
    total = -(-n // world) * world
    assert got == sorted((i % world, i // world, i % n) for i in range(total))


@pytest.mark.parametrize("sizes,block", [([3, 0, 10, 1, 7], 4), ([2, 1], 8), ([8], 4), ([], 4), ([500, 1, 499], 250)])
def test_pack(spark, sizes, block):
    flat, rows = 0, []
    for k, n in enumerate(sizes):
        rows.append((k, list(range(flat, flat + n))))
        flat += n
    df = spark.createDataFrame(rows, "k long, input_ids array<int>").repartition(3)
    got = {r.block_id: r.input_ids for r in pack(df, "k", block_size=block).collect()}
    kept = flat // block * block if flat >= block else flat
    assert got == {b // block: list(range(b, min(b + block, kept))) for b in range(0, kept, block)}


def test_sampled_items(spark):
    df = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate([1, 5, 250, 0])], "k long, xs array<int>")
    got = {r.k: r.s for r in df.select("k", folds.sample_items("xs", 0.01, "k").alias("s")).collect()}
    assert [len(got[i]) for i in range(4)] == [1, 1, 2, 0]
    assert len(set(got[2])) == 2


def test_few_shot_from_one_heavy_class(spark):
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 'a' ELSE 'b' END AS label")
    got = folds.few_shot(df, 4, "label", "id").collect()
    order = digest_order(spark, range(2000), 42)
    for label, test in (("a", lambda k: k % 10 < 9), ("b", lambda k: k % 10 == 9)):
        assert {r.id for r in got if r.label == label} == set([k for k in order if test(k)][:4])


def test_epochs_differ_and_repeat(spark):
    one = [r.id for r in B.epoch_order(spark.range(50), "id", 0).orderBy("position").collect()]
    two = [r.id for r in B.epoch_order(spark.range(50).repartition(7), "id", 1).orderBy("position").collect()]
    assert one == digest_order(spark, range(50), 42) and two == digest_order(spark, range(50), 43) and one != two
