"""Cases that once went wrong: maps in heavy joins, wrapped lines, folder names, pairs, order of the truth."""

from pyspark.sql import functions as F

from reportlake.functions import registry as R
from reportlake.operators import columns as C
from reportlake.operators import joins as J
from reportlake.operators.labels import label_reports
from reportlake.plans import ordinals as W
from reportlake.sources import files as S
from reportlake.sources import sinks as K

import pytest


def test_heavy_join_with_a_map_column(spark):
    left = spark.range(400).select(F.col("id"), F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    right = spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("r"))
    out = J.split_heavy(left, right, ["k"], "left")
    assert out.count() == 400 and out.filter("r IS NOT NULL").count() == 300 and out.columns == ["k", "id", "m", "r"]
    assert J.split_heavy(left, right, ["k"], "left_anti").count() == 100
    assert J.missing(left, right.unionByName(right), "k").count() == 100
    assert J.keep_listed(left, right.unionByName(right), "k").count() == 300


def test_labels_over_line_ends(spark):
    df = spark.createDataFrame([(1, "pleural\neffusion"), (2, "No evidence of\n pleural effusion.")], "id int, text string")
    out = label_reports(df, "text", {"effusion": ["pleural effusion"]}, negated=[r"no evidence of {mention}"])
    assert {r.id: r.effusion for r in out.collect()} == {1: 1, 2: 0}
    dropped = label_reports(df, "text", {"effusion": ["pleural effusion"]}, not_mentions={"effusion": ["evidence of pleural"]})
    assert {r.id: r.effusion for r in dropped.collect()} == {1: 1, 2: None}


def test_split_name_of_folders(spark, tmp_path):
    for split in ("train", "test"):
        spark.range(3).write.parquet(str(tmp_path / f"a b+c/set_data_{split}.parquet"))
    paths = [str(tmp_path / f"a b+c/set_data_{s}.parquet") for s in ("train", "test")]
    rows = S.parquet_split_files(spark, paths, ["train", "test"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"set_train": 3, "set_test": 3}


def test_pairs_without_a_part(spark):
    df = spark.createDataFrame([('[{"q":"x"},{"a":"y"}]',), (None,)], "t string")
    rows = [r.p for r in df.select(C.as_pairs("t").alias("p")).collect()]
    assert [tuple(p) for p in rows[0]] == [("x", ""), ("", "y")] and rows[1] is None


def test_order_of_the_truth(spark):
    truth = spark.createDataFrame([(5, 0), (3, 1), (9, 2)], "id int, place int")
    table = spark.createDataFrame([(3, "c"), (9, "i"), (5, "e")], "id int, label string")
    assert [r.label for r in J.aligned(truth, table, "id", place="place").orderBy("place").collect()] == ["e", "c", "i"]


def test_bounds_come_from_a_bounded_sample(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    (cuts,) = W.quantiles(df, ["k"], 8, "k")
    assert len(cuts) == 7 and cuts == sorted(cuts)
    assert [r.ordinal for r in W.by_key(df, "k", parts=8).orderBy("k").collect()] == list(range(5000))


def test_single_file(spark, tmp_path):
    K.save_csv_single(spark.range(100).repartition(5), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_counters_by_name():
    R.register_counter("letterwise-2", F.length)
    assert R.token_counter("Vendor/Letterwise-2") is F.length and R.token_counter("gemma-3") is not F.length
    with pytest.raises(ValueError):
        R.token_counter("unheard-of")
