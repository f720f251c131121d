"""Joins, counts, column rules, messages."""

import pytest
from pyspark.sql import functions as F

from reportlake.functions import messages as N
from reportlake.functions import numbers as M
from reportlake.functions import registry as R
from reportlake.functions import text as X
from reportlake.operators import aggregates as A
from reportlake.operators import columns as C
from reportlake.operators import joins as J
from reportlake.operators import labels as L

VALUES = [None, 0, 1, -1]


def test_all_pairs_of_labels(spark):
    df = spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a int, b int")
    got = {(r.a, r.b): r.x for r in df.select("a", "b", L.agreement(F.col("a"), F.col("b")).alias("x")).collect()}
    names = {0: "Negative", 1: "Positive", -1: "Uncertain", None: None}
    assert got == {(a, b): names[a] if a == b else "Disagreement" for a in VALUES for b in VALUES}


@pytest.mark.parametrize("mode,wanted", [("mention", [0, 1, 1, 1]), ("negation", [0, 1, 0, 0]), ("uncertain", [0, 0, 0, 1])])
def test_modes(spark, mode, wanted):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v int")
    assert [r.x for r in df.orderBy("i").select(L.binarised(F.col("v"), mode).alias("x")).collect()] == wanted
    with pytest.raises(ValueError):
        L.binarised(F.col("v"), "other")


def test_scores_without_positives_or_hits(spark):
    truth = spark.createDataFrame([(1, 1, None), (2, 0, None)], "id int, a int, b int")
    said = spark.createDataFrame([(1, None, 1), (2, None, 1)], "id int, a int, b int")
    got = {r.finding: tuple(r)[1:] for r in L.score_labels(truth, said, ["a", "b"], "id", "mention").collect()}
    assert got == {"a": (0.0, 0.0, None, 2), "b": (None, None, None, 0)}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_split_heavy_equals_a_plain_join(spark, how):
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 400 END AS k")
    right = spark.range(0, 300, 2).selectExpr("id AS k", "id * 10 AS v").union(spark.createDataFrame([(5, 1), (5, 2)], "k long, v long"))
    mine = sorted(map(tuple, J.split_heavy(left, right, ["k"], how).collect()), key=str)
    plain = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
    columns = J.split_heavy(left, right, ["k"], how).columns
    order = [left.join(right, ["k"], how).columns.index(c) for c in columns]
    assert mine == sorted((tuple(r[i] for i in order) for r in plain), key=str)


def test_copies_of_a_text_meet_one_label_row(spark):
    reports = spark.createDataFrame([(i, "same" if i < 40 else f"t{i}") for i in range(60)], "id int, text string")
    labels = reports.select(F.col("text").alias("Reports"), F.length("text").alias("f"))
    got = J.labels_by_text(labels, reports, "Reports", "text", "id")
    assert got.count() == 60 and got.select("id").distinct().count() == 60


def test_semi_and_anti_make_up_the_input(spark):
    df, listing = spark.range(100).toDF("k"), spark.range(0, 150, 7).toDF("k")
    both = J.keep_listed(df, listing, "k").union(J.missing(df, listing, "k"))
    assert sorted(r.k for r in both.collect()) == list(range(100))


def test_aligned_raises_on_a_missing_id(spark):
    truth, other = spark.range(3).toDF("id"), spark.createDataFrame([(0, 1), (1, 1)], "id long, a int")
    with pytest.raises(Exception, match="no row for id 2"):
        J.aligned(truth, other, "id").collect()
    assert J.aligned(truth, other, "id", strict=False).count() == 3


def test_zip_drops_the_longer_end(spark):
    left = spark.createDataFrame([(5, "a"), (1, "b"), (9, "c")], "k long, x string")
    right = spark.createDataFrame([(20, "p"), (10, "q")], "n long, y string")
    assert sorted((r.x, r.y) for r in J.zip_in_order(left, right, "k", "n").collect()) == [("a", "p"), ("b", "q")]


def test_views(spark):
    rows = [("AP", None), ("AP", "SHOULDER"), ("LPO", "CHEST PA"), ("LPO", "NOPE"), ("LPO", None), (None, "CHEST LAT"), ("X", None)]
    df = spark.createDataFrame(rows, "p string, d string")
    view = lambda **o: [r[0] for r in df.select(C.view_of(F.col("p"), F.col("d"), **o)).collect()]
    assert view() == ["frontal", "frontal", "frontal", None, "other", "lateral", None]
    assert view(keep_known=True)[3] == "other"


def test_loss(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 3)], "loss double, n int")
    assert A.mean_loss(df, "loss").first().loss == 2.0
    assert A.mean_loss(df, "loss", "n").first().loss == 2.5
    assert A.mean_loss(df.select(F.lit(1e4).alias("loss")), "loss").first().perplexity == float("inf")
    assert A.mean_loss(df.filter("n > 9"), "loss", "n").first().loss == float("inf")


@pytest.mark.parametrize("h,w", [(100, 200), (1, 1), (10000, 9000), (28, 28), (42, 70), (14, 2000), (5, 2000)])
def test_target_size(spark, h, w):
    got = spark.range(1).select(M.target_size(F.lit(h), F.lit(w)).alias("s")).first().s
    if max(h, w) / min(h, w) > 200:
        assert not got.valid and got.height is None
        with pytest.raises(Exception, match="side ratio"):
            spark.range(1).select(M.target_size(F.col("id") * 0 + h, F.lit(w), strict=True)).collect()
        return
    assert got.height % 28 == 0 and got.width % 28 == 0
    assert M.MIN_PIXELS <= got.height * got.width <= M.MAX_PIXELS


@pytest.mark.parametrize(
    "prompt,n,wanted",
    [("a<i>b", 1, "a<i>b"), ("ab", 2, "<i><i>ab"), ("a<i>b", 3, "a<i><i><i>b"), ("a<i>b<i>c<i>", 2, "a<i><i>bc"), ("a<i>b", 0, "ab"), ("ab", 0, "ab")],
)
def test_image_tokens(spark, prompt, n, wanted):
    assert spark.range(1).select(X.fit_image_tokens(F.lit(prompt), F.lit(n), "<i>")).first()[0] == wanted


def test_percent_format(spark):
    df = spark.createDataFrame([(1, 8), (1234, 1234), (0, 3), (1, 3000)], "n long, t long")
    got = [r[0] for r in df.select(X.count_with_percent(F.col("n"), F.col("t"), True)).collect()]
    assert got == [f"{n:,} ({100.0 * n / t:3.1f}%)" for n, t in [(1, 8), (1234, 1234), (0, 3), (1, 3000)]]


def test_padding_has_the_wanted_length(spark):
    df = spark.createDataFrame([([1] * n,) for n in (0, 3, 8, 9)], "ids array<int>")
    assert {len(r[0]) for r in df.select(N.pad_or_cut("ids", 8)).collect()} == {8}


def test_messages_without_images_and_blank_chunks(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "  ", "r"), ([], "q", "r")], "image array<string>, q string, r string")
    built = df.select(N.gemma_messages(F.col("q"), F.col("r"), F.col("image"), F.lit("")).alias("m"))
    full, none = built.collect()
    assert [t.role for t in full.m] == ["system", "user", "assistant"] and none.m == []
    flat = built.select(N.flatten_content("m", F.lit(2)).alias("m")).first().m
    # the empty system prompt goes, the blank text stays as an empty one, the third image goes
    assert [t.role for t in flat] == ["user", "assistant"]
    assert [(c.type, c.text, c.image) for c in flat[0].content] == [("image", None, "a"), ("image", None, "b"), ("text", "", None)]


def test_resolved_images_fall_back_to_the_other_folder(spark):
    df = spark.createDataFrame([(1, ["x/train-512/a", "y", "x/train-512/b"]), (2, ["gone"])], "k int, image array<string>")
    df = df.withColumn("m", N.drop_system(N.gemma_messages(F.lit("q"), F.lit("r"), F.col("image"), F.lit("s"))))
    files = spark.createDataFrame([("x/train/a", b"A"), ("x/train/b", b"no"), ("x/train-512/b", b"B"), ("y", b"Y")], "path string, content binary")
    got = N.resolve_images(df, "k", "m", files, ("train-512", "train")).collect()
    assert [(r.k, [bytes(b) for b in r.pictures]) for r in got] == [(1, [b"A", b"Y", b"B"])]


def test_registries():
    with pytest.raises(ValueError):
        N.formatter("unknown")
    with pytest.raises(ValueError):
        R.token_counter("unknown")
    with pytest.raises(NotImplementedError):
        R.reader_for("unknown")


def test_coerced_lists(spark):
    df = spark.createDataFrame([("a/b.png",), ('["a","b"]',), ("[]",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(C.as_list("p")).collect()] == [["a/b.png"], ["a", "b"], [], [], []]


def test_text_column(spark):
    assert C.text_column(spark.createDataFrame([("a", "b")], "x string, review string")) == "review"
    assert C.text_column(spark.createDataFrame([(1, "b")], "n int, y string")) == "y"
    with pytest.raises(ValueError):
        C.text_column(spark.range(1))


def test_label_reports(spark):
    texts = ["no effusion seen.", "possible effusion.", "effusion. no effusion.", "clear.", "no effusion, possible effusion.", "fluid overload effusion-free"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = L.label_reports(
        df, "t", {"effusion": ["effusion"]}, {"effusion": ["effusion-free"]}, pre_uncertain=[r"possible {mention}"], negated=[r"no {mention}"]
    )
    assert [r.effusion for r in got.orderBy("i").collect()] == [0, -1, 1, None, -1, None]
