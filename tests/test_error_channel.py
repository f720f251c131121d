"""Bad samples keep their text and class, and images travel inside messages."""

from pyspark.sql import functions as F

from reportlake.functions import messages as N
from reportlake.operators import errors as E

LINES = [
    ('{"unique_id": "a", "image_path": "x.png", "qa_pair": {"q": "1", "a": "2"}}', None),
    ('{"unique_id": "b", "image_path": ["x.png", ""], "qa_pair": [{"q": "1"}, {"a": "2"}]}', None),
    ('{"unique_id": "c", "qa_pair": "[{\\"q\\": \\"1\\", \\"a\\": \\"2\\"}]"}', None),
    ('{"unique_id": "d"', E.MALFORMED),
    ("not json", E.MALFORMED),
    ("[1, 2]", E.MALFORMED),
    ('{"image_path": "x.png", "qa_pair": {"q": "1", "a": "2"}}', E.NO_ID),
    ('{"unique_id": " ", "qa_pair": {"q": "1", "a": "2"}}', E.NO_ID),
    ('{"unique_id": "e", "image_path": "[x", "qa_pair": {"q": "1", "a": "2"}}', E.BAD_IMAGES),
    ('{"unique_id": "f", "image_path": "x.png"}', E.NO_PAIR),
    ('{"unique_id": "g", "qa_pair": "[oops"}', E.BAD_PAIRS),
    ('{"unique_id": "h", "qa_pair": {"other": 1}}', E.BAD_PAIRS),
    ("", "blank"),
    ("  ", "blank"),
    (None, "blank"),
]


def test_classes(spark, tmp_path):
    df = spark.createDataFrame([(line,) for line, _ in LINES], "value string")
    want = {line: error for line, error in LINES if error != "blank"}
    parsed = E.parsed_samples(df)
    bad = {r.line: r.error for r in parsed.filter("error IS NOT NULL").collect()}
    assert bad == {line: e for line, e in want.items() if e}
    path = str(tmp_path / "saved")
    counts = E.save_with_errors(parsed, path)
    assert counts["rows"] == len(want) and counts[E.GOOD] == 3 and counts[E.MALFORMED] == 3 and counts[E.BAD_PAIRS] == 2
    assert sorted(r.unique_id for r in E.good_rows(spark, path).collect()) == ["a", "b", "c"]
    assert {r.line: r.error for r in E.bad_rows(spark, path).collect()} == bad
    assert "PartitionFilters: [isnotnull(outcome" in E.bad_rows(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_image_bytes(spark):
    build = N.formatter("gemma")
    rows = [(1, ["a", "b", "a"]), (2, ["gone"]), (3, ["a", "big"]), (4, []), (5, ["gone", "b"])]
    df = spark.createDataFrame(rows, "id int, image array<string>")
    df = df.withColumn("messages", build(F.lit("q"), F.lit("r"), F.col("image"), F.lit("p")))
    df = df.unionByName(df.filter("id = 1").withColumn("id", F.lit(6)).withColumn("messages", F.lit(None).cast(df.schema["messages"].dataType)))
    files = spark.createDataFrame([("a", 2, b"AA"), ("b", 1, b"B"), ("big", 900, b"x" * 900)], "path string, length long, content binary")
    out = {r.id: r for r in N.with_image_bytes(df, "id", files, most_bytes=100).collect()}
    shown = lambda i: [(e.type, None if e.image is None else bytes(e.image), e.image_path) for e in out[i].messages[1].content]
    text = ("text", None, "")
    assert shown(1) == [("image", b"AA", ""), ("image", b"B", ""), ("image", b"AA", ""), text]
    assert shown(5) == [("image", b"B", ""), text]
    assert out[3].oversized and shown(3) == [("image", None, "a"), ("image", None, "big"), text]
    assert out[2].messages == [] and out[4].messages == [] and out[6].messages is None or out[6].messages == []
    assert sorted(out) == [1, 2, 3, 4, 5, 6]
