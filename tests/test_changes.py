"""Replaced files are done again, touched ones are not, and a batch that is tried twice writes once."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reportlake.streaming import changes as X


def test_replaced_touched_and_retried(spark, tmp_path):
    root, target, work = (str(tmp_path / n) for n in ("in", "out", "work"))
    os.mkdir(root)

    def put(name, body, time):
        with open(f"{root}/{name}", "w") as f:
            f.write(body)
        os.utime(f"{root}/{name}", (time, time))

    shown = lambda df: df.select("path", "digest", F.explode(F.split(F.decode("content", "UTF-8"), " ")).alias("word"))
    calls = []

    def lost(df):
        calls.append(1)
        if len(calls) == 2:  # the second list of the batch, behind the first one's write
            raise RuntimeError("lost")
        return shown(df)

    def words():
        return sorted((r.path.rsplit("/", 1)[-1], r.word, r.batch) for r in X.current(X.versions(spark, target)).collect())

    for name in ("a{1}", "b", "c"):
        put(name, f"{name} one", 1000)
    X.ingest_changes(spark, root, shown, target, work)
    X.ingest_changes(spark, root, shown, target, work)
    assert words() == [(n, w, 0) for n in ("a{1}", "b", "c") for w in (n, "one")]
    put("a{1}", "new", 2000)
    put("b", "b one", 2000)
    put("d", "d", 2000)
    with pytest.raises(StreamingQueryException):
        X.ingest_changes(spark, root, lost, target, work, most_files=1)
    X.ingest_changes(spark, root, shown, target, work, most_files=1)
    assert [w[:2] for w in words()] == [("a{1}", "new"), ("b", "b"), ("b", "one"), ("c", "c"), ("c", "one"), ("d", "d")]
    # every version once
    assert sorted(r["count"] for r in X.versions(spark, target).groupBy("path", "batch", "word").count().collect()) == [1] * 8
    os.remove(f"{root}/c")
    X.ingest_changes(spark, root, shown, target, work)
    assert ("c", "one") in [w[:2] for w in words()]


def test_rounds_do_not_grow_with_the_lists(spark, tmp_path):
    root, target, work = (str(tmp_path / n) for n in ("in", "out", "work"))
    os.mkdir(root)
    for i in range(20):
        with open(f"{root}/{i} [50%].txt", "w") as f:
            f.write(f"body {i}")
    calls = []

    def shown(df):
        calls.append(1)
        return df.select("path", "digest", F.decode("content", "UTF-8").alias("body"))

    X.ingest_changes(spark, root, shown, target, work, "*.{txt,text}", most_files=1)
    found = X.current(X.versions(spark, target)).collect()
    assert sorted(r.body for r in found) == sorted(f"body {i}" for i in range(20)) and {r.batch for r in found} == {0}
    assert len(calls) <= 6  # twenty lists or more
