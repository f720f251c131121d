"""Readers, writers and the incremental run on real files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from reportlake.functions.cleaning import clean_reports
from reportlake.functions.prompts import all_tasks, by_place, default_prompts, prompts_for, read_prompts, with_prompt
from reportlake.functions.sections import sectioned, with_conclusion
from reportlake.session import scratch, shared_folder, stage
from reportlake.sources import files as S
from reportlake.sources import sinks as K
from reportlake.streaming.ingest import ingest


def test_csv_keeps_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [(1, 'say "hi", ok\n next'), (2, "  padded  "), (3, None), (4, "back\\slash \\\" x")]
    df = spark.createDataFrame(rows, "id int, text string")
    K.save_csv(df, str(tmp_path / "c"), gzip=True)
    back = S.csv_table(spark, str(tmp_path / "c"), "id int, text string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows
    K.save_csv(df.filter("id = 1"), str(tmp_path / "q"))
    part = next((tmp_path / "q").glob("part*.csv")).read_text()
    assert part == 'id,text\n1,"say ""hi"", ok\n next"\n'


def test_csv_parts_and_single(spark, tmp_path):
    df = spark.range(250).coalesce(2)
    K.save_csv_parts(df, str(tmp_path / "p"), rows=100)
    assert max(len(f.read_text().splitlines()) for f in (tmp_path / "p").glob("part*")) <= 100
    K.save_csv_single(df, str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("part*"))) == 1


def test_splits(spark, tmp_path):
    df = spark.range(30).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")))
    K.save_splits(df, str(tmp_path / "t"))
    assert S.parquet_splits(spark, str(tmp_path / "t"), ["val"]).count() == 10
    assert "PartitionFilters: [isnotnull(split" in S.parquet_splits(spark, str(tmp_path / "t"), ["val"])._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        S.parquet_splits(spark, str(tmp_path / "t"), ["validation"])
    assert S.tokenised_or_plain(spark, str(tmp_path / "t"), ["val", "test"]).count() == 20
    K.save_splits(df.filter("id < 6"), str(tmp_path / "t_tok"))
    assert S.tokenised_or_plain(spark, str(tmp_path / "t"), ["val", "test"]).count() == 4
    one = tmp_path / "set_data_val.parquet"
    df.filter("id < 3").drop("split").toPandas().to_parquet(one)
    got = S.parquet_split_files(spark, [str(one)], ["val"])
    assert {r.split for r in got.collect()} == {"set_val"}
    with pytest.raises(FileNotFoundError):
        S.parquet_split_files(spark, [str(one)], ["test"])


def test_sequences_and_annotations(spark, tmp_path):
    entries = [{"d1": {"528434": [{"524548": "CHEST"}], "5505568": []}}, {"d2": {}}]
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        f.write(json.dumps(entries, indent=1))
    lines = "[\n" + ",\n".join(json.dumps(e) for e in entries) + "\n]"
    (tmp_path / "lines.json").write_text(lines)
    got = {r.key: r.sequences for r in S.keyed_sequences_file(spark, str(tmp_path / "m.json.gz"), one_per_line=False).collect()}
    assert got == {r.key: r.sequences for r in S.keyed_sequences_file(spark, str(tmp_path / "lines.json")).collect()}
    assert got["d1"]["528434"] == [{"524548": "CHEST"}] and got["d1"]["5505568"] == [] and got["d2"] == {}
    notes = spark.createDataFrame([(json.dumps([{"0": {"text": "a"}}, {"0": {"text": "b"}}]),)], "text string")
    assert sorted(map(tuple, S.annotations(notes).collect())) == [(0, "a"), (1, "b")]


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.JPG").write_bytes(b"1")
    (tmp_path / "x" / ".b.jpg").write_bytes(b"1")
    (tmp_path / "c.gif").write_bytes(b"1")
    listing = S.image_listing(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in listing.collect()] == ["a.JPG"]
    assert "ReadSchema: struct<path:string,length:bigint>" in listing._jdf.queryExecution().executedPlan().toString()
    assert S.image_listing(spark, str(tmp_path), recursive=False).count() == 0


def test_missing_log(spark, tmp_path):
    log = spark.createDataFrame([("x: /a does not exist",), ("x: /b does not exist",), ("x: /a does not exist",), ("fine",)], "value string")
    listing = spark.createDataFrame([("/b",)], "path string")
    assert [r.path for r in S.missing_paths(log, listing).collect()] == ["/a"]
    (tmp_path / "m.txt").write_text("  a b \t\n c\n")
    assert [r.path for r in S.manifest(S.lines(spark, str(tmp_path / "m.txt"))).collect()] == ["a b", "c"]


def test_prompts_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"task": "T", "prompts": ["a", "b"]}\n{"task": "E", "prompts": []}\n')
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["[T]", "[E]", "[none]"] * 20)], "id int, task string")
    got = with_prompt(rows, by_place(read_prompts(spark, str(tmp_path / "p.json"))), "id").collect()
    assert {r.prompt for r in got if r.task == "[T]"} == {"a", "b"} and {r.prompt for r in got if r.task != "[T]"} == {""}
    assert len(got) == 60


def test_default_prompts(spark):
    prompts = default_prompts(spark)
    assert all_tasks(prompts).count() == 27
    assert prompts_for(by_place(prompts), "View Classification").count() == 2 and prompts_for(by_place(prompts), "none").count() == 0
    assert prompts.filter("exists(prompts, p -> p = '') OR size(prompts) = 0").count() == 0


def test_report_sink(spark, tmp_path):
    df = spark.sql("SELECT 'z' AS b, named_struct('y', 1, 'x', named_struct('w', 2)) AS a")
    K.save_report(df, str(tmp_path), "r", "1")
    assert next((tmp_path / "r_1.json").glob("part*")).read_text() == '{"a":{"y":1,"x":{"w":2}},"b":"z"}\n'
    assert next((tmp_path / "r_1.csv").glob("part*")).read_text() == "b,a_y,a_x_w\nz,1,2\n"


def test_stream_equals_batch_and_runs_once(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id", "concat(text, '\\n FINDINGS: 3 May 2010 ', lang) AS text")
    source, target, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    docs.filter("doc_id % 2 = 0").write.parquet(source)

    def work(df):
        return clean_reports(with_conclusion(sectioned(df)), "conclusion", "clean").select("doc_id", "conclusion", "clean")

    ingest(spark, source, docs.schema, work, target, seen)
    ingest(spark, source, docs.schema, work, target, seen)
    assert spark.read.parquet(target).count() == docs.filter("doc_id % 2 = 0").count()
    docs.filter("doc_id % 2 = 1").write.mode("append").parquet(source)
    ingest(spark, source, docs.schema, work, target, seen, files_per_trigger=1)
    got, wanted = spark.read.parquet(target), work(docs)
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0


def test_scratch_is_shared_and_fresh(spark):
    assert scratch(spark, "a").startswith(shared_folder(spark)) and scratch(spark, "a") != scratch(spark, "a")
    df = stage(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_stream_of_image_files(spark, tmp_path):
    from reportlake.operators.images import PNG_START, decode_png

    source, target, seen = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "seen")
    source.mkdir()
    for turn in range(2):
        (source / f"{turn}.png").write_bytes(PNG_START + b"0" * 100)
        for _ in range(2):
            ingest(spark, str(source), None, decode_png, target, seen, kind="binaryFile", glob="*.png")
        assert spark.read.parquet(target).filter("error IS NOT NULL").count() == turn + 1
