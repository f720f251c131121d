"""Sections and conclusions on hand-made reports."""

import pytest
from pyspark.sql import functions as F

from reportlake.functions.sections import conclusions, section_name, section_rows, sectioned, sectioned_table, split_sections
from reportlake.sources.files import report_tree

REPORTS = {
    "none": "No heading here.",
    "two": "top\n FINDINGS:  \n COMPARISON: old film\n IMPRESSION: \n\n clear lungs \n",
    "blank": "top\n FINDINGS: \n FINDINGS: seen\n IMPRESSION: ",
    "swallowed": "top\n FINDINGS:\n IMPRESSION: kept inside",
    "typo": "x\n IMPRESSON: fine",
    "contained": "x\n FINDINGS AND CONCLUSIONS: here",
    "view": "x\n CHEST, PA LATERAL: body",
    "comparison": "x\n COMPARISON: only this",
    "paragraph": "x\n INDICATION: cough\n \n First.\n \n Second.",
    "empty": "",
}


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame(list(REPORTS.items()), "study string, text string")


def rows(df, study):
    return [(r.name, r.text, r.start) for r in section_rows(df, ["study"]).filter(F.col("study") == study).orderBy("pos").collect()]


def test_no_heading_is_one_section(reports):
    assert rows(sectioned(reports), "none") == [("full report", "No heading here.", 0)]


def test_preamble_keeps_the_line_break_of_the_first_heading(reports):
    assert rows(sectioned(reports), "typo") == [("preamble", "x\n ", 0), ("impression", "fine", len("x\n IMPRESSON: "))]


def test_blank_main_sections_go(reports):
    assert [n for n, _, _ in rows(sectioned(reports), "blank")] == ["preamble", "findings"]


def test_heading_right_after_a_heading_line_is_text(reports):
    found = rows(sectioned(reports), "swallowed")
    assert found == [("preamble", "top\n ", 0), ("findings", " IMPRESSION: kept inside", len("top\n FINDINGS:\n"))]


def test_last_paragraph_start_ignores_the_separator(reports):
    text = REPORTS["paragraph"]
    found = rows(sectioned(reports), "paragraph")
    start = text.index("cough")
    assert found[1] == ("indication", "cough", start)
    assert found[2] == ("last_paragraph", " First.\n \n Second.", start + len("cough"))


def test_sections_and_headings_rebuild_the_report(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr(
        "doc_id AS study", "concat(text, '\\n FINDINGS: ', text, '\\n IMPRESSION:\\n', lang) AS text"
    )
    df = split_sections(docs).withColumn(
        "ok", F.forall("sections", lambda s: F.substr(F.col("text"), s["start"] + 1, F.length(s["text"])) == s["text"])
    )
    assert df.filter(~F.col("ok")).count() == 0


@pytest.mark.parametrize(
    "written,name",
    [("RECOMMENDATION(S)", "recommendations"), ("PFI", "history"), ("ndication", "impression"), ("OLD HISTORY AND FINDINGS", "findings"),
     ("FRONTAL UPRIGHT", "findings"), ("SOMETHING", "something")],
)
def test_names(spark, written, name):
    assert spark.range(1).select(section_name(F.lit(written))).first()[0] == name


def test_conclusion_order_and_overrides(spark, reports):
    names = spark.createDataFrame([("paragraph", "indication"), ("view", "impression")], "study string, forced_section string")
    ranges = spark.createDataFrame([("none", 3, 10), ("comparison", 0, 0)], "study string, range_start int, range_stop int")
    df = conclusions(reports, "study", "text", names, ranges)
    got = {r.study: (r.conclusion, r.override) for r in df.collect()}
    assert got == {
        "none": ("heading", "range"), "two": ("clear lungs", None), "blank": ("seen", None),
        "swallowed": ("IMPRESSION: kept inside", None), "typo": ("fine", None), "contained": ("here", None), "view": (None, "missing"),
        "comparison": ("", "range"), "paragraph": ("cough", "name"), "empty": ("", None),
    }
    listed = {r.study for r in sectioned_table(df).collect()}
    assert listed == {"two", "blank", "swallowed", "typo", "contained", "empty"}
    assert sectioned_table(df, include_overrides=True).count() == len(REPORTS)


def test_report_tree(spark, tmp_path):
    folder = tmp_path / "p10" / "p10000032"
    folder.mkdir(parents=True)
    (folder / "s1.txt").write_bytes(b"a\r\n FINDINGS: b\r\n")
    (folder / "s2.txt").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"x")
    (tmp_path / "s3.txt").write_bytes(b"not in a patient folder")
    manifest = spark.createDataFrame([("s1",), ("s2",)], "study string")
    assert [tuple(r) for r in report_tree(spark, str(tmp_path)).collect()] == [("s1", "a\n FINDINGS: b\n")]
    got = sorted(tuple(r) for r in report_tree(spark, str(tmp_path), manifest).collect())
    assert got == [("s1", "a\n FINDINGS: b\n"), ("s2", "")]
