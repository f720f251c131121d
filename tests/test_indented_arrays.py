"""Indented JSON arrays, cut anywhere."""

import json

import pytest

from reportlake.sources import files as S


def rows(df):
    return {r.key: r.sequences for r in df.collect()}


@pytest.mark.parametrize("indent", [2, 4, "\t"])
def test_equal_to_the_parsed_file(spark, tmp_path, indent):
    entries = [{f"k{i}": {"1": [{"a": "x\n  }\n]," + '"' * (i % 3), "b": "}" * i}], "2": []}} for i in range(200)]
    entries[7:7] = [{}, {}, {"two": {}, "keys": {"3": [{"c": None}]}}]
    entries += [{}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(entries, indent=indent))
    want = {k: v for e in entries for k, v in e.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = S.keyed_sequences_indented(spark, str(path))
        assert df.rdd.getNumPartitions() > 5
        assert rows(df) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    path.write_text(json.dumps(entries, indent=indent).replace("\n", "\r\n"))
    assert rows(S.keyed_sequences_indented(spark, str(path))) == want


def test_ends_of_files(spark, tmp_path):
    for i, text in enumerate(["[]", "[\n]", "[\n  {}\n]", '[\n  {\n    "a": {}\n  }\n]\n', '[\n  {"b": {}},\n  {\n    "c": {}\n  },\n  {"d": {}}\n]']):
        (tmp_path / f"{i}.json").write_text(text)
    assert set(rows(S.keyed_sequences_indented(spark, str(tmp_path), "  "))) == {"a", "b", "c", "d"}
    (tmp_path / "bad.json").write_text('[\n  {\n    "a": {"x": [}\n  }\n]')
    with pytest.raises(Exception, match="no JSON"):
        rows(S.keyed_sequences_indented(spark, str(tmp_path), "  "))
