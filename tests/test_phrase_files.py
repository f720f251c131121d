"""Labels by phrase files: long phrases, cues with a bounded reach, and files of phrases."""

import pytest

from reportlake.operators import labels as L

RULES = L.PhraseRules(
    {"Effusion": ["effusion", "fluid in the pleural space", "Naïve sign"], "Edema": ["edema", "effusion and edema"], "None": []},
    not_mentions={"Effusion": ["effusion catheter"]},
    pre_uncertain=["may represent", "possible"],
    pre_negated=["no", "without evidence of"],
    post_negated=["is not seen"],
    post_uncertain=["is suspected"],
    stops=["but", "however"],
    window=3,
)

CASES = [
    ("There is effusion. No edema.", 1, 0),
    ("No new large left effusion", 0, None),
    ("No new very large left effusion", 1, None),  # four words away
    ("No edema but effusion", 1, 0),  # the stop ends the reach
    ("Possible\n fluid in the\npleural   space", -1, None),
    ("Without evidence of edema, effusion is\nsuspected", -1, 0),
    ("effusion is not seen. effusion is suspected", -1, None),  # uncertain beats negated
    ("effusion catheter with effusion", None, None),
    ("effusion catheter in place. effusion", 1, None),
    ("effusions, edemas, NAÏVE SIGN", 1, None),
    ("possible effusion and edema", -1, -1),
    ("no possible effusion", -1, None),  # uncertain is asked first
    ("", None, None),
    (None, None, None),
    ("...", None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string")
    rows = {r.id: r for r in L.label_by_phrases(df, "text", RULES).collect()}
    for i, (text, effusion, edema) in enumerate(CASES):
        assert (rows[i].Effusion, rows[i].Edema, rows[i]["None"]) == (effusion, edema, None), text
    assert L.label_by_phrases(df, "text", L.PhraseRules({"a": [], "b": ["..."]})).filter("a IS NULL AND b IS NULL").count() == len(CASES)


def test_many_phrases_in_a_plan_of_one_pass(spark):
    rules = L.PhraseRules({f"c{i}": [f"word{i} {j} end" for j in range(300)] + [f"word{i}"] for i in range(10)}, pre_negated=["no"])
    df = spark.createDataFrame([("no word3 7 end. word4 299 end or word9 x",)], "text string")
    out = L.label_by_phrases(df, "text", rules)
    row = out.first()
    assert (row.c3, row.c4, row.c9, row.c0) == (0, 1, 1, None)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_phrase_files(spark, tmp_path, monkeypatch):
    (tmp_path / "lung_opacity.txt").write_text("opacity\n infiltrate \n\nopacity\n")
    (tmp_path / "edema.txt").write_text("edema\n")
    assert L.phrase_lists(spark, str(tmp_path)) == {"edema": ["edema"], "lung_opacity": ["infiltrate", "opacity"]}
    monkeypatch.setattr(L, "MOST_PHRASES", 2)
    with pytest.raises(ValueError):
        L.phrase_lists(spark, str(tmp_path))
    with pytest.raises(ValueError):
        L.PhraseRules({"a": ["b", "c", "d"]}).kinds()
