"""Report cleaning against step-by-step searches in plain Python."""

import re
from functools import reduce
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reportlake.functions import fixed_values as V
from reportlake.functions.cleaning import clean_reports, dates, sentence_case, without_dates
from reportlake.functions.text import tokens
from reportlake.session import table

DATE = V.DATE.removeprefix("(?U)")
BEFORE = set("}+@*(^)%;&:\"-#,.'/")
AFTER_1 = set("*,.;)@")
AFTER_2 = set("*-:/)';&\"%#^}")


def before(c):
    return c in BEFORE or c.isdigit() or c.isspace() or bool(re.match(r"\w", c))


def drop_run(text, date):
    """Scan maximal runs of allowed characters; cut each at its last copy of the date."""
    out, i = [], 0
    while i < len(text):
        if not before(text[i]):
            out.append(text[i])
            i += 1
            continue
        j = i
        while j < len(text) and before(text[j]):
            j += 1
        at = text.rfind(date, i, j)
        if at < 0:
            out.append(text[i:j])
        else:
            end = at + len(date)
            while end < j and (text[end] in AFTER_1 or text[end].isdigit() or text[end].isspace()):
                end += 1
            while end < j and (text[end] in AFTER_2 or text[end].isspace() or re.match(r"\w", text[end])):
                end += 1
            out.append(text[end:j])
        i = j
    return "".join(out)


def brute(chunk):
    for d in re.findall(DATE, chunk):
        chunk = drop_run(chunk, d)
        if V.BROKEN_CHUNK in chunk:
            chunk = ""
    return chunk


EXAMPLES = [
    "Compared to 10/12/2011, no change",
    "seen [x] on 3 May 2010 and [y] on 3 May 2010, 4 April 2011 again",
    "as of March 4th, 2012: stable = unchanged",
    "no date at all",
    "10-12 10-12 ! 10-12, then é10-12",
    "on 1/2/2003. = after < 1/2/2003 > tail",
    "May",
]


def test_date_runs_match_a_search(spark):
    df = spark.createDataFrame([(e,) for e in EXAMPLES], "t string")
    got = [r[0] for r in df.select(without_dates(F.col("t"))).collect()]
    assert got == [brute(e) for e in EXAMPLES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a1 /-,.=é[]:May", max_size=40), min_size=20, max_size=40))
def test_date_runs_on_random_text(spark, texts):
    texts = [t + " 3/4 " + t for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(without_dates(F.col("t"))).collect()]
    assert got == [brute(t) for t in texts]


def test_dates_in_order(spark):
    df = spark.createDataFrame([("on 10/12/2011 or 3 May 2010, Jan 5th 99; 3.5 cm",)], "t string")
    assert df.select(dates("t")).first()[0] == re.findall(DATE, "on 10/12/2011 or 3 May 2010, Jan 5th 99; 3.5 cm")


def python_case(words):
    """By sentence number: the first all-letter word of each sentence is raised."""
    lowered = [w.lower() for w in words]
    sentence = [0, *accumulate(w == "." for w in lowered)]
    first = {}
    for place, word in enumerate(lowered):
        if word.isalpha():
            first.setdefault(sentence[place], place)
    raised = [w.capitalize() if i in first.values() else w for i, w in enumerate(lowered)]
    return re.sub(r" ([.,:;])", r"\1", " ".join(raised))


def test_sentence_case_follows_the_tokens(spark, data):
    extra = [("3 cm. ok . été. ßen 4a b",), (". . a.. b . c",), ("",)]
    docs = table(spark, data, "documents").select("text").union(spark.createDataFrame(extra, "text string"))
    for r in docs.select("text", sentence_case(tokens("text")).alias("got")).collect():
        assert r.got == python_case(re.findall(r"\w+|[^\w\s]+", r.text))


SWAPS = {"\f": "  ", "™": "      ", "\n": " ", '\\"': "``"}


def python_clean(text):
    flat = re.sub(r"\f|™|\n|\\\"", lambda m: SWAPS[m.group()], text).strip()
    flat = re.sub(r"\([^)]*\)|\[[^\]]*\]", "", " ".join(re.split(r"\s+", flat)))
    ends = [m.end(1) for m in re.finditer(r"(?<!\d)([.,])(?!\d)\s*", flat)]
    parts = [flat[a:b].strip() for a, b in zip([0, *ends], [*ends, len(flat)], strict=True)]
    kept = [brute(p) if re.search(DATE, p) else p for p in parts if len(p) > 1]
    joined = " ".join(kept) if kept else flat
    for date in re.findall(DATE, flat) * 2:
        joined = joined.replace(date, "".join(date.split(" ")))
    cased = python_case(re.findall(r"\w+|[^\w\s]+", joined))
    return reduce(lambda t, swap: t.replace(*swap), V.SPREAD_OUT, cased)


def test_whole_cleaning(spark, data):
    extra = [
        ("The (old) heart is 3.5 cm. [See] Compared to 10/12/2011, no change. Lungs are 20%. ok",),
        ("Word",), (None,), ('He said \\"fine\\" .\' ok %) x %, y',), ("a b 3 May 2010",), ("on , 3 May 2010 , then . rest",),
    ]
    docs = table(spark, data, "documents").selectExpr("concat(text, ' seen 3 May 2010, (x) and 4 %. ') AS text")
    docs = docs.union(spark.createDataFrame(extra, "text string"))
    for r in clean_reports(docs, "text", "got").collect():
        two = r.text is not None and len(r.text.split()) >= 2
        assert r.got == (python_clean(r.text) if two else None)


def test_long_text_stays_linear(spark):
    """A run of 200,000 allowed characters with a date early on."""
    text = "x" * 1000 + " 3 May 2010 . " + "ab, " * 50_000
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(F.length(without_dates(F.col("text")))).first()[0] == len(brute(text))


@pytest.mark.parametrize("text,kept", [("one", False), ("one two", True), ("  one ", False), (None, False), ("a b", True)])
def test_two_words(spark, text, kept):
    from reportlake.functions.text import has_two_words

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(has_two_words("t")).first()[0] is kept
