"""Report text cleaned for annotation, all in built-in expressions.

The run of characters removed around a date is matched from the start of a
maximal run (``(?<![...])``), so the match is linear in the length of the text
and whole texts can be processed however long a sentence is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions import fixed_values as V
from reportlake.functions.text import TOKEN, has_two_words, strip

CHUNK_END = r"(?U)(?<=(?<!\d)[.,])(?!\d)\s*"
BRACKETED = r"\(.*?\)|\[.*?\]"


def tidy(text: Column) -> Column:
    """T5, first steps: odd characters, runs of blanks, bracketed remarks."""
    text = F.replace(text, F.lit("\f"), F.lit("  "))
    text = F.replace(text, F.lit("™"), F.lit("      "))
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    text = strip(F.replace(text, F.lit('\\"'), F.lit("``")))
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.regexp_replace(text, BRACKETED, "")


# what every date has: a digit behind a stroke, or the stem of a month; cheap to look for
ANCHOR = r"[-/](?U:\s*\d)|J(?:an|un|ul)|Feb|Ma[ry]|A(?:pr|ug)|Sep|Oct|Nov|Dec"


def dates(text: Column | str) -> Column:
    """Every date in the text, in order. The pattern of dates is tried only where there is an anchor."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(V.DATE), F.lit(1))
    return F.when(text.rlike(ANCHOR), found).when(text.isNotNull(), F.array().cast("array<string>"))


def chunks(text: Column | str) -> Column:
    """Pieces ending at a point or comma that no digit touches."""
    parts = F.transform(F.split(text, CHUNK_END, -1), strip)
    return F.filter(parts, lambda c: F.length(c) > 1)


def without_dates(chunk: Column) -> Column:
    """Remove each date of a chunk with the run of characters around it."""

    def remove(acc: Column, date: Column) -> Column:
        pattern = F.concat(
            F.lit(f"(?U)(?<!{V.BEFORE_DATE}){V.BEFORE_DATE}*"),
            date,
            F.lit(f"{V.AFTER_DATE_1}*{V.AFTER_DATE_2}*"),
        )
        left = F.regexp_replace(acc, pattern, F.lit(""))
        return F.when(left.contains(V.BROKEN_CHUNK), F.lit("")).otherwise(left)

    return F.when(chunk.rlike(ANCHOR), F.aggregate(dates(chunk), chunk, remove)).otherwise(chunk)


def _capital(token: Column) -> Column:
    first = F.upper(F.substring(token, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(F.substr(first, F.lit(2))), F.substr(token, F.lit(2)))


def sentence_case(token_array: Column) -> Column:
    """Lower case; a capital on the first word and the first after each point."""
    joined = F.lower(F.array_join(token_array, " "))
    sentences = F.split(joined, r"(?<![^ ])\.(?![^ ])", -1)
    # everything up to the first letter of the first all-letter token, if there is one
    upto = r"(?s)^(.*?(?<![^ ])\p{L})(?=\p{L}*+(?![^ ]))"
    measured = F.transform(
        sentences, lambda s: F.struct(s.alias("s"), F.length(F.regexp_extract(s, upto, 1)).alias("n"))
    )

    def raised(m: Column) -> Column:
        s, n = m["s"], m["n"]
        word = F.concat(F.substr(s, F.lit(1), n - 1), _capital(F.substr(s, n)))
        return F.when(n > 0, word).otherwise(s)

    text = F.array_join(F.transform(measured, raised), ".")
    for end in V.CLOSE_UP:
        text = F.replace(text, F.lit(end), F.lit(end[1:]))
    return text


def spread_punctuation(text: Column) -> Column:
    """T10."""
    for old, new in V.SPREAD_OUT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_reports(df: DataFrame, text: str, out: str) -> DataFrame:
    """T5-T10 on one column; rows with fewer than two words get null.

    Staged so that no step is evaluated twice.
    """
    df = df.withColumn("_tidy", F.when(has_two_words(text), tidy(F.col(text))))
    df = df.withColumn("_dates", dates("_tidy")).withColumn("_chunks", chunks("_tidy"))
    df = df.withColumn(
        "_flat",
        F.when(F.size("_chunks") == 0, F.col("_tidy"))
        # a chunk ends where words end, so it holds a date only if the text does
        .when(F.size("_dates") == 0, F.array_join("_chunks", " "))
        .otherwise(F.array_join(F.transform("_chunks", without_dates), " ")),
    )
    close = lambda acc, d: F.replace(acc, d, F.replace(d, F.lit(" "), F.lit("")))
    df = df.withColumn("_flat", F.aggregate(F.concat("_dates", "_dates"), F.col("_flat"), close))
    df = df.withColumn("_tokens", F.regexp_extract_all("_flat", F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(out, spread_punctuation(sentence_case(F.col("_tokens"))))
    return df.drop("_tidy", "_dates", "_chunks", "_flat", "_tokens")
