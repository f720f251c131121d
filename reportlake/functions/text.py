"""String helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: a word, or a run of punctuation.
TOKEN = r"(?U)\w+|[^\w\s]+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove every kind of white space at both ends (``trim`` knows spaces only)."""
    return F.btrim(_col(value), F.lit(BLANKS))


def is_blank(value: Column | str) -> Column:
    return strip(value) == ""


def has_two_words(value: Column | str) -> Column:
    """At least two words; false for null. Stops at the second word."""
    return F.coalesce(_col(value).rlike(r"(?U)\S\s+\S"), F.lit(False))


def tokens(value: Column | str) -> Column:
    """Words and punctuation runs in text order."""
    return F.regexp_extract_all(_col(value), F.lit(TOKEN), F.lit(0))


def count_with_percent(n: Column, total: Column, thousands: bool = False) -> Column:
    """``N (p%)`` with one decimal; null when there is nothing to count."""
    percent = F.replace(F.format_number(100.0 * n / total, 1), F.lit(","), F.lit(""))
    shown = F.format_number(n, 0) if thousands else n.cast("string")
    # one decimal always fills the published width of three
    return F.concat(shown, F.lit(" ("), percent, F.lit("%)"))


def digest(seed: int | str | Column, *keys: Column | str) -> Column:
    """Seeded md5 of a row key: the random order every plan and sample uses."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed, *[_col(k).cast("string") for k in keys]))


def digest_int(seed: int | str | Column, *keys: Column | str) -> Column:
    """The first 32 bits of :func:`digest` as a non-negative bigint."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint")


def fit_image_tokens(prompt: Column | str, wanted: Column, token: str) -> Column:
    """Make ``token`` occur exactly ``wanted`` times in the prompt."""
    prompt, mark = _col(prompt), F.lit(token)
    found = F.size(F.split(prompt, F.lit("\\Q" + token + "\\E"), -1)) - 1
    first = F.instr(prompt, token)
    head = F.substr(prompt, F.lit(1), first - 1)
    tail = F.substr(prompt, first + len(token))
    wanted = wanted.cast("int")
    return (
        F.when(found == wanted, prompt)
        .when(found > wanted, F.concat(head, F.repeat(mark, wanted), F.replace(tail, mark, F.lit(""))))
        .when(found == 0, F.concat(F.repeat(mark, wanted), prompt))
        .otherwise(F.concat(head, F.repeat(mark, wanted - found + 1), tail))
    )


def total_length(text: Column, n_images: Column, tokens_per_image: int, count_tokens=None) -> Column:
    """Token count plus a fixed cost per image.

    ``count_tokens`` maps a text column to a count column; pass a pandas UDF to
    use an outside tokeniser.
    """
    count = count_tokens(text) if count_tokens else F.size(tokens(text))
    return count + n_images * tokens_per_image


def reference_kind(reference: Column | str) -> Column:
    """How an image reference must be opened."""
    ref = _col(reference)
    return (
        F.when(ref.startswith("http://") | ref.startswith("https://"), "url")
        .when(ref.startswith("file://"), "file")
        .when(ref.startswith("data:image"), F.when(ref.contains("base64,"), "base64").otherwise("unrecognised"))
        .otherwise("path")
    )


def reference_path(reference: Column | str) -> Column:
    """The local path behind a reference, null for URLs and inline data."""
    ref, kind = _col(reference), reference_kind(reference)
    return F.when(kind == "file", F.substr(ref, F.lit(8))).when(kind == "path", ref)


def reference_bytes(reference: Column | str) -> Column:
    """The decoded inline image, null when the reference is not inline."""
    ref = _col(reference)
    after = F.substr(ref, F.instr(ref, "base64,") + 7)
    return F.when(reference_kind(ref) == "base64", F.unbase64(after))
