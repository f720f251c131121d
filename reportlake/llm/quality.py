"""Quality rules: divergence of a document from the language it claims.

The character classes and the common words of a document are two histograms. Each is held
against the pooled histogram of all other documents of the same language by the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1): what a document adds to the reference is
taken out before it is judged, so none vouches for itself. A document too short for a
histogram to mean anything is judged by neither: that is the minimum-length guard.

References are counts over all documents of a language, whatever its share of the corpus: classes
are summed, words counted and the ``common_words`` most frequent kept. They are a table that is
joined to the documents by language. Where the other documents of a language have under ``least_chars``
characters there is no class reference and under ``least_words`` words no word reference: the document is
not judged by that histogram, and never by another language's. A document without a language claims none
and is judged by neither. Besides, each document is held against the rest of the whole
corpus by classes that no script decides (letters of any script, digits, stops, symbols, control characters, without
spaces), where every document weighs the same, whatever its length: a text of symbols that is alone in its language,
or among its own copies there, diverges; a text in a rare script does not.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import SPACES, whole_text
from reportlake.session import stage

ALL = "*"
SYMBOLS = b"#*$%&|<>"
LONGEST_COMMON_WORD = 40  # bytes; a longer string is never a common word
FLUSH = 200_000  # counted words that a task holds at most

# classes of a character, told by the first byte of its UTF-8 form
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "control", "latin", "two_bytes", "three_bytes", "four_bytes")
# classes that say nothing about the script; spaces belong to none
NEUTRAL = (("lower", "upper", "latin", "two_bytes", "three_bytes", "four_bytes"), ("digit",), ("stop",), ("symbol",), ("control",))


def neutral_counts(classes: np.ndarray) -> np.ndarray:
    return np.array([sum(classes[CLASSES.index(c)] for c in group) for group in NEUTRAL], dtype=np.int64)


def neutral_shares(classes: np.ndarray) -> np.ndarray:
    """Shares of the neutral classes in millionths, so that sums over documents are exact."""
    counts = neutral_counts(classes)
    return counts * 1_000_000 // max(1, counts.sum())


def _class_table() -> np.ndarray:
    """256 x classes, one where the byte starts a character of the class."""
    table = np.zeros((256, len(CLASSES)), dtype=np.int64)
    at = CLASSES.index
    for byte in range(256):
        char = chr(byte)
        if byte in SPACES:
            table[byte, at("space")] = 1
        elif byte < 32 or byte == 127:
            table[byte, at("control")] = 1
        elif char in ".,;:!?'\"()-":
            table[byte, at("stop")] = 1
        elif byte < 128:
            kind = "digit" if char.isdigit() else "lower" if char.islower() else "upper" if char.isupper() else "symbol"
            table[byte, at(kind)] = 1
        elif byte >= 0xC0:  # 0x80 to 0xBF continue a character
            table[byte, at("latin" if byte < 0xCA else "two_bytes" if byte < 0xE0 else "three_bytes" if byte < 0xF0 else "four_bytes")] = 1
    return table


def class_counts(raw: bytes, table: np.ndarray) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ table


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two count vectors; 0 where one of them is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    gap = sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q)) / 2
    return min(1.0, max(0.0, gap)) ** 0.5


def unpacked(reference: str) -> tuple[np.ndarray, dict[bytes, int] | None, np.ndarray]:
    """Class counts, places of the common words (None without a word reference) and their counts, all other words last."""
    classes, all_words, *listed = reference.split("\n")
    words = [w.encode("utf-8") for w in listed[0::2]]
    common = np.array(listed[1::2], dtype=np.int64)
    places = {w: i for i, w in enumerate(words)} if all_words else None
    return np.array(classes.split(), dtype=np.int64), places, np.append(common, int(all_words or 0) - common.sum())


@dataclass
class References:
    """``table``: (lang, reference), one row per language that has one; ``everything``: the same of the whole corpus.

    ``corpus`` are the neutral shares summed over all documents; ``least_chars``, ``least_words`` and ``least_documents``
    are what must be left of a reference without the document that is judged. The dictionaries are for looking at and are collected when asked for; jobs only join ``table``.
    """

    table: DataFrame
    everything: DataFrame
    corpus: np.ndarray
    least_chars: int
    least_words: int
    least_documents: int

    @cached_property
    def _unpacked(self) -> dict[str, tuple]:
        rows = [(ALL, r.reference) for r in self.everything.collect()] + [(r.lang, r.reference) for r in self.table.collect()]
        return {lang: unpacked(reference) for lang, reference in rows}

    @property
    def classes(self) -> dict[str, np.ndarray]:
        return {lang: x[0] for lang, x in self._unpacked.items() if x[0].sum()}

    @property
    def words(self) -> dict[str, tuple[dict[bytes, int], np.ndarray]]:
        return {lang: x[1:] for lang, x in self._unpacked.items() if x[1] is not None}


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word and class counts of a task, emitted whenever many words have come together."""
    table = _class_table()
    words: dict[str | None, Counter] = {}
    classes: dict[str | None, np.ndarray] = {}
    shares = np.zeros(len(NEUTRAL), dtype=np.int64)
    held = 0

    def flush() -> pd.DataFrame:
        rows = [(lang, 1, w.decode("utf-8", "replace"), n) for lang, counted in words.items() for w, n in counted.items()]
        rows += [(lang, 0, str(i), int(n)) for lang, counted in classes.items() for i, n in enumerate(counted) if n]
        rows += [(lang, 2, "words", counted.total()) for lang, counted in words.items()]
        rows += [(None, 3, str(i), int(n)) for i, n in enumerate(shares) if n]
        words.clear(), classes.clear(), shares.fill(0)
        return pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            raw = text.encode("utf-8")
            found = words.setdefault(lang, Counter())
            before = len(found)
            found.update(raw.lower().split())
            held += len(found) - before + (lang not in classes)
            own = class_counts(raw, table)
            classes[lang] = classes.get(lang, 0) + own
            shares += neutral_shares(own)
            if held > FLUSH:
                yield flush()
                held = 0
    yield flush()


def _packed(counts: DataFrame, common_words: int, least_chars: int, least_words: int) -> DataFrame:
    """(lang, reference) of counts (lang, kind, item, n): lines of class counts, number of words, and common words with their counts."""
    ranked = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    short = (F.col("kind") != 1) | (F.octet_length("item") <= LONGEST_COMMON_WORD)
    kept = counts.filter(short).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= max(common_words, len(CLASSES)))
    entry = F.struct("rank", F.concat_ws("\n", "item", F.col("n").cast("string")).alias("entry"))
    classes = [F.coalesce(F.sum(F.when((F.col("kind") == 0) & (F.col("item") == str(i)), F.col("n"))), F.lit(0)) for i in range(len(CLASSES))]
    found = kept.groupBy("lang").agg(
        F.array(*classes).alias("classes"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("all_words"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == 1) & (F.col("rank") <= common_words), entry))).alias("common"),
    )
    by_class = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x) >= least_chars
    by_word = (F.col("all_words") >= least_words) & (F.size("common") > 0)
    none = F.array_repeat(F.lit(0).cast("long"), len(CLASSES))
    listed = F.concat(F.array(F.col("all_words").cast("string")), F.transform("common", lambda x: x["entry"]))
    classes, listed = F.when(by_class, F.col("classes")).otherwise(none), F.when(by_word, listed).otherwise(F.array(F.lit("")))
    packed = F.concat_ws("\n", F.array_join(classes.cast("array<string>"), " "), F.array_join(listed, "\n"))
    return found.filter(by_class | by_word).select("lang", packed.alias("reference"))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common_words: int = 150, least_chars: int = 2000, least_words: int = 1000, least_documents: int = 20) -> References:
    """Reference histograms of all languages, counted in one pass and pre-aggregated per task.

    Null texts count as empty, null languages for none. Of equally frequent words the smaller
    one is taken. Where too little of a language is there for a reference, or nothing at all, no
    document of it diverges from its language.
    """
    counts = docs.select(whole_text(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInPandas(
        _partial_counts, "lang string, kind int, item string, n long"
    )
    counts = stage(counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "quality-counts")
    own = stage(_packed(counts.filter("lang IS NOT NULL"), common_words, least_chars, least_words), "quality-references")
    pooled = counts.groupBy("kind", "item").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ALL))
    shares = {int(r.item): r.n for r in pooled.filter("kind = 3").select("item", "n").collect()}  # at most one row a neutral class
    corpus = np.array([shares.get(i, 0) for i in range(len(NEUTRAL))], dtype=np.int64)
    return References(own, _packed(pooled, common_words, 1, 1), corpus, least_chars, least_words, least_documents)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that stand twice or more, the first included."""
    if len(words) < 4 or len(set(zip(words, words[1:], words[2:], strict=False))) == len(words) - 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    _, pairs = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)
    _, which, times = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean, neutral_distance double"


@dataclass(frozen=True)
class Limits:
    """Guards and distances; the base rules use ``least_words`` and ``repeat_percent``."""

    least_words: int = 50
    repeat_percent: int = 50
    class_guard: int = 200  # characters below which classes are not judged
    word_guard: int = 100  # words below which common words are not judged
    class_distance: float = 0.32
    word_distance: float = 0.52
    neutral_distance: float = 0.5  # about half symbols


def measured(docs: DataFrame, refs: References, limits: Limits = Limits(), text: str = "text", lang: str = "lang", counted: bool = True) -> DataFrame:
    """``docs`` with the columns of ``MEASURES``; columns of those names are replaced.

    ``counted`` says that the references were counted over these documents, so that each is judged without
    its own share; a word that only the document itself uses is then no common word. Copies are other documents.
    A null or empty text has no words, distance 0 and fails the base rules. Repeated rows are
    each measured. A distance is 0 where the guard leaves it unjudged or nothing is left of the
    reference.
    """
    table, corpus, least_chars, least_words = _class_table(), refs.corpus, refs.least_chars, refs.least_words
    least_shares = (refs.least_documents - 1) * 1_000_000
    rest_of = (lambda whole, own: np.maximum(whole - own, 0)) if counted else (lambda whole, own: whole)

    def row(text: str, reference: str | None, read: Callable) -> tuple:
        raw = text.encode("utf-8")
        words = raw.split()
        lines = [line for line in raw.split(b"\n") if line.strip()] if b"\n" in raw else []
        repeats = repeated_words(words)
        failed = len(words) < limits.least_words or 100 * repeats > limits.repeat_percent * len(words)
        classes, places, counts = (None, None, None) if reference is None else read(reference)
        by_class = by_word = neutral = 0.0
        if len(text) >= limits.class_guard:
            own = class_counts(raw, table)
            left = None if classes is None else rest_of(classes, own)
            if left is not None and left.sum() >= least_chars:
                by_class = jensen_shannon(own, left)
            others = rest_of(corpus, neutral_shares(own))
            if others.sum() > least_shares:
                neutral = jensen_shannon(neutral_counts(own), others)
        if len(words) >= limits.word_guard and places is not None:
            other = len(counts) - 1
            own = np.bincount([places.get(w, other) for w in raw.lower().split()], minlength=other + 1)
            left = rest_of(counts, own)
            own[other] += own[:other][left[:other] == 0].sum()
            own[:other][left[:other] == 0] = 0
            if left.sum() >= least_words:
                by_word = jensen_shannon(own, left)
        good = not failed and by_class <= limits.class_distance and by_word <= limits.word_distance and neutral <= limits.neutral_distance
        spaces = len(raw) - len(raw.translate(None, SPACES))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeats, failed, by_class, by_word, good, neutral

    @F.pandas_udf(MEASURES)
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [m.split()[0] for m in MEASURES.split(", ")]
        read = lru_cache(64)(unpacked)  # most rows of a task are of a few languages
        for texts, found in batches:
            yield pd.DataFrame([row(t, x, read) for t, x in zip(texts, found, strict=True)], columns=names)

    names = [m.split()[0] for m in MEASURES.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in names]
    # two plain column lists, so that a name of docs never meets one of the references; no hint, Spark joins by size
    ours = docs.select(*[F.col(f"`{c}`") for c in rest], whole_text(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
    theirs = refs.table.select(F.col("lang").alias("__lang"), F.col("reference").alias("__reference"))
    out = ours.join(theirs, "__lang", "left").select(*[F.col(f"`{c}`") for c in rest], measure("__text", "__reference").alias("__measured"))
    return out.select(*[F.col(f"`{c}`") for c in rest], "__measured.*")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass the base rules and diverge from no reference; their own columns."""
    refs = references(docs)
    marked = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    good = measured(marked, refs, limits, place["text"], place["lang"]).filter("kept")
    return good.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
