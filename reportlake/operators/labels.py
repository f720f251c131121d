"""Label tables compared, scored and derived from reports."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions import fixed_values as V
from reportlake.functions.cleaning import chunks
from reportlake.operators.columns import mapped
from reportlake.operators.joins import side_by_side

MODES = ["mention", "negation", "uncertain"]


def agreement(first: Column, second: Column) -> Column:
    """The common label by name, ``Disagreement`` where the two differ."""
    return mapped(F.when(first.eqNullSafe(second), first).otherwise(F.lit(-9)), V.LABEL_NAMES)


def agreement_table(df: DataFrame, findings: list[str], suffix: str = "_cx") -> DataFrame:
    """A7 over all findings; the suffixed columns go."""
    named = {f: agreement(F.col(f"`{f}`"), F.col(f"`{f}{suffix}`")) for f in findings}
    return df.withColumns(named).drop(*[f + suffix for f in findings])


def binarised(label: Column, mode: str) -> Column:
    """1 where the label counts in this mode, else 0."""
    if mode == "mention":
        return F.when(label.isNull(), F.lit(0)).when(label.isin(-1, 0, 1), F.lit(1)).otherwise(label.cast("int"))
    if mode == "negation":
        return F.when(label == 0, F.lit(1)).otherwise(F.lit(0))
    if mode == "uncertain":
        return F.when(label == -1, F.lit(1)).otherwise(F.lit(0))
    raise ValueError(f"unknown mode {mode!r}")


def score_labels(truth: DataFrame, labels: DataFrame, findings: list[str], key: str, mode: str) -> DataFrame:
    """Precision, recall, F1 and positives per finding.

    One join and one aggregate over both tables; nothing is exploded. Without
    positives the scores are null; so is F1 where precision + recall is zero.
    """
    other = labels.select(key, *[F.col(f"`{f}`").alias(f"_p{i}") for i, f in enumerate(findings)])
    both = truth.join(other, key, "inner")
    sums = []
    for i, f in enumerate(findings):
        t, p = binarised(F.col(f"`{f}`"), mode), binarised(F.col(f"_p{i}"), mode)
        sums += [F.sum(t * p).alias(f"h{i}"), F.sum(t).alias(f"t{i}"), F.sum(p).alias(f"p{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("finding"),
                F.col(f"h{i}").cast("double").alias("hits"),
                F.col(f"t{i}").cast("double").alias("true"),
                F.col(f"p{i}").cast("double").alias("said"),
            )
            for i, f in enumerate(findings)
        ]
    )
    long = both.agg(*sums).select(F.inline(rows))
    some = F.col("true") > 0
    precision = F.when(some, F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)))
    long = long.withColumn("precision", precision).withColumn("recall", F.when(some, F.try_divide("hits", "true")))
    f1 = F.try_divide(2 * (F.col("precision") * F.col("recall")), F.col("precision") + F.col("recall"))
    return long.select(
        "finding", "precision", "recall", F.when(some, f1).alias("f1"),
        F.coalesce("true", F.lit(0.0)).cast("bigint").alias("positives"),
    )


def comparison_report(
    truth: DataFrame, first: DataFrame, second: DataFrame, findings: list[str], key: str, mode: str,
    names: tuple[str, str] = ("first", "second"),
) -> DataFrame:
    """A10: scores of two labelers side by side, rounded to three places."""
    scores = [score_labels(truth, t, findings, key, mode) for t in (first, second)]
    rounded = [
        s.withColumns({c: F.bround(c, 3) for c in ("precision", "recall", "f1")}) for s in scores
    ]
    return side_by_side(rounded[0], rounded[1], "finding", names, ["positives"])


def alternation(phrases: list[str]) -> str:
    return "|".join(re.escape(p.lower()).replace(r"\ ", " ") for p in sorted(phrases, key=len, reverse=True))


def label_reports(
    df: DataFrame,
    text: str,
    mentions: dict[str, list[str]],
    not_mentions: dict[str, list[str]] | None = None,
    pre_uncertain: list[str] | None = None,
    negated: list[str] | None = None,
    post_uncertain: list[str] | None = None,
) -> DataFrame:
    """One column per category: 1 positive, -1 uncertain, 0 negated, null.

    ``mentions`` lists the phrases of each category. The three cue lists hold
    patterns around ``{mention}``, tried in the order uncertain, negated,
    uncertain. Over the sentences of a report positive beats uncertain beats
    negated. White space is squeezed first, since report lines wrap inside
    phrases and sentences. Phrases become one pattern per category, so no table of sentences
    times phrases is ever built.
    """
    df = df.withColumn("_sentences", chunks(F.regexp_replace(F.lower(text), r"\s+", " ")))
    marks = {}
    for category, phrases in mentions.items():
        word = rf"\b(?:{alternation(phrases)})\b"
        dropped = (not_mentions or {}).get(category)
        mark = _sentence_mark(word, dropped, pre_uncertain, negated, post_uncertain)
        best = F.array_max(F.transform("_sentences", mark))
        marks[category] = F.when(best == 3, 1).when(best == 2, -1).when(best == 1, 0)
    return df.withColumns(marks).drop("_sentences")


def _sentence_mark(word: str, dropped, pre_uncertain, negated, post_uncertain):
    """Function of a sentence: 3 positive, 2 uncertain, 1 negated, null unmentioned."""

    def cue(sentence: Column, patterns: list[str] | None) -> Column:
        if not patterns:
            return F.lit(False)
        return sentence.rlike("(?U)" + "|".join(p.replace("{mention}", word) for p in patterns))

    def mark(sentence: Column) -> Column:
        said = sentence.rlike("(?U)" + word)
        if dropped:
            said &= ~sentence.rlike(rf"(?U)\b(?:{alternation(dropped)})\b")
        return F.when(
            said,
            F.when(cue(sentence, pre_uncertain), F.lit(2))
            .when(cue(sentence, negated), F.lit(1))
            .when(cue(sentence, post_uncertain), F.lit(2))
            .otherwise(F.lit(3)),
        )

    return mark


MOST_PHRASES = 100_000  # of a rule set; they are literals of the plan
WORD = r"(?U)\w+"


@dataclass(frozen=True)
class PhraseRules:
    """T16 with phrase files: plain phrases instead of patterns.

    A cue before (after) a mention holds if it ends (starts) at most ``window`` words away and
    none of the ``stops`` stands between. Phrases are compared word by word, in lower case.
    """

    mentions: dict[str, list[str]]
    not_mentions: dict[str, list[str]] = field(default_factory=dict)
    pre_uncertain: list[str] = field(default_factory=list)
    pre_negated: list[str] = field(default_factory=list)
    post_negated: list[str] = field(default_factory=list)
    post_uncertain: list[str] = field(default_factory=list)
    stops: list[str] = field(default_factory=list)
    window: int = 6

    def kinds(self) -> dict[str, list[int]]:
        """Phrase to the numbers of what it stands for: a mention is even, a dropped one odd, cues follow."""
        out: dict[str, set[int]] = {}

        def add(phrases: list[str], kind: int) -> None:
            for phrase in phrases:
                words = " ".join(re.findall(r"\w+", phrase.lower()))
                if words:
                    out.setdefault(words, set()).add(kind)

        for i, category in enumerate(self.mentions):
            add(self.mentions[category], 2 * i)
            add(self.not_mentions.get(category, []), 2 * i + 1)
        for i, cues in enumerate((self.pre_uncertain, self.pre_negated, self.post_negated, self.post_uncertain, self.stops)):
            add(cues, 2 * len(self.mentions) + i)
        if len(out) > MOST_PHRASES:
            raise ValueError(f"{len(out)} phrases; {MOST_PHRASES} at most")
        return {p: sorted(k) for p, k in sorted(out.items())}


def phrase_lists(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Phrases of each category from files of one phrase a line, named after the category."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("c"), F.trim("value").alias("p"))
    rows = lines.filter("p <> ''").distinct().limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.c, []).append(r.p)
    return out


def phrase_events(words: str, kinds: dict[str, list[int]]) -> str:
    """SQL for every phrase in a word array as (start, end, kinds): one pass, whatever the number of phrases.

    A word that begins no phrase is passed over by a hash lookup. From others the word runs of the phrases'
    lengths are looked up in a table of small maps, one for each checksum, since Spark scans a map from its start.
    """
    firsts = ", ".join(f"'{n}'" for n in sorted({p.split(" ", 1)[0] for p in kinds}))  # words hold no quotes
    lengths = sorted({p.count(" ") + 1 for p in kinds})
    buckets: list[dict[str, list[int]]] = [{} for _ in range(2 * len(kinds))]
    for phrase, k in kinds.items():
        buckets[zlib.crc32(phrase.encode()) % len(buckets)][phrase] = k
    known = f"from_json('{json.dumps(buckets, ensure_ascii=False)}', 'array<map<string, array<int>>>')"
    runs = ", ".join(f"array_join(slice({words}, i + 1, {n}), ' ')" if n > 1 else "word" for n in lengths)
    found = (
        f"transform(array({runs}), (p, n) -> struct(i AS start, i + array({', '.join(map(str, lengths))})[n] AS end,"
        f" {known}[CAST(crc32(encode(p, 'UTF-8')) % {len(buckets)} AS INT)][p] AS kinds))"
    )
    return (
        f"flatten(filter(transform({words}, (word, i) -> IF(word IN ({firsts}), filter({found},"
        f" r -> r.kinds IS NOT NULL AND r.end <= size({words})), NULL)), r -> r IS NOT NULL))"
    )


def label_by_phrases(df: DataFrame, text: str, rules: PhraseRules) -> DataFrame:
    """T16 for phrase files of any size: one column per category, as :func:`label_reports`.

    Sentences become word arrays once; phrases are found in one pass over the words, and every mention is
    judged once, by the cues of its sentence. A category that one of its ``not_mentions`` names is not
    mentioned in that sentence. Null text, no sentence, no phrase: null.
    """
    kinds, n = rules.kinds(), len(rules.mentions)
    if not kinds:
        return df.withColumns({c: F.lit(None).cast("int") for c in rules.mentions})
    pre_uncertain, pre_negated, post_negated, post_uncertain, stop = range(2 * n, 2 * n + 5)
    df = df.withColumn("_words", F.transform(chunks(F.regexp_replace(F.lower(text), r"\s+", " ")), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))))
    # sentences with a phrase: mentions, cues, and the categories that are not meant
    said = f"exists(e.kinds, k -> k < {2 * n} AND k % 2 = 0)"
    parted = (
        f"transform(filter(transform(_words, w -> {phrase_events('w', kinds)}), s -> size(s) > 0), s -> struct(filter(s, e -> {said}) AS hits,"
        f" filter(s, e -> exists(e.kinds, k -> k >= {2 * n})) AS cues, filter(flatten(s.kinds), k -> k < {2 * n} AND k % 2 = 1) AS dropped))"
    )

    def near(kind: int, before: bool) -> str:
        low, high = ("c.end", "h.start") if before else ("h.end", "c.start")
        between = f"exists(s.cues, t -> array_contains(t.kinds, {stop}) AND t.start >= {low} AND t.end <= {high})"
        return f"exists(s.cues, c -> array_contains(c.kinds, {kind}) AND {high} BETWEEN {low} AND {low} + {int(rules.window)} AND NOT {between})"

    status = (
        f"CASE WHEN size(s.cues) = 0 THEN 3 WHEN {near(pre_uncertain, True)} THEN 2"
        f" WHEN {near(pre_negated, True)} OR {near(post_negated, False)} THEN 1 WHEN {near(post_uncertain, False)} THEN 2 ELSE 3 END"
    )
    # category and status of each mention in one number, judged once however many categories share it
    judged = (
        f"flatten(transform(_found, s -> flatten(transform(s.hits, h -> transform(array({status}), mark ->"
        f" transform(filter(h.kinds, k -> k < {2 * n} AND k % 2 = 0 AND NOT array_contains(s.dropped, k + 1)), k -> 2 * k + mark))[0]))))"
    )
    df = df.withColumn("_found", F.expr(parted)).withColumn("_marks", F.expr(judged))
    best = {c: F.expr(f"array_max(filter(_marks, m -> m div 4 = {i})) % 4") for i, c in enumerate(rules.mentions)}
    marks = {c: F.when(b == 3, 1).when(b == 2, -1).when(b == 1, 0) for c, b in best.items()}
    return df.withColumns(marks).drop("_words", "_found", "_marks")
