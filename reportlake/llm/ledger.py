"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256). The ledger holds, for each
blob, the rule versions it was scanned with and what they found; a run scans only the pairs of blob
and rule version that the ledger lacks, each distinct blob once however many paths hold it, and
then joins the findings back to all paths. Everything is column expressions.

A rule is a regular expression whose matches are taken leftmost and without overlap. Positions come
from two cuts of the same text by the same expression: the matches, and the pieces between them;
a match starts where the pieces and matches before it end. Positions count code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text
from reportlake.session import stage


@dataclass(frozen=True)
class Rule:
    """``hints``: texts without any of these have no match, which is found faster than by the expression."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0  # the group whose length counts
    least: int = 1  # characters that the group must have
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values: the expressions of the three base kinds
NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the run after AKIA is taken whole, so a shorter one never matches
HEX = "[0-9a-f]{24,}"
BASE = (
    Rule("assign", ASSIGN, group=2, least=6, hints=(":", "=")),
    Rule("access", ACCESS, hints=("AKIA",)),
    Rule("hex", HEX),
)
RULES = (
    *BASE,
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyJ",)),
    Rule("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)

FINDING = "struct<start:long,rank:int,rule:string,kind:string,end:long>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def blocks(items: Column) -> Column:
    """An array cut in about as many arrays as each has items."""
    n = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda b: F.slice(items, b * width + 1, width))


def running(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's non-negative numbers, what ``join`` makes of 0 and all before it.

    Two levels of blocks, as appending to one long array copies it each time: n items cost n**1.5 steps.
    """

    def before(numbers: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<long>").alias("out"))
        add = lambda seen, x: F.struct(join(seen["at"], x).alias("at"), F.concat(seen["out"], F.array(seen["at"])).alias("out"))
        return F.aggregate(numbers, start, add)

    zero = F.lit(0).cast("long")
    inner = lambda items: F.transform(blocks(items), lambda part: before(part, zero))
    joined = lambda parts: F.zip_with(parts, before(F.transform(parts, lambda p: p["at"]), zero)["out"], lambda p, o: F.transform(p["out"], lambda v: join(v, o)))
    return let(items, lambda bound: let(inner(bound), lambda parts: F.flatten(joined(parts))))


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Array of FINDING for one rule; empty where nothing matches."""
    expression = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, expression, F.lit(0))
    lengths = F.transform(found, F.length)
    if rule.least > 1:
        sizes = F.transform(F.regexp_extract_all(text, expression, F.lit(rule.group)), F.length)
    else:
        sizes = lengths
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    # pieces and matches in turn; the running sum over them gives where each match's piece begins
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), lengths.alias("size"), sizes.alias("counted"))

    def row(x: Column, at: Column) -> Column:
        first = at + x["gap"]
        return F.struct(
            first.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"),
            (first + x["size"]).alias("end"), x["counted"].alias("counted"),
        )

    def placed(steps: Column) -> Column:
        taken = F.transform(steps, lambda x: (x["gap"] + x["size"]).cast("long"))
        rows = F.filter(F.zip_with(steps, running(taken, lambda a, b: a + b), row), lambda x: x["counted"] >= rule.least)
        return F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "rule", "kind", "end")])).cast(f"array<{FINDING}>")

    scanned = let(steps, placed)
    possible = text.rlike(rule.pattern)
    for i, hint in enumerate(rule.hints):
        near = F.contains(text, F.lit(hint)) if not i else near | F.contains(text, F.lit(hint))
    if rule.hints:
        possible = near & possible
    return F.when(possible, scanned).otherwise(F.array().cast(f"array<{FINDING}>"))


def addressed(versions: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """``versions`` with ``blob`` (SHA-256 of the UTF-8 content) and ``__row``, a hash of the keys."""
    return versions.withColumn("blob", F.sha2(whole_text(content), 256)).withColumn("__row", F.xxhash64(*keys))


def scanned(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, content: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """New ledger rows: (blob, rules array<string>, findings array).

    Null contents count as empty. Of rows with equal content one is scanned, that with the
    smallest key hash; rows that repeat its key are equal and counted once. A ledger with
    all pairs, or an empty table, gives no rows. Only ``content`` and ``keys`` are read.
    """
    rows = addressed(versions.select(*{content, *keys}), content, keys)
    wanted = rows.groupBy("blob").agg(F.min("__row").alias("__row"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        wanted = wanted.withColumn("todo", names)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        left = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        wanted = wanted.join(seen, "blob", "left").withColumn("todo", left).filter(F.size("todo") > 0).drop("seen")
    texts = rows.select("blob", "__row", whole_text(content).alias("__text"))
    open_pairs = texts.join(wanted.hint("shuffle_hash"), ["blob", "__row"])
    none = F.array().cast(f"array<{FINDING}>")
    found = [F.when(F.array_contains("todo", r.name), matches(F.col("__text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    out = open_pairs.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("findings"))
    return out.dropDuplicates(["blob"])


def by_path(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, content: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``findings`` (sorted by start, then by the order of ``rules``) of every row of ``versions``."""
    current = F.array(*[F.lit(r.name) for r in rules])
    hits = ledger.filter(F.size("findings") > 0).select("blob", F.explode_outer("findings").alias("hit"))
    hits = hits.filter(F.array_contains(current, F.col("hit")["rule"]))
    per_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_list("hit")).alias("findings"))
    rows = addressed(versions.select(*{content, *keys}), content, keys).select(*keys, "blob")
    return rows.join(per_blob, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")))


def secrets(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, content: str = "text", keys: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the ledger to keep: the old rows and those of this run."""
    new = stage(scanned(versions, ledger, rules, content, keys), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return by_path(versions, whole, rules, content, keys), whole


def spans(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query from ``findings``."""
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every found secret replaced by ``[kind]``; other columns as they came.

    Overlapping spans are masked as one, under the kind that starts first. Null texts stay null.
    """
    marked = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    text = F.col(place["text"])
    ledger = stage(scanned(marked, None, RULES, place["text"], [place["doc_id"]]), "ledger")
    hits = ledger.filter(F.size("findings") > 0).select("blob", F.array_sort("findings").alias("findings"))
    source = F.col(place["text"])

    def cut(whole: Column, start: Column, end: Column) -> Column:
        return F.substring(whole, (start + 1).cast("int"), (end - start).cast("int"))

    def cleaned(spans: Column) -> Column:
        """Pieces before each span that begins behind all earlier ones; a block of spans is cut from its own part of the text."""

        def block(part: Column) -> Column:
            first = F.get(part, F.lit(0))["at"]
            own = cut(source, first, F.element_at(part, -1)["start"])
            return let(own, lambda t: F.array_join(F.transform(part, lambda x: F.concat(cut(t, x["at"] - first, x["start"] - first), F.lit("["), x["kind"], F.lit("]"))), ""))

        return F.array_join(F.transform(blocks(spans), block), "")

    def clean(found: Column) -> Column:
        ends = F.transform(found, lambda x: x["end"])
        with_at = F.zip_with(found, running(ends, F.greatest), lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at")))
        tail = cut(source, F.array_max(ends), F.length(text).cast("long"))
        return F.concat(let(F.filter(with_at, lambda x: x["start"] >= x["at"]), cleaned), tail)

    rows = marked.withColumn("blob", F.sha2(whole_text(place["text"]), 256)).join(hits, "blob", "left")
    rows = rows.withColumn("__clean", F.when(F.col("findings").isNotNull(), clean(F.col("findings"))))
    changed = {"text": F.coalesce("__clean", text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("__clean").cast(docs.schema["n_chars"].dataType), F.col(place["n_chars"]))
    return rows.select(*[changed.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])


def oracle() -> str:
    """DuckDB SQL for the digest columns."""
    kinds = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{pattern}') AS m,"
            f" regexp_extract_all(text, '{pattern}', {r.group}) AS c, string_split_regex(text, '{pattern}') AS g FROM t"
        )
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS ({' UNION ALL '.join(kinds)}),"
        " i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),"
        f" h AS (SELECT doc_id, rank, kind, CAST({total.format('g[1:i]')} + {total.format('m[1:i-1]')} AS BIGINT) AS s, length(m[i]) AS n FROM i WHERE length(c[i]) >= least),"
        f" a AS (SELECT doc_id, {counts}, {joined.format(f' FILTER (rank < {len(BASE)})')} AS base, {joined.format('')} AS spans"
        " FROM (SELECT *, s + n AS e FROM h) GROUP BY doc_id)"
        f" SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans"
        " FROM (SELECT doc_id FROM t) LEFT JOIN a USING (doc_id)"
    )
