"""Word collocations, counted in HAT-tries.

Every task numbers the words it meets and counts phrases in one trie for each language. A phrase is a packed
number of word ids. A trie starts as one container, a hash table from packed phrase to
count; a container that grows too full bursts into a node whose children part the phrases by their first
word, further down by their second, and so on for as many levels as a phrase has words. When a task holds
too many phrases, it spills the largest whole subtrees: ids become words again, phrases are sorted in the
bytewise order of their words and leave as compressed runs, one for each bucket of the phrase's prefix (its
first two words). Runs of a bucket meet in one group and are merged there; what stays below the wanted
frequency ends there.

A run holds thousands of phrases in one row, so the shuffle carries few rows. A phrase that is frequent
everywhere is one entry in each run, and the phrases of a frequent first word spread by the second.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text
from reportlake.session import stage

ROWS = 2000  # texts that are joined at a time
SLICE = 2 << 20  # bytes of text that are cut into words at a time
WAITING = 1 << 16  # keys that a container gathers before they enter its table
BURST = 1 << 18  # phrases of a container, above which it bursts
HELD = 3_000_000  # phrases that a task holds before it spills
FAN = 64  # children of a node
BITS = 21  # of a word id in a packed phrase
NO_LANGUAGE = "und"

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
BREAKS = b".,;:!?\n\x0b\x0c\r"  # end a piece
TO_PLAIN = bytes.maketrans(UPPER + BREAKS + b"\t", LOWER + b"\n" * len(BREAKS) + b" ")


class Container:
    """Hash table from packed phrase to count; new keys wait until a batch of them is worth a pass."""

    def __init__(self, keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.keys = np.empty(0, np.int64) if keys is None else keys
        self.counts = np.empty(0, np.int64) if counts is None else counts
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def put(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.n_waiting += len(keys)
        if self.n_waiting > max(WAITING, len(self.keys) // 2):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            codes, keys = pd.factorize(np.concatenate([self.keys, *self.waiting]))
            counts = np.bincount(codes[len(self.keys) :], minlength=len(keys)).astype(np.int64)
            counts[: len(self.keys)] += self.counts  # known keys come first and are distinct
            self.keys, self.counts, self.waiting, self.n_waiting = keys, counts, [], 0

    def size(self) -> int:
        return len(self.keys) + self.n_waiting

    def entries(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.settle()
        yield self.keys, self.counts


class Node:
    """Parts phrases by the id of the word at its level."""

    def __init__(self, level: int, longest: int):
        self.level, self.longest = level, longest
        self.shift = BITS * (longest - 1 - level)
        self.children: dict[int, Node | Container] = {}

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        slots = ((keys >> self.shift) & (FAN - 1)).astype(np.uint8)
        order = np.argsort(slots, kind="stable")
        ends = np.cumsum(np.bincount(slots, minlength=FAN))
        for slot in range(FAN):
            at = order[ends[slot - 1] if slot else 0 : ends[slot]]
            if len(at):
                yield slot, at

    def put(self, keys: np.ndarray) -> None:
        for slot, at in self.parts(keys):
            child = self.children.get(slot)
            if child is None:
                child = self.children[slot] = Container()
            child.put(keys[at])
            if isinstance(child, Container) and len(child.keys) > BURST and self.level + 1 < self.longest:
                self.children[slot] = burst(child, self.level + 1, self.longest)

    def size(self) -> int:
        return sum(child.size() for child in self.children.values())

    def entries(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for child in self.children.values():
            yield from child.entries()


def burst(full: Container, level: int, longest: int) -> Node:
    """A node in place of a container that is too full."""
    full.settle()
    node = Node(level, longest)
    for slot, at in node.parts(full.keys):
        node.children[slot] = Container(full.keys[at], full.counts[at])
    return node


class HatTrie:
    """Phrase counts of one language."""

    def __init__(self, longest: int):
        self.longest = longest
        self.root: Node | Container = Container()

    def put(self, keys: np.ndarray) -> None:
        self.root.put(keys)
        if isinstance(self.root, Container) and len(self.root.keys) > BURST:
            self.root = burst(self.root, 0, self.longest)

    def size(self) -> int:
        return self.root.size()

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes whole subtrees out, the largest first, until no more than ``down_to`` phrases are left."""
        if isinstance(self.root, Container):
            taken: list[Node | Container] = [self.root] if self.size() > down_to else []
            self.root = self.root if not taken else Container()
        else:
            taken, left = [], self.size()
            for slot in sorted(self.root.children, key=lambda s: -self.root.children[s].size()):
                if left <= down_to:
                    break
                taken.append(self.root.children.pop(slot))
                left -= taken[-1].size()
        entries = [part for subtree in taken for part in subtree.entries()]
        if entries:
            yield tuple(np.concatenate(x) for x in zip(*entries, strict=True))


class Counter:
    """The tries of one task and the words they number."""

    def __init__(self, longest: int, buckets: int, held: int = HELD):
        self.longest, self.buckets, self.held = longest, buckets, held
        self.tries: dict[str, HatTrie] = {}
        self.forget_words()

    def forget_words(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__

    def add(self, lang: str, text: bytes) -> Iterator[pd.DataFrame]:
        """Counts a text; spilled runs come out."""
        text = text.translate(TO_PLAIN)
        at, pieces, tail, tail_pieces = 0, 0, [], np.empty(0, np.int64)
        while at < len(text):
            end = min(at + SLICE, len(text))
            if end < len(text):  # only between two words
                cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                if cut < 0:
                    cuts = [c for c in (text.find(b" ", end), text.find(b"\n", end)) if c >= 0]
                    cut = min(cuts) if cuts else len(text) - 1
                end = cut + 1
            part = text[at:end]
            at = end
            words = tail + part.split()
            if len(self.ids) + len(words) >= (1 << BITS) - 1:
                yield from self.spilled(0)
            trie = self.tries.get(lang)
            if trie is None:
                trie = self.tries[lang] = HatTrie(self.longest)
            letters = np.frombuffer(part, np.uint8)
            breaks = np.flatnonzero(letters == 10)
            blank = (letters == 32) | (letters == 10)
            starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
            piece = np.concatenate((tail_pieces, pieces + np.searchsorted(breaks, starts)))
            pieces += len(breaks)
            for keys in self.phrases(words, piece, len(tail)):
                trie.put(keys)
            keep = min(self.longest - 1, len(words))
            tail, tail_pieces = words[len(words) - keep :], piece[len(words) - keep :]
            if sum(t.size() for t in self.tries.values()) > self.held:
                yield from self.spilled(self.held // 2)
        if len(self.tries) > 1000:  # so many languages that the tries themselves weigh
            yield from self.spilled(0)

    def phrases(self, words: list[bytes], piece: np.ndarray, known: int) -> Iterator[np.ndarray]:
        """Packed phrases that end behind the first ``known`` words, which were counted before."""
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)) + 1
        for n in range(1, self.longest + 1):
            first = max(0, known - n + 1)  # of the phrases' first words
            last = len(ids) - n + 1
            if last <= first:
                continue
            keys = np.zeros(last - first, np.int64)
            for i in range(n):
                keys |= ids[first + i : last + i] << (BITS * (self.longest - 1 - i))
            yield keys[piece[first:last] == piece[first + n - 1 : last + n - 1]] if n > 1 else keys

    def spilled(self, down_to: int) -> Iterator[pd.DataFrame]:
        names = list(self.ids)
        words = pa.array(names, pa.large_binary())
        hashes = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
        rank = np.empty(len(names) + 1, np.int64)  # bytewise order of the words
        rank[0] = 0
        rank[1 + pc.sort_indices(words).to_numpy()] = np.arange(1, len(names) + 1)
        for lang, trie in list(self.tries.items()):
            for keys, counts in trie.spill(down_to * trie.size() // max(1, sum(t.size() for t in self.tries.values()))):
                rows = list(self.runs(keys, counts, words, hashes, rank))
                yield pd.DataFrame({"lang": lang, "bucket": [r[0] for r in rows], "run": [r[1] for r in rows]})
        if not down_to:
            self.tries.clear()
            self.forget_words()

    def runs(self, keys: np.ndarray, counts: np.ndarray, words: pa.Array, hashes: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """One sorted run for each bucket of the phrases."""
        ids = [(keys >> (BITS * (self.longest - 1 - i))) & ((1 << BITS) - 1) for i in range(self.longest)]
        second = np.where(ids[1] > 0, hashes[ids[1] - 1], 0)
        bucket = (hashes[ids[0] - 1] * 31 + second) % self.buckets
        ranks = np.zeros(len(keys), np.int64)
        for x in ids:
            ranks = (ranks << BITS) | rank[x]
        order = np.argsort(ranks)
        order = order[np.argsort(bucket[order].astype(np.uint16 if self.buckets < 1 << 16 else np.int64), kind="stable")]
        bucket, counts, ids = bucket[order], counts[order], [x[order] for x in ids]
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
        start = 0
        for end in ends:
            phrase = words.take(pa.array(ids[0][start:end] - 1))
            for x in ids[1:]:
                more = x[start:end]
                longer = pc.binary_join_element_wise(phrase, words.take(pa.array(np.maximum(more, 1) - 1)), pa.scalar(b" ", pa.large_binary()))
                phrase = pc.if_else(pa.array(more > 0), longer, phrase)
            yield int(bucket[start]), packed_run(phrase, counts[start:end])
            start = end


def packed_run(phrases: pa.Array, counts: np.ndarray) -> bytes:
    batch = pa.record_batch({"phrase": phrases, "f": pa.array(counts)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


COUNTS = "lang string, phrase string, words int, f long"


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, buckets: int | None = None, held: int = HELD) -> DataFrame:
    """(lang, phrase, words, f) of phrases that occur ``least`` times or more, and rows without a phrase
    whose f sum up to all words of the language.

    ``held`` bounds the phrases in a task's tries, ``buckets`` the groups that merge runs: four for each
    shuffle partition by default. Words A-Z are lower-cased; phrases never cross ``.,;:!?`` or a line end.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have up to 2 or 3 words")
    spark = docs.sparkSession
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(longest, buckets, held)
        out = lambda runs: (pa.RecordBatch.from_pandas(r, schema=RUNS, preserve_index=False) for r in runs)
        parts = (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
        for batch in parts:
            langs = batch.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy()
            for code, name in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pa.array(codes == code)).to_pylist()
                yield from out(counter.add(name, b"\n".join(texts)))
        yield from out(counter.spilled(0))

    def merged(key: tuple, runs: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(run.as_buffer()).read_all() for chunk in runs.column("run").chunks for run in chunk]
        total = pa.concat_tables(parts).combine_chunks().group_by("phrase", use_threads=False).aggregate([("f", "sum")])
        f, words = total.column("f_sum"), pc.add(pc.count_substring(total.column("phrase"), b" "), 1)
        alone = pc.sum(pc.if_else(pc.equal(words, 1), f, 0)).as_py()
        total = pa.table({"phrase": total.column("phrase").cast(pa.large_string()), "words": words.cast(pa.int32()), "f": f})
        total = total.filter(pc.greater_equal(total.column("f"), least))
        phrases = pa.concat_arrays([*total.column("phrase").cast(pa.string()).chunks, pa.array([None], pa.string())])
        n = len(phrases)
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * n, pa.string()),
                "phrase": phrases,
                "words": pa.concat_arrays([*total.column("words").chunks, pa.array([0], pa.int32())]),
                "f": pa.concat_arrays([*total.column("f").chunks, pa.array([alone], pa.int64())]),
            }
        )

    RUNS = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("run", pa.binary())])
    plain = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), whole_text(text).cast("binary").alias("text")
    )
    runs = plain.mapInArrow(count, "lang string, bucket long, run binary")
    return runs.groupBy("lang", "bucket").applyInArrow(merged, COUNTS)


def scored(counts: DataFrame, cover_percent: int = 50) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the candidates among counted phrases, each with the cut that
    scores lowest; candidates inside a longer one with ``cover_percent`` of their frequency are dropped."""
    known = counts.filter("phrase IS NOT NULL")
    candidates = known.filter("words > 1").withColumnRenamed("f", "a")
    # every run of two words or more inside a longer candidate
    inside = F.expr(
        "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, n), ' '))))"
    )
    covers = candidates.filter("words > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("f"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    left = candidates.join(covers, ["lang", "phrase"], "left").filter(f"cover IS NULL OR 100 * cover < {int(cover_percent)} * a").drop("cover")
    cuts = left.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    exact = F.expr("(CAST(a AS DECIMAL(19, 0)) * a * 1000000) div (CAST(l AS DECIMAL(19, 0)) * r)")
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, top: int = 2000, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words): the first ``top`` collocations of every language.

    Null text counts as empty, null language as ``und``. Repeated rows count each time. Ties in the score go
    to the more frequent, then to the bytewise smaller phrase. Texts without words, empty tables: no
    rows. Very long texts are cut between words, and phrases over a cut are counted; a text is held as
    bytes, no more. Columns besides the two named ones are not looked at. The counts are written
    once to the shared folder, as they are joined four times.
    """
    counts = stage(counted(docs, text, lang, longest, least, **settings), "phrases")
    totals = counts.filter("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counts).withColumn("rank", F.row_number().over(order).cast("long")).filter(f"rank <= {int(top)}")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("words").cast("long").alias("words"))


def oracle(longest: int = 3, least: int = 10, top: int = 2000) -> str:
    """The same in SQL, with every phrase as a row."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS words, array_to_string(w[i : i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces)"
        for n in range(1, longest + 1)
    )
    cuts = " UNION ALL ".join(
        f"SELECT lang, phrase, words, a, {k} AS k, array_to_string(string_split(phrase, ' ')[1 : {k}], ' ') AS head,"
        f" array_to_string(string_split(phrase, ' ')[{k + 1} : ], ' ') AS rest FROM kept WHERE words > {k}"
        for k in range(1, longest)
    )
    return f"""
WITH plain AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(text, '{UPPER.decode()}', '{LOWER.decode()}') AS t FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM plain)
), counts AS (
  SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY lang, words, phrase
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, words, f AS a FROM counts WHERE words > 1 AND f >= {least}
), covers AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS cover
  FROM (SELECT lang, a, words, w, m, unnest(range(1, words - m + 2)) AS i
        FROM (SELECT lang, a, words, string_split(phrase, ' ') AS w, unnest(range(2, words)) AS m FROM candidates WHERE words > 2))
  GROUP BY 1, 2
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN covers v ON v.lang = c.lang AND v.phrase = c.phrase WHERE v.cover IS NULL OR 100 * v.cover < 50 * c.a
), cuts AS ({cuts}
), cut_scores AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, l.f AS l, r.f AS r,
    CAST((CAST(c.a AS HUGEINT) * c.a * 1000000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cut_scores
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score, CAST(words AS BIGINT) AS words FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
