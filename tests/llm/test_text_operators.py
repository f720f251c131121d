"""Quality rules, near-duplicates, suffix sorting, BPE and Ogg against plain Python."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportlake.llm import bpe, neardup, ogg, quality, suffixes
from reportlake.llm.queries import QUERIES, TOKENIZER

ODD = [None, "", " ", "\n\n", "one", "two words", "word " * 60, "x" * 5000, "é" * 300, "a\x00b\x1cc", "日本 🙂 text", "# $ | <b>"]


def table(spark, texts, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], schema)


def sample(spark, data, n=200):
    return [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(n).collect()]


# quality rules


def base_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


def test_quality_base(spark, data):
    texts = ODD + ["a b c a b c\na b\na b", "x\ny\nx\n \n \n"] + sample(spark, data)
    docs = table(spark, texts)
    rows = quality.measured(docs, quality.references(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_distances(spark):
    rng = random.Random(5)
    common = ["the", "of", "and", "to", "in"]

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("aeionrst") for _ in range(6)) for _ in range(n))

    texts = [prose(300) for _ in range(40)] + [" ".join("#$%&" + str(i) for i in range(300)), " ".join(f"nav{i} |" for i in range(200)), "the " * 20]
    docs = table(spark, texts)
    refs = quality.references(docs)
    rows = {r.doc_id: r for r in quality.measured(docs, refs).collect()}
    assert all(rows[i].kept for i in range(40))
    assert not rows[40].kept and rows[40].class_distance > 0.32 and not rows[41].kept
    assert rows[42].class_distance == 0 and rows[42].word_distance == 0  # too short to be judged
    # counts over all documents
    assert refs.words[quality.ALL][1].sum() == sum(len(t.split()) for t in texts)
    p, q = np.array([3, 1, 0]), np.array([1, 1, 2])
    m = (p / 4 + q / 4) / 2
    want = sum((x / 4 * np.log2(x / 4 / m, where=x > 0, out=np.zeros(3))).sum() for x in (p, q)) / 2
    assert quality.jensen_shannon(p, q) == pytest.approx(want**0.5)


def test_quality_languages_are_bounded(spark):
    rows = [(i, "some words here", f"l{i}" if i < 300 else "en", "s", None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    refs = quality.references(docs)
    assert set(refs.classes) == {quality.ALL, "en"}


def test_quality_empty_and_clashing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, kept string, n_words string")
    refs = quality.references(docs)
    assert quality.measured(docs, refs).count() == 0 and quality.keep_good(docs).columns == docs.columns
    one = spark.createDataFrame([(1, "w " * 60, None, "k", "n")] * 2, "doc_id long, text string, lang string, kept string, n_words string")
    assert quality.measured(one, quality.references(one)).columns.count("kept") == 1


def prose_of(rng, letters, n):
    common = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(6)]
    return [" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(6)) for _ in range(120)) for _ in range(n)]


@pytest.mark.parametrize("english", [10, 4000])
def test_quality_rare_language_has_its_own_reference(spark, english):
    """A verdict depends on the language alone, not on its share, which is far under and over 0.5 % here."""
    rng = random.Random(8)
    greek, few = prose_of(rng, "αβγδεικλνορστ", 20), prose_of(rng, "абвгдеиклмно", 1)
    junk = [" ".join(f"#$%&{i}" for i in range(100))]
    prose = prose_of(rng, "aeionrst", 10)
    texts = [(t, "el") for t in greek + junk] + [(few[0], "ru"), (greek[0], None), (greek[0], "*")]
    texts += [(prose[i % 10], "en") for i in range(english)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    refs = quality.references(docs)
    rows = {r.doc_id: r for r in quality.measured(docs, refs).filter("lang IS NULL OR lang != 'en'").collect()}
    assert len(rows) == 24 and not rows[20].kept and all(rows[i].kept for i in rows if i != 20)
    assert all((rows[i].class_distance, rows[i].word_distance) == (0, 0) for i in (21, 22, 23))  # too little text or no language
    # the distances are those of the language's documents alone
    table, joined = quality._class_table(), "\n".join(t for t, lang in texts if lang == "el").encode()
    pooled = quality.class_counts(joined, table) - quality.class_counts(b"\n" * 20, table)
    own = [quality.class_counts(texts[i][0].encode(), table) for i in range(21)]
    assert all(rows[i].class_distance == quality.jensen_shannon(own[i], pooled - own[i]) for i in range(21))
    assert sorted(quality.keep_good(docs.filter("lang != 'en' OR lang IS NULL")).toPandas()["doc_id"]) == [i for i in range(24) if i != 20]


def test_quality_none_vouches_for_itself(spark):
    """Junk alone in its language, without a language, or among its copies; clean texts in the same places."""
    rng = random.Random(9)
    junk, (rare, other) = " ".join(f"#$%&{i}|" for i in range(1200)), prose_of(rng, "абвгдеиклмно", 2)
    texts = [(t, "en") for t in prose_of(rng, "aeionrst", 30)]
    texts += [(junk, "j1"), (junk, None), *[(junk, "j3")] * 3, (rare, "ru"), (other, None), ("日本語の文章" * 60 + " w" * 50, "ja")]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.measured(docs, quality.references(docs)).collect()}
    assert [i for i in rows if rows[i].neutral_distance > 0.5] == [30, 31, 32, 33, 34] == [i for i in range(37) if not rows[i].kept]
    assert rows[30].class_distance == rows[30].word_distance == 0 and rows[32].class_distance == 0
    # references counted elsewhere are whole: the same text then finds itself there
    alone = docs.filter("doc_id = 30")
    kept = quality.measured(alone, quality.references(alone), counted=False).collect()[0]
    assert (kept.class_distance, kept.word_distance, kept.neutral_distance) == (0, 0, 0)


def divergence(p, q):
    total = lambda x: sum(x.values())
    if not total(p) or not total(q):
        return 0.0
    gap = 0.0
    for k in p.keys() | q.keys():
        a, b = p[k] / total(p), q[k] / total(q)
        gap += sum(x * math.log2(2 * x / (a + b)) / 2 for x in (a, b) if x)
    return max(gap, 0.0) ** 0.5


def kinds_of(text):
    groups = [("space", " \t\n\r\x0b\x0c"), ("stop", ".,;:!?'\"()-"), ("digit", "0123456789")]
    groups += [("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    plain = {c: name for name, chars in groups for c in chars}

    def kind(c):
        n = ord(c)
        if n < 128:
            return plain.get(c, "control" if n < 32 or n == 127 else "symbol")
        return "latin" if n < 0x280 else "two" if n < 0x800 else "three" if n < 0x10000 else "four"

    return Counter(map(kind, text))


def quality_by_force(docs):
    """doc_id to (class, word, neutral distance, kept), by counting everything again for every document."""
    letters = {"lower", "upper", "latin", "two", "three", "four"}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    kinds = {i: kinds_of(t) for i, t, _ in docs}
    words = {i: Counter(re.findall(r"[^\x20\x09-\x0D]+", low(t))) for i, t, _ in docs}
    whole, every, out = defaultdict(Counter), defaultdict(Counter), {}
    for i, _, lang in docs:
        whole[lang].update(kinds[i])
        every[lang].update(words[i])
    fold = lambda c: Counter({k: sum(n for x, n in c.items() if x == k or (k == "letter" and x in letters)) for k in ("letter", "digit", "stop", "symbol", "control")})
    shares = {i: Counter({k: n * 10**6 // max(1, fold(c).total()) for k, n in fold(c).items()}) for i, c in kinds.items()}
    everyone = sum(shares.values(), Counter())
    common = {}
    for lang in whole:
        found = sorted((-n, w) for w, n in every[lang].items() if len(w.encode()) <= 40)
        common[lang] = {w for _, w in found[:150]}
    for i, text, lang in docs:
        rest, said = whole[lang] - kinds[i], every[lang] - words[i]
        shared = {w for w in common[lang] if said[w]}
        share = lambda c: Counter({w: c[w] for w in shared} | {None: sum(c.values()) - sum(c[w] for w in shared)})
        c = divergence(kinds[i], rest) if lang is not None and len(text) >= 200 and rest.total() >= 2000 else 0.0
        w = divergence(share(words[i]), share(said)) if lang is not None and words[i].total() >= 100 and said.total() >= 1000 else 0.0
        others = everyone - shares[i]
        n = divergence(fold(kinds[i]), others) if len(text) >= 200 and others.total() > 19 * 10**6 else 0.0
        out[i] = (c, w, n, not base_measures(text)[5] and c <= 0.32 and w <= 0.52 and n <= 0.5)
    return out


def test_quality_query_against_counting_again(spark, data):
    """The registered query, distances and verdicts of the whole table."""
    docs = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = quality_by_force(docs)
    rows = QUERIES["op2_distribution_divergence"](spark, data).collect()
    assert len(rows) == len(docs) and any(not r.kept and not r.base_failed for r in rows)
    for r in rows:
        assert (r.class_distance, r.word_distance, r.neutral_distance, r.kept) == pytest.approx(want[r.doc_id], abs=1e-9)


# near-duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components_by_force(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(160)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(160)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates(spark, data):
    texts = ODD + near_copies(1, 60, 9) + near_copies(2, 30, 3) + ["Some FIVE word text here", "some five word text HERE", "one", "ONE"]
    texts += sample(spark, data, 120) + ["long " + " ".join(map(str, range(30000)))]
    rows = neardup.linked(table(spark, texts), neardup.Setting(block=7)).collect()
    want = components_by_force(texts)
    assert {r.id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(want))


def test_near_duplicates_keep_one(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (3, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (9, None, "z"), (8, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.id) for r in kept.collect()) == [(-1, "z"), (3, "y"), (3, "y"), (8, "z"), (9, "z")]
    empty = docs.limit(0)
    assert neardup.linked(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_sketch_estimates():
    setting = neardup.Setting(bands=64, rows=8)
    odd = neardup.multipliers(setting)
    rng = np.random.default_rng(3)
    for same, each in ((300, 100), (0, 400), (500, 0), (900, 50)):
        common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (same, each, each))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        wide = [np.frombuffer(neardup.sketch(s, odd), dtype=">u2")[None, :] for s in (x, y)]
        e = neardup.estimates(*wide, np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(e - same / (same + 2 * each)) < 0.09
    assert neardup.chance_matches(np.array([100.0]), np.array([100.0]))[0] < 0.002


# suffix sorting


def strip_by_force(texts, length):
    seen = defaultdict(int)
    raws = [(t or "").encode() for t in texts]
    for t in raws:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] += 1
    out = []
    for t in raws:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("part, chunk", [(2000, 1 << 20), (3, 1500)])
def test_suffixes(spark, data, part, chunk):
    rng = random.Random(3)
    base = [rng.randbytes(400).hex() for _ in range(6)]
    texts = ODD + ["x" * 199, "y" * 200, "z" * 201, "ab" * 5000, "lo " * 90 + "end", None]
    for _ in range(40):
        parts = [rng.randbytes(rng.randrange(5, 300)).hex() for _ in range(3)]
        at = rng.randrange(500)
        parts.insert(rng.randrange(4), rng.choice(base)[at : at + rng.randrange(100, 600)])
        texts.append("é ".join(parts + parts[:1] * (rng.random() < 0.3)))
    texts += texts[20:30] + [texts[35]] * 12 + sample(spark, data, 60)
    out = suffixes.deduplicated(table(spark, texts), suffixes.Setting(part=part, chunk=chunk))
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == dict(enumerate(strip_by_force(texts, 200)))


def test_suffixes_rows_that_repeat(spark):
    long = "abc " * 10 + os.urandom(150).hex()
    rows = [(1, long), (1, long), (None, long), (2, "short"), (2, os.urandom(150).hex())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffixes.deduplicated(docs).collect()) == [(0, 340), (1, 340), (1, 340), (2, 0), (2, 0)]
    assert suffixes.deduplicated(docs.limit(0)).count() == 0


def test_suffixes_many_rows_without_id(spark):
    long = os.urandom(2000).hex()
    docs = spark.range(0, 100_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(long).alias("text"))
    out = suffixes.deduplicated(docs.unionByName(docs.limit(1).select(F.lit(7).alias("doc_id"), F.lit(long[:300] + "z").alias("text"))))
    assert {tuple(r) for r in out.groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()} == {(None, 4000, 4000, 1, 100_000), (7, 301, 300, 1, 1)}


def test_suffixes_polynomial_hashes_that_collide(monkeypatch):
    """Every hash collides: whether neighbours are equal is then decided by their bytes."""
    rng = random.Random(5)
    texts = [("ab" * rng.randrange(120, 400)) + rng.randbytes(120).hex() for _ in range(8)]
    block = pd.DataFrame({"least": 0, "part": 0, "parts": 1, "doc": range(8), "tag": 0, "first": 0, "body": [t.encode() for t in texts]})
    monkeypatch.setattr(suffixes.Hashes, "common", lambda self, x, y, most: np.full(len(x), most, dtype=np.int64))
    monkeypatch.setattr(suffixes, "gram_hashes", lambda h, a, b, s: np.zeros(max(0, b - a - s.gram + 1), dtype=np.uint64))
    found = suffixes.repeated_in_block(block, suffixes.Setting())
    for r in found[found.kind == 0].itertuples():
        for at in range(r.first, r.last + 1):
            piece = texts[r.doc][at : at + 200]
            assert sum(len(re.findall(f"(?={piece})", t)) for t in texts) > 1


def test_suffixes_texts_are_dealt_out_once(spark):
    """The join that fetches bytes for sorting and the one that strips share one shuffle of the texts."""
    rng = random.Random(7)
    same = rng.randbytes(300).hex()
    out = suffixes.deduplicated(table(spark, [same[: rng.randrange(300, 600)] + rng.randbytes(300).hex() for _ in range(40)]))
    assert all(r.n_removed >= 300 for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    # nor are hashes counted by one shuffle and joined by another: what is read again are the segments kept
    assert "SortMergeJoin" not in plan


def edited_passages(rng):
    """Copies of a passage with an edit each, runs of one byte, and a line that returns at uneven distances."""
    base, line = rng.randbytes(400).hex(), rng.randbytes(50).hex()
    texts = []
    for _ in range(60):
        at = rng.randrange(780)
        texts.append(base[:at] + rng.choice("xyz") + base[at + rng.randrange(2) :])
    texts += ["z" * rng.randrange(200, 900) + rng.randbytes(60).hex() for _ in range(8)]
    return texts + ["".join(line + rng.randbytes(rng.randrange(5, 20)).hex() for _ in range(12)) for _ in range(8)]


@pytest.mark.parametrize("part, rows", [(3, 1), (20, 7)])
def test_suffixes_many_different_segments_of_one_hash(monkeypatch, part, rows):
    """Cut in pieces, whatever the batches: fewer rows than strings, and the repeated starts of brute force."""
    texts = [t.encode() for t in edited_passages(random.Random(9))]
    setting = suffixes.Setting(part=part)
    monkeypatch.setattr(suffixes, "PIECES", 50)
    found = [(least, number, 0, first, last, texts[number][first : last + 200]) for each in suffixes.segments(texts, setting) for number, first, last, least in zip(*(x.tolist() for x in each[:4]), strict=True)]
    cut = pd.concat(suffixes.pieces(pd.DataFrame(found, columns=["least", "doc", "tag", "first", "last", "body"]), setting))
    starts = sum(len(t) - 199 for t in texts)
    assert len(cut) < starts / 8
    ranges = [cut[cut.body.isna()]]
    cut = cut[~cut.body.isna()].sort_values(["least", "part", "body"], ignore_index=True)
    out = []

    def heads():
        for known, head in suffixes._classes(cut.iloc[at : at + rows] for at in range(0, len(cut), rows)):
            ranges.append(known)
            yield head

    for blocks in suffixes._blocks(heads(), setting):
        assert all(len(b) <= part for b in blocks if b.parts.max() > 1)
        out += [suffixes.repeated_in_block(b, setting) for b in blocks]
    out = pd.concat(out)
    several = out[out.kind > 0]
    several = several[(several.kind == 1) & several.duplicated(["d1", "d2"], keep=False)]
    got = {(r.doc, p) for x in (*ranges, out[out.kind == 0], several) for r in x.itertuples() for p in range(r.first, r.last + 1)}
    seen = defaultdict(list)
    for number, t in enumerate(texts):
        for p in range(len(t) - 199):
            seen[t[p : p + 200]].append((number, p))
    assert got == {x for places in seen.values() if len(places) > 1 for x in places}


def test_suffixes_near_copies(spark):
    texts = edited_passages(random.Random(11))
    for part in (4, 30):
        out = suffixes.deduplicated(table(spark, texts), suffixes.Setting(part=part))
        assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == dict(enumerate(strip_by_force(texts, 200)))


def test_suffixes_query_against_brute_force(spark, data):
    """The registered query with its own setting over the whole table."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, strip_by_force([d.text for d in docs], 200), strict=True)}
    rows = QUERIES["op8_hash_compared_suffix_sort"](spark, data).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want


def test_merge_sort():
    rng = random.Random(3)
    raw = bytes(rng.choice(b"ab") for _ in range(3000))
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = np.arange(2700)
    bucket = np.sort(np.array([rng.randrange(20) for _ in starts]))
    order = suffixes.merge_sorted(suffixes.Hashes(data), data, starts, bucket, 200)
    for k in range(20):
        at = np.flatnonzero(bucket == k)
        assert [raw[s : s + 200] for s in starts[order[at]]] == sorted(raw[s : s + 200] for s in starts[at])


class Counted:
    """An array that counts what is looked up by index."""

    def __init__(self, values):
        self.values, self.seen = values, 0

    def __getitem__(self, at):
        self.seen += np.size(at)
        return self.values[at]


def test_common_extension_looks_up_little():
    """Equal strings are known by one look at each end, others by one more look for each halving."""
    rng = random.Random(13)
    base = rng.randbytes(300)
    texts = [base[:at] + b"!" + base[at + 1 :] for at in (rng.randrange(300) for _ in range(200))] + [base] * 50
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    x, y = (300 * np.array([rng.randrange(a, b) for _ in range(400)]) for a, b in ((0, 250), (100, 250)))
    hashes = suffixes.Hashes(data)
    hashes.prefix, hashes.inverse = Counted(hashes.prefix), Counted(hashes.inverse)
    for most in (1, 2, 199, 200, 256):
        unlike = data[x[:, None] + np.arange(most)] != data[y[:, None] + np.arange(most)]
        want = np.where(unlike.any(axis=1), unlike.argmax(axis=1), most)
        hashes.prefix.seen = hashes.inverse.seen = 0
        assert hashes.common(x, y, most).tolist() == want.tolist()
        assert hashes.prefix.seen <= 4 * len(x) + 2 * most.bit_length() * (want < most).sum()
        assert hashes.inverse.seen <= 2 * len(x)


def test_merge_sort_compares_once_for_both_runs(monkeypatch):
    """Only right runs look for their places: half a comparison of each element for each halving of a run."""
    rng = random.Random(17)
    raw = bytes(rng.choice(b"ab") for _ in range(1500))
    compared, common = [], suffixes.Hashes.common
    monkeypatch.setattr(suffixes.Hashes, "common", lambda self, x, y, most: compared.append(len(x)) or common(self, x, y, most))
    starts, data = np.array(rng.sample(range(1300), 1000)), np.frombuffer(raw, dtype=np.uint8)
    order = suffixes.merge_sorted(suffixes.Hashes(data), data, starts, np.zeros(1000, dtype=np.int64), 200)
    assert order.tolist() == sorted(range(1000), key=lambda k: raw[starts[k] : starts[k] + 200])
    assert sum(compared) <= 512 * sum(range(1, 11))


# BPE


def test_bpe_equals_library(spark, data):
    rng = random.Random(1)
    texts = [t for t in ODD if t is not None] + ["a<|endoftext|>b <|endoftext|>", "  \n\n x's don't  ", "=-" * 3000, "½² Ⅷ 12345  x y", "あ" * 900]
    texts += ["".join(rng.choice("abcdeht inosr'12.\n") for _ in range(3000)) for _ in range(30)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x400, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(400)) for _ in range(30)]
    texts += sample(spark, data, 60)
    library = Tokenizer.from_file(str(TOKENIZER))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = {r.doc_id: r for r in bpe.encoded(table(spark, [*texts, None]), bpe.read_definition(str(TOKENIZER)), keep_ids=True).collect()}
    for i, ids in enumerate([*want, []]):
        assert np.frombuffer(rows[i].ids, dtype="<u4").tolist() == ids and rows[i].n_tokens == len(ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_small_vocabulary():
    # (b, c) merges before (a, b), so the token abc made of ab and c is never reached
    vocab = {c: i for i, c in enumerate("abc")} | {"bc": 3, "ab": 4, "abc": 5, "aa": 6, "aaaa": 7}
    merges = ["b c", "a b", "ab c", "a a", "aa aa"]
    v = bpe.Vocabulary({"model": {"vocab": vocab, "merges": merges}})
    ids = lambda w: np.frombuffer(v.encode_words([w])[w], dtype="<u4").tolist()
    assert ids(b"abc") == [0, 3] and ids(b"ab") == [4] and ids(b"aaaaaaa") == [7, 6, 0]


# Ogg


def slow_checksum(page):
    c = 0
    for x in page:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@pytest.mark.parametrize("layout", [ogg.Layout(), ogg.Layout(packet=255, streams=3), ogg.Layout(packet=70000, streams=1)])
def test_ogg_round_trip(layout):
    rng = random.Random(2)
    for n in (64, 128, 999, 1000, 1001, 255 * 1000, 64 * 20000):
        samples = rng.randbytes(n)
        data = ogg.stored(samples, layout)
        assert ogg.read_back(data)[0] == samples
        bad = bytearray(data)
        bad[rng.randrange(len(bad))] ^= 1
        with pytest.raises(ValueError):
            ogg.read_back(bytes(bad))
    page = rng.randbytes(300)
    assert ogg.checksum(page) == slow_checksum(page)


def test_ogg_pages_out_of_sequence():
    data = ogg.stored(bytes(300000), ogg.Layout(packet=70000, streams=1))
    starts = [m.start() for m in re.finditer(b"OggS", data)] + [len(data)]
    pages = [data[a:b] for a, b in itertools.pairwise(starts)]
    with pytest.raises(ValueError, match="sequence"):
        ogg.streams_of(b"".join(pages[:2] + pages[3:]))
    with pytest.raises(ValueError, match="end"):
        ogg.streams_of(b"".join(pages[:-1]))


def with_granule(page, granule):
    page = page[:6] + granule.to_bytes(8, "little", signed=True) + page[14:22] + bytes(4) + page[26:]
    return page[:22] + slow_checksum(page).to_bytes(4, "little") + page[26:]


def test_ogg_times_decide_places():
    samples = random.Random(4).randbytes(200_500)
    data = ogg.stored(samples, ogg.Layout(rate=1000, packet=1000, streams=3))
    starts = [m.start() for m in re.finditer(b"OggS\x00[\x00-\x07]", data)] + [len(data)]
    pages = [data[a:b] for a, b in itertools.pairwise(starts)]
    got, told = ogg.read_back(data)
    assert got == samples and told["times"] == [(1 + i % 3, float(i)) for i in range(201)]
    assert len(pages) > 6 and ogg.read_back(b"".join(with_granule(p, int.from_bytes(p[6:14], "little", signed=True)) for p in pages))[0] == samples
    # a page whose checksum is right but whose time is not
    for at in (0, 3, len(pages) - 1):
        true = int.from_bytes(pages[at][6:14], "little", signed=True)
        for wrong in (true - 1, true + 3000, ogg.NO_PACKET_ENDS):
            with pytest.raises(ValueError):
                ogg.read_back(b"".join([*pages[:at], with_granule(pages[at], wrong), *pages[at + 1 :]]))


def test_ogg_columns(spark, data):
    texts = ODD + sample(spark, data, 20)
    for r in ogg.media(table(spark, texts), keep=True).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(r.media)
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.feature.split("/")[3] == f"{len(payload) / 8000:.6f}"
    assert ogg.media(table(spark, []).limit(0)).count() == 0


def test_every_document_has_a_row(spark, data):
    """The queries are run against their SQL or for their columns elsewhere; here, none may lose a row."""
    want = sorted(r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect())
    for name in QUERIES:
        if name.startswith(("op5", "op7")):
            assert sorted(r.doc_id for r in QUERIES[name](spark, data).select("doc_id").collect()) == want


def test_definition_is_read_once():
    assert json.loads(bpe.read_definition(str(TOKENIZER)))["model"]["type"] == "BPE"
