"""Collocations against plain counting, with tries that burst and spill all the time."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from reportlake.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, rank long, f long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_counts(rows):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return counts, totals


def brute(rows, least=10, top=2000):
    counts, totals = plain_counts(rows)
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, k = min((int(Fraction(1000000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(best)[:top]):
            out.add((lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def result(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(4)] + ["é", "日本", "a\x00b", "\x1c", "x" * 500]
    out = []
    for i in range(n):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", "\n", "\x0b"]) for _ in range(rng.randrange(0, 120)))
        out.append((body, ["en", "de", None, ""][i % 4]))
    return out + [(None, "en"), ("", "en"), (" \t ", "fr"), ("...", "fr"), ("one", None)]


def test_against_plain_counting(spark, monkeypatch):
    for name, value in {"SLICE": 300, "WAITING": 50, "BURST": 80}.items():
        monkeypatch.setattr(co, name, value)
    rows = texts(1)
    docs = spark.createDataFrame([(i, *r, 7, 8) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    got = co.collocations(docs, held=400, buckets=7)
    want = brute(rows)
    assert result(got) == want and len(want) > 50
    assert result(co.collocations(docs, top=5)) == {r for r in want if r[1] <= 5}
    # repeated rows count each time
    twice = co.collocations(docs.unionByName(docs))
    assert result(twice) == brute(rows + rows)
    assert co.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        co.counted(docs, longest=5)


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(co, "WAITING", 10)
    monkeypatch.setattr(co, "BURST", 20)
    rng = random.Random(3)
    trie, want = co.HatTrie(3), Counter()
    for _ in range(40):
        keys = np.array([(rng.choice([1, 1, 1, 70, 9]) << 42) | (rng.randrange(40) << 21) | rng.randrange(3) for _ in range(50)], np.int64)
        want.update(keys.tolist())
        trie.put(keys)
    assert isinstance(trie.root, co.Node) and any(isinstance(c, co.Node) for c in trie.root.children.values())
    before, got = trie.size(), Counter()
    for keys, counts in trie.spill(before // 2):
        got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert 0 < trie.size() <= before // 2
    # whole subtrees leave: no first word is on both sides
    left = {int(k) >> 42 & 63 for keys, _ in trie.root.entries() for k in keys}
    assert not left & {k >> 42 & 63 for k in got}
    for keys, counts in trie.spill(0):
        got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert got == want and trie.size() == 0


def test_runs_are_sorted_by_words():
    counter = co.Counter(3, 1)
    assert not list(counter.add("en", b"b a c b a. zz a\n" * 5))
    runs = [r for frame in counter.spilled(0) for r in frame.run]
    phrases = [x for run in runs for x in co.pa.ipc.open_stream(run).read_all().column("phrase").to_pylist()]
    assert phrases == sorted(phrases, key=lambda p: p.split(b" ")) and b"b a c" in phrases and b"a zz" not in phrases


def test_many_words_restart_the_numbering(spark, monkeypatch):
    monkeypatch.setattr(co, "BITS", 8)
    monkeypatch.setattr(co, "SLICE", 100)
    rows = [(" ".join(f"w{i % 600}" for i in range(7000)), "en"), ("u v w " * 30, "en")]
    counter, total = co.Counter(3, 5), Counter()
    for frame in [f for text, lang in rows for f in counter.add(lang, text.encode())] + list(counter.spilled(0)):
        for run in frame.run:
            part = co.pa.ipc.open_stream(run).read_all()
            for p, f in zip(part.column("phrase").to_pylist(), part.column("f").to_pylist(), strict=True):
                total[tuple(p.decode().split(" "))] += f
    assert total == plain_counts(rows)[0]["en"]


def test_large_numbers_stay_exact(spark):
    big = 10**14 + 7
    counts = spark.createDataFrame(
        [("en", "a b", 2, big - 2), ("en", "a", 1, big), ("en", "b", 1, big + 5), ("en", None, 0, 3 * big)], co.COUNTS
    )
    (row,) = co.scored(counts).collect()
    assert row.score == (1000000 * (big - 2) ** 2) // (big * (big + 5))
