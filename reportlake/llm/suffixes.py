"""Repeated byte strings across documents, by suffix sorting in blocks.

A byte goes if a ``length``-byte string over it starts anywhere else too. Sorting every suffix of the
corpus would shuffle many times the input, so suffixes are first routed by content:

1. Each string start is assigned the smallest hash of the ``gram``-byte strings inside its window.
   Neighbouring starts mostly share it; a maximal run of them is a segment. Equal strings have equal
   smallest hashes, so they lie in segments of one hash, wherever these begin.
2. Segments whose hash occurs once hold nothing repeated. Segments that are equal as a whole, by a 128-bit
   BLAKE2 digest, are repeated as a whole. Where segments of a hash differ, at the edges of repeated passages, one of
   each kind goes on with its bytes. Segments are dealt by their hash once, and all this is judged there.
3. Segments of a hash meet in a block. Its suffixes are put in buckets by their place relative to
   the hashed gram (equal strings share it) and each bucket is merge-sorted. A comparison finds the
   common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours
   with ``length`` common bytes are equal; their bytes are compared to rule out a collision.
4. Segments of a hash that has many are cut once more, by ranges of that place. All strings of a piece share
   its middle, and equal strings lie in pieces of one middle, so these meet by hash and middle. Pieces of the same
   bytes are repeated as a whole, and one of them is sorted.
5. Where still too many pieces of one middle differ, they are sorted in several blocks. Each block sends one row for
   every class of equal suffixes, by a 128-bit BLAKE2 digest, and classes that meet are repeated.

A row is told apart by its address, the two halves of the MD5 of its id and text (columns ``doc``, ``tag``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text
from reportlake.session import stage

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 2**64)
NO_ID = -(2**63)


@dataclass(frozen=True)
class Setting:
    length: int = 200
    gram: int = 48
    chunk: int = 1 << 20  # bytes hashed at a time
    part: int = 512  # segments of one hash that a block takes; more are cut in pieces, so that no passage keeps one task
    segment: int = 512  # bytes of a segment beyond which a block takes fewer of them
    wide: int = 32  # places of the gram that a piece covers

    @property
    def window(self) -> int:
        """Grams in a string."""
        return self.length - self.gram + 1


def digests(pieces: Iterator[bytes]) -> np.ndarray:
    """128-bit digests of byte strings, as rows of two numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in pieces), dtype=np.int64).reshape(-1, 2)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    out = np.ones(max(n, 1), dtype=U)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(step)
        done, step = done + more, step * step % 2**64
    return out


class Hashes:
    """Prefix polynomial hashes of a buffer; arithmetic is modulo 2**64."""

    def __init__(self, data: np.ndarray):
        letters = np.random.default_rng(11).integers(1, 2**63, 256, dtype=U) | U(1)
        self.inverse = powers(INVERSE, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=U)
        self.prefix[1:] = powers(BASE, len(data))[: len(data)]
        for at in range(0, len(data), 1 << 18):  # in place, so that a large buffer needs no more arrays
            self.prefix[at + 1 : at + 1 + (1 << 18)] *= letters[data[at : at + (1 << 18)]]
        np.cumsum(self.prefix, out=self.prefix)

    def common(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Common extension of the suffixes at x and y, up to ``most`` bytes, by binary search where they are not equal."""
        out = np.full(len(x), most, dtype=np.int64)
        ends = [(self.prefix[at], self.inverse[at], at) for at in (x, y)]

        def same(size: np.ndarray | int) -> np.ndarray:
            one, other = ((self.prefix[at + size] - begin) * inverse for begin, inverse, at in ends)
            return one == other

        differ = np.flatnonzero(~same(most))
        ends = [tuple(each[differ] for each in end) for end in ends]
        low, span = np.zeros(len(differ), dtype=np.int64), most  # low to low + span - 1 bytes are common
        while span > 1:
            low, span = low + same(low + span // 2) * (span // 2), span - span // 2
        out[differ] = low
        return out


def merge_sorted(hashes: Hashes, data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Order of ``starts`` (sorted by bucket already) by suffix within each bucket: bottom-up mergesort.

    All merges of a level run together: an element of a right run finds the number of elements of the left run
    that go before it by a binary search with suffix comparisons, and the left run fills the places between.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, n))
    local = np.arange(n) - np.repeat(first, sizes)

    def less_or_equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = hashes.common(x, y, length)
        at = np.minimum(same, length - 1)
        return (same >= length) | (data[x + at] < data[y + at])

    run = 1
    while n and run < sizes.max():
        right = np.flatnonzero(local & run)
        left = right - (local[right] & (2 * run - 1))  # where the run before begins, which is a whole one
        now = starts[order]
        mine = now[right]
        low, span = np.zeros(len(right), dtype=np.int64), run + 1  # low to low + span - 1 elements go before
        while span > 1:
            # an element of the right run goes behind equal ones of the left run
            goes_on = less_or_equal(now[left + low + span // 2 - 1], mine)
            low, span = low + goes_on * (span // 2), span - span // 2
        place = left + low + (local[right] & (run - 1))
        stays, free = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        stays[right] = free[place] = False
        merged = np.empty_like(order)
        merged[place], merged[free] = order[right], order[stays]
        order = merged
        run *= 2
    return order


def gram_hashes(hashes: Hashes, begin: int, end: int, setting: Setting) -> np.ndarray:
    """Hash of the gram at each place of data[begin:end], mixed so that its order says nothing about the text."""
    last = max(begin, end - setting.gram + 1)
    g = (hashes.prefix[begin + setting.gram : last + setting.gram] - hashes.prefix[begin:last]) * hashes.inverse[begin:last]
    g = (g ^ (g >> U(31))) * U(0xBF58476D1CE4E5B9)
    return g ^ (g >> U(29))


def least_in_windows(g: np.ndarray, window: int) -> np.ndarray:
    size = 1
    while size * 2 <= window:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    rest = window - size
    return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def chunks(texts: list[bytes], setting: Setting) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of about ``chunk`` bytes and their pieces (text, offset in the text, place in the buffer, size).

    A long text is cut with an overlap of ``length - 1`` bytes, so each string start is in just one piece.
    """
    held, pieces, size = [], [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - setting.length + 1), setting.chunk):
            piece = text[offset : offset + setting.chunk + setting.length - 1]
            if len(piece) < setting.length:
                continue
            held.append(piece)
            pieces.append((number, offset, size, len(piece)))
            size += len(piece)
            if size >= setting.chunk:
                yield b"".join(held), pieces
                held, pieces, size = [], [], 0
    if held:
        yield b"".join(held), pieces


def segments(texts: list[bytes], setting: Setting) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first start, last start, smallest hash, digest of the whole segment, whether it holds its gram twice) of all segments."""
    for buffer, pieces in chunks(texts, setting):
        data = np.frombuffer(buffer, dtype=np.uint8)
        grams = gram_hashes(Hashes(data), 0, len(data), setting)
        least = least_in_windows(grams, setting.window)
        number, offset, place, size = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
        count = size - setting.length + 1  # starts of each piece
        piece = np.repeat(np.arange(len(pieces)), count)
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + place[piece]
        values = least[starts]
        turn = np.flatnonzero((np.diff(values.view(np.int64), prepend=0) != 0) | (np.diff(piece, prepend=-1) != 0))
        last = np.append(turn[1:], len(starts)) - 1
        whole = digests(buffer[a : b + setting.length] for a, b in zip(starts[turn].tolist(), starts[last].tolist(), strict=True))
        twice = held_twice(grams, least, starts[turn], starts[last], values[turn], setting.window)
        shift = (offset - place)[piece[turn]]
        yield number[piece[turn]], starts[turn] + shift, starts[last] + shift, values[turn].view(np.int64), whole, twice


def held_twice(grams: np.ndarray, least: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray, window: int) -> np.ndarray:
    """Whether a segment's smallest hash stands at two places of it, so that it may repeat itself."""
    # a gram is the smallest of some window if it equals the largest of the windows' smallest ones
    padded = np.concatenate([np.zeros(window - 1, dtype=U), least, np.zeros(window - 1, dtype=U)])
    at = np.flatnonzero(~least_in_windows(~padded, window) == grams)
    names, which = np.unique(grams[at], return_inverse=True)
    wide = len(grams) + 1
    keys = np.sort(which * wide + at)
    own = np.searchsorted(names, values) * wide
    return np.searchsorted(keys, own + last + window - 1, side="right") - np.searchsorted(keys, own + first) > 1


def strings(bodies: list[bytes], least: np.ndarray, setting: Setting) -> tuple:
    """Of segments end to end: buffer, hashes, place of each; of their strings: segment, start, place of the hashed gram in it."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    buffer = b"".join(bodies)
    data = np.frombuffer(buffer, dtype=np.uint8)
    hashes = Hashes(data)
    place = np.cumsum(sizes) - sizes
    count = sizes - setting.length + 1
    row = np.repeat(np.arange(len(bodies)), count)
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + place[row]
    grams = []
    for at in range(0, len(data), 1 << 18):
        g = gram_hashes(hashes, at, min(len(data), at + (1 << 18) + setting.gram - 1), setting).view(np.int64)
        own = np.searchsorted(place, np.arange(at, at + len(g)), side="right") - 1
        grams.append(at + np.flatnonzero(g == least[own]))
    grams = np.concatenate(grams)
    return buffer, hashes, place, row, starts, grams[np.searchsorted(grams, starts)] - starts


def pieces(block: pd.DataFrame, setting: Setting) -> Iterator[pd.DataFrame]:
    """Segments (least, doc, tag, first, body) cut by ranges of the gram's place; ``part`` names range and shared middle.

    Of pieces of the same bytes one goes on; all are told as ranges, which have no body and are dealt by their row.
    """
    leasts, docs, tags, firsts = (block[c].to_numpy() for c in ("least", "doc", "tag", "first"))
    buffer, _, place, row, starts, shift = strings(block["body"].tolist(), leasts, setting)
    level = shift // setting.wide
    turn = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(level, prepend=-1) != 0) | (np.diff(shift, prepend=-5) != -1))
    end = starts[np.append(turn[1:], len(starts)) - 1]
    for at in range(0, len(turn), PIECES):
        x, y = turn[at : at + PIECES], end[at : at + PIECES]
        of, begin = row[x], starts[x]
        middle = begin + shift[x] - level[x] * setting.wide
        named = [xxhash.xxh3_64_intdigest(buffer[m : m + setting.length - setting.wide + 1], seed=k) for m, k in zip(middle.tolist(), level[x].tolist(), strict=True)]
        first, body = firsts[of] + begin - place[of], [buffer[m : n + setting.length] for m, n in zip(begin.tolist(), y.tolist(), strict=True)]
        cut = pd.DataFrame({"least": leasts[of], "part": np.array(named, dtype=U).view(np.int64), "doc": docs[of], "tag": tags[of], "first": first, "last": first + y - begin, "body": body})
        name = ["least", "part", "body"]
        yield cut[~cut.duplicated(name)]
        again = cut.duplicated(name, keep=False).to_numpy()
        told, own = cut[again], of[again]
        goes_on = (np.diff(own, prepend=-1) == 0) & (told["first"] == told["last"].shift(fill_value=-5) + 1).to_numpy()
        ranges = told[~goes_on].assign(last=told["last"].to_numpy()[np.append(~goes_on[1:], True)[: len(told)]], body=None)
        yield ranges.assign(least=ranges["doc"], part=ranges["tag"])


def repeated_in_block(block: pd.DataFrame, setting: Setting) -> pd.DataFrame:
    """Rows of kind 0 (repeated starts first..last), and for groups in several blocks of kind 1 (a
    start that is single here) and 2 (a class that is repeated here), with digests.

    block: (least, part, parts, doc, tag, first, body) of groups (least, part), whole ones where ``parts`` is 1.
    """
    buffer, hashes, place, row, starts, shift = strings(block["body"].tolist(), block["least"].to_numpy(), setting)
    data = np.frombuffer(buffer, dtype=np.uint8)
    group = block.groupby(["least", "part"], sort=False).ngroup().to_numpy()
    # strings of different shifts never meet, so a large block is sorted in turns of bounded size
    turns = -(-len(starts) // SUFFIXES)
    equal = np.zeros(len(starts), dtype=bool)  # to one before it in its bucket
    again = np.zeros(len(starts), dtype=bool)
    for turn in range(turns):
        at = np.flatnonzero(shift % turns == turn)
        bucket = group[row[at]] * setting.length + shift[at]
        by = np.argsort(bucket, kind="stable")
        at, bucket = at[by], bucket[by]
        order = merge_sorted(hashes, data, starts[at], bucket, setting.length)
        at, bucket = at[order], bucket[order]
        near = np.flatnonzero(bucket[1:] == bucket[:-1])
        near = near[hashes.common(starts[at[near]], starts[at[near + 1]], setting.length) >= setting.length]
        for i in range(0, len(near), 1 << 13):  # a hash may collide, so bytes decide
            x, y = at[near[i : i + (1 << 13)]], at[near[i : i + (1 << 13)] + 1]
            wide = np.lib.stride_tricks.sliding_window_view(data, setting.length)
            same = (wide[starts[x]] == wide[starts[y]]).all(axis=1)
            equal[y[same]] = again[y[same]] = again[x[same]] = True

    docs, tags, firsts, parts = (block[c].to_numpy() for c in ("doc", "tag", "first", "parts"))
    own = firsts[row] + starts - place[row]  # place in the text
    # repeated starts as ranges of each row
    hit = np.flatnonzero(again)
    turn = np.flatnonzero((np.diff(own[hit], prepend=-5) != 1) | (np.diff(row[hit], prepend=-1) != 0))
    end = np.append(turn[1:], len(hit)) - 1
    a, b = hit[turn], hit[end] if len(hit) else hit[turn]
    out = [pd.DataFrame({"kind": 0, "doc": docs[row[a]], "tag": tags[row[a]], "first": own[a], "last": own[b], "d1": own[a], "d2": docs[row[a]]})]
    # for groups in several blocks, one row for each class
    open_rows = np.flatnonzero((parts[row] > 1) & ~equal)
    if len(open_rows):
        named = digests(buffer[s : s + setting.length] for s in starts[open_rows].tolist())
        out.append(
            pd.DataFrame(
                {
                    "kind": np.where(again[open_rows], 2, 1), "doc": docs[row[open_rows]], "tag": tags[row[open_rows]],
                    "first": own[open_rows], "last": own[open_rows],
                    "d1": named[:, 0], "d2": named[:, 1],
                }
            )
        )
    return pd.concat(out)


ROWS = "kind int, doc long, tag long, first long, last long, d1 long, d2 long"
NAMES = [part.split()[0] for part in ROWS.split(", ")]
BLOCK = 1 << 20  # bytes of segments that are sorted together, if the groups are small
SUFFIXES = 1 << 18  # suffixes that are sorted at a time
PIECES = 1 << 15  # pieces that are cut at a time
SEGMENTS = 1 << 17  # segments among which a task finds copies before they are dealt out


def copies_here(held: list[pd.DataFrame]) -> pd.DataFrame:
    """Segments with ``state``: 0, 1 (has copies here) or 2 (a copy of one here, which needs no hash and is dealt by its row)."""
    rows = pd.concat(held, ignore_index=True)
    name = ["least", "whole", "whole2"]
    copy = rows.duplicated(name).to_numpy()
    state = rows.duplicated(name, keep=False).to_numpy().astype(np.int8) + copy
    least, whole, whole2 = (np.where(copy, x, rows[c]) for x, c in ((rows["doc"], "least"), (rows["tag"], "whole"), (0, "whole2")))
    return rows.assign(least=least, whole=whole, whole2=whole2, twice=rows["twice"].to_numpy() & ~copy, state=state)


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Of a partition sorted by (least, part, body): ranges of rows that share a body or have none, and one row for each body."""
    head = None  # of the last class, which may go on
    for batch in batches:
        bare = batch["body"].isna().to_numpy()
        rows = batch[~bare] if head is None else pd.concat([head, batch[~bare]], ignore_index=True)
        same = np.zeros(len(rows), dtype=bool)
        same[1:] = True
        for c in ("least", "part", "body"):
            same[1:] &= rows[c].to_numpy()[1:] == rows[c].to_numpy()[:-1]
        shared = same.copy()
        shared[:-1] |= same[1:]
        ranges = pd.concat([rows[shared], batch[bare]])[["doc", "tag", "first", "last"]]
        yield ranges.assign(kind=0, d1=ranges["first"], d2=ranges["doc"])[NAMES], rows[~same].iloc[0 if head is None else 1 :]
        head = rows[~same].iloc[-1:] if len(rows) else None


def _blocks(batches: Iterator[pd.DataFrame], setting: Setting) -> Iterator[list[pd.DataFrame]]:
    """Groups (least, part) of sorted rows, as many as fill a block; a larger one goes on in several, and then ``parts`` is 2."""
    most = setting.part * setting.segment

    def cut(rows: pd.DataFrame, rest: bool, begun: tuple | None) -> tuple[list[pd.DataFrame], pd.DataFrame, tuple | None]:
        keys = rows[["least", "part"]].to_numpy()
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        size = rows["body"].map(len).to_numpy()
        ends = np.cumsum(size)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # of each row's group
        chunk = np.maximum((np.arange(len(rows)) - first) // setting.part, (ends - size - (ends - size)[first]) // most)
        starts = np.flatnonzero(new | (np.diff(chunk, prepend=0) != 0))
        bounds = np.append(starts, len(rows))
        # whether a chunk is not its whole group
        open_ = (chunk[starts] > 0) | np.append(~new[starts[1:]], False)
        if begun is not None and tuple(keys[0]) == begun:
            open_[first[starts] == 0] = True
        done, at = [], 0
        for x, y, several, goes_on in zip(starts.tolist(), bounds[1:].tolist(), open_.tolist(), [*open_[1:].tolist(), True], strict=True):
            if y == len(rows) and not rest:
                break  # the last group may go on
            if several or goes_on or ends[y - 1] - (ends[at - 1] if at else 0) >= BLOCK or y == len(rows):
                done.append(rows.iloc[at:y].assign(parts=1 + several))
                at = y
        return done, rows.iloc[at:], tuple(keys[-1]) if open_[-1] else None

    kept, begun = None, None
    for batch in batches:
        kept = batch if kept is None or not len(kept) else pd.concat([kept, batch], ignore_index=True)
        done = []
        if len(kept):
            done, kept, begun = cut(kept, False, begun)
        yield done
    if kept is not None and len(kept):
        yield cut(kept, True, begun)[0]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, doc, tag, raw): never null; ``doc`` and ``tag`` are the address of the row."""
    number = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID).cast("long"))
    named = docs.select(number.alias("id"), F.encode(whole_text(text), "utf-8").alias("raw"), F.md5(F.concat_ws(":", number.cast("string"), whole_text(text))).alias("m"))
    halves = [F.coalesce(F.conv(F.substring("m", at, 16), 16, -10).cast("long"), F.lit(0).cast("long")).alias(name) for name, at in (("doc", 1), ("tag", 17))]
    return named.select("id", *halves, "raw")


def repeated_starts(docs: DataFrame, setting: Setting = Setting(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tag, first, last): ranges of starts of repeated strings, which may touch, overlap and repeat."""
    rows = _keyed(docs, key, text)  # all columns, so that the texts are dealt out once for this and for ``deduplicated``

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, tags = batch["doc"].to_numpy(), batch["tag"].to_numpy()
            held = []
            for number, first, last, least, whole, twice in segments(batch["raw"].tolist(), setting):
                held.append(pd.DataFrame({"doc": docs[number], "tag": tags[number], "first": first, "last": last, "least": least, "whole": whole[:, 0], "whole2": whole[:, 1], "twice": twice}))
                if sum(map(len, held)) >= SEGMENTS:
                    yield copies_here(held)
                    held = []
            if held:
                yield copies_here(held)

    found = rows.mapInPandas(cut, "doc long, tag long, first int, last int, least long, whole long, whole2 long, twice boolean, state byte")
    of_hash, of_class = Window.partitionBy("least"), Window.partitionBy("least", "whole", "whole2")
    held = found.select("*", F.count("*").over(of_hash).alias("total"), F.max("twice").over(of_hash).alias("any"))
    held = held.filter("total > 1 OR any OR state > 0").drop("total", "any")
    held = held.select("*", F.count("*").over(of_class).alias("copies"), (F.row_number().over(of_class.orderBy("doc", "tag", "first", "last")) == 1).alias("one"))
    # one segment of each class goes on, if its hash has others or it may repeat itself
    size = F.sum(F.when(F.col("one"), F.col("last") - F.col("first") + setting.length)).over(of_hash)
    held = held.select("*", F.sum(F.col("one").cast("long")).over(of_hash).alias("classes"), size.alias("size"))
    goes_on = F.expr("one AND state < 2 AND (classes > 1 OR twice)")
    many = (F.col("classes") > setting.part) | (F.col("size") > setting.part * setting.segment)
    held = held.select("doc", "tag", "first", "last", F.expr("copies > 1 OR state > 0").alias("copied"), F.when(goes_on, F.col("least")).alias("least"), (goes_on & many).alias("many"))
    held = stage(held.filter("copied OR least IS NOT NULL"), "segments")  # written once, as it is read for the copies and for the edges
    as_whole = held.filter("copied").select("doc", "tag", F.col("first").cast("long"), F.col("last").cast("long"))

    edges = held.filter("least IS NOT NULL").groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last", "least", "many")).alias("s"))
    edges = edges.select("doc", "tag", *[F.col(f"s.{c}").alias(c) for c in ("first", "last", "least", "many")])
    bodies = rows.join(edges.hint("shuffle_hash"), ["doc", "tag"])
    names = ["least", "part", "doc", "tag", "first", "last", "body"]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()  # rows of one address, which the join brings to one task, give one body
        for batch in batches:
            out, long, size = [], [], 0
            for doc, tag, raw, firsts, lasts, leasts, several in batch[["doc", "tag", "raw", "first", "last", "least", "many"]].itertuples(index=False):
                if (doc, tag) in seen:
                    continue
                seen.add((doc, tag))
                for first, last, least, many in zip(firsts.tolist(), lasts.tolist(), leasts.tolist(), several.tolist(), strict=True):
                    (long if many else out).append((least, 0, doc, tag, first, last, raw[first : last + setting.length]))
                    size += many * (last - first + setting.length)
                    if size >= BLOCK:
                        yield from pieces(pd.DataFrame(long, columns=names), setting)
                        long, size = [], 0
            if long:
                yield from pieces(pd.DataFrame(long, columns=names), setting)
            yield pd.DataFrame(out, columns=names)

    bodies = bodies.mapInPandas(extract, "least long, part long, doc long, tag long, first long, last long, body binary")
    bodies = bodies.repartition("least", "part").sortWithinPartitions("least", "part", "body")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = []

        def heads() -> Iterator[pd.DataFrame]:
            for known, rows in _classes(batches):
                ranges.append(known)
                yield rows

        for blocks in _blocks(heads(), setting):
            while ranges:
                yield ranges.pop()
            for block in blocks:
                yield repeated_in_block(block, setting)

    sorted_rows = bodies.mapInPandas(sort, ROWS)
    # classes of several blocks meet; a digest has at most one row from each block, a range stands alone
    place = F.struct("kind", "doc", "tag", "first", "last")
    met = sorted_rows.groupBy(F.expr("if(kind = 0, 0, 1)").alias("open"), "d1", "d2").agg(F.count("*").alias("n"), F.collect_list(place).alias("rows"))
    met = met.select("n", F.explode_outer("rows").alias("r")).select("n", "r.*")
    at_edges = met.filter("kind = 0 OR (kind = 1 AND n > 1)").select("doc", "tag", "first", "last")
    return as_whole.unionByName(at_edges)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicated(docs: DataFrame, setting: Setting = Setting(), key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, and ``kept`` (the bytes left) if asked for.

    Null texts count as empty; texts shorter than ``length`` lose nothing. Rows that repeat an id and a text are
    copies of each other, whatever their number. Strings are judged on the input, not on what is left.
    """
    rows = _keyed(docs, key, text)
    ranges = repeated_starts(docs, setting, key, text).groupBy("doc", "tag").agg(F.collect_set(F.struct("first", "last")).alias("s"))
    ranges = ranges.select("doc", "tag", F.col("s.first").alias("first"), F.col("s.last").alias("last"))
    joined = rows.join(ranges.hint("shuffle_hash"), ["doc", "tag"], "left")
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number, raw, firsts, lasts in batch[["id", "raw", "first", "last"]].itertuples(index=False):
                kept, removed, spans = raw, 0, 0
                if firsts is not None:
                    change = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.add.at(change, firsts, 1)
                    np.add.at(change, lasts + setting.length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    removed, spans = int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((None if number == NO_ID else number, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] * keep)))
            yield pd.DataFrame(out, columns=names).astype({key: "Int64"})

    return joined.mapInPandas(strip, f"{key} long, {RESULT}" + (", kept binary" if keep else ""))
