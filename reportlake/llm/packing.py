"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document's ids end in one id of their own. Stretches that fill a window by themselves become windows; what
is left of each document, shorter than a window, is packed in blocks of a bounded number of tokens. In a block, multiway
differencing starts with one partial partition for each remainder (that remainder in one window, the other windows
empty), and merges again and again the two partitions whose windows differ most, largest against smallest, so their
imbalances cancel. The block begins with as many windows as its tokens need at least; whenever a
window would exceed its capacity, the number of windows rises and the block is partitioned anew.

The windows that the rise has added are then dissolved, the emptiest first: their documents are cut to fill the gaps that
the others still have. What is left over, less than a window, goes into the next block. So each task
pads one window, its last, and only the dissolved documents are cut a second time.

Documents are packed where they are read: no shuffle, and a task holds one block. Windows are numbered by
task and place. The numbers repeat as long as the input's rows come in the same order, as from files; write the
result of a shuffle (``session.stage``) before packing it.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.bpe import PIECES, byte_letters
from reportlake.llm.common import whole_text

WINDOW = 1024
END = 0  # the id behind every document
BLOCK_WINDOWS = 64  # windows that a block's tokens fill
PIECES_A_BATCH = 20_000
BLANKS = re.compile(r"\s{20000}")  # runs on which the fast tokenizer's expression gives up


class Tokens:
    """Ids as the tokenizers library gives them without further special tokens.

    The tokenizer file's vocabulary is read as merge ranks, which are its ids, by a faster library; texts with very long runs of
    white space, which that one refuses, go to the tokenizers library itself.
    """

    def __init__(self, definition: str):
        self.definition = definition
        read = json.loads(definition)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("packed", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.plain = None

    def ids(self, text: str) -> np.ndarray:
        if BLANKS.search(text) is None:
            found = self.fast.encode_to_numpy(text, allowed_special=self.special)
        else:
            if self.plain is None:
                from tokenizers import Tokenizer

                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                self.plain = Tokenizer.from_str(self.definition)
                self.plain.no_truncation()
                self.plain.no_padding()
            found = self.plain.encode(text, add_special_tokens=False).ids
        out = np.empty(len(found) + 1, dtype="<u4")
        out[:-1] = found
        out[-1] = END
        return out


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Places of ``sizes`` in so many near-equal windows, by multiway differencing.

    A partial partition is a list of (sum, places) in falling order, its windows that are still empty left out.
    """
    heap = [(-s, n, [(s, [n])]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        one = heapq.heappop(heap)[2]
        two = heapq.heappop(heap)[2]
        # largest against smallest: the last windows of one take the first of two
        free = windows - len(one)
        joined = one + two[:free]
        rest = two[free:]
        for k, (s, places) in enumerate(rest):
            at = len(one) - 1 - k
            joined[at] = (joined[at][0] + s, joined[at][1] + places)
        joined.sort(key=lambda w: -w[0])
        spread = joined[0][0] - (joined[-1][0] if len(joined) == windows else 0)
        heapq.heappush(heap, (-spread, turn, joined))
        turn += 1
    return [places for _, places in heap[0][2]] if heap else []


def partitioned(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows that hold ``capacity`` at most, as few as the differencing allows."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differenced(sizes, windows)
        over = sum(sum(sizes[i] for i in places) > capacity for places in found)
        if not over:
            return found
        windows += max(1, over // 4)


@dataclass(frozen=True)
class Piece:
    """``length`` ids of a document, from ``start`` on."""

    document: int  # place in the task's held documents
    start: int
    length: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.document, self.start, at), Piece(self.document, self.start + at, self.length - at)


def packed_block(pieces: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and less than a window of pieces that are left over."""
    if not pieces:
        return [], []
    windows = sorted(([pieces[i] for i in places] for places in partitioned([p.length for p in pieces], capacity)), key=lambda w: -sum(p.length for p in w))
    full = sum(p.length for p in pieces) // capacity
    kept, loose = windows[:full], [p for w in windows[full:] for p in w]
    gaps = [(capacity - sum(p.length for p in w), n) for n, w in enumerate(kept)]
    loose.sort(key=lambda p: p.length)  # the largest is taken first
    for gap, n in sorted(gaps, reverse=True):
        while gap:
            # a piece that fits whole, else the largest is cut
            fitting = next((i for i in range(len(loose) - 1, -1, -1) if loose[i].length <= gap), None)
            if fitting is not None:
                piece = loose.pop(fitting)
            else:
                piece, rest = loose.pop().cut(gap)
                loose.append(rest)
                loose.sort(key=lambda p: p.length)
            kept[n].append(piece)
            gap -= piece.length
    return kept, loose


@dataclass
class Packer:
    """Packs the documents of one task as they come."""

    window: int = WINDOW
    block_windows: int = BLOCK_WINDOWS
    open: list[Piece] = field(default_factory=list)
    tokens: int = 0

    def add(self, document: int, length: int) -> Iterator[list[Piece]]:
        """Windows that are complete once the document has come."""
        whole = length - length % self.window
        for start in range(0, whole, self.window):
            yield [Piece(document, start, self.window)]
        if length > whole:
            self.open.append(Piece(document, whole, length - whole))
            self.tokens += length - whole
        if self.tokens >= self.block_windows * self.window:
            yield from self.flush()

    def flush(self) -> Iterator[list[Piece]]:
        windows, self.open = packed_block(self.open, self.window)
        self.tokens = sum(p.length for p in self.open)
        yield from windows

    def last(self) -> Iterator[list[Piece]]:
        yield from self.flush()
        if self.open:
            yield self.open
        self.open, self.tokens = [], 0


def packed(docs: DataFrame, definition: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    ``ids`` are little-endian unsigned 32-bit numbers. All windows are full but the last of each task. A null or
    empty text is its closing id alone. A document longer than a window, however long, fills windows of its own; the text is
    tokenised as a whole. Repeated rows and rows with equal or null keys are each packed, told apart by ``sequence_id``
    and ``offset`` only. Empty tables and partitions: no rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = Tokens(definition), Packer(window, block_windows)
        held: dict[int, tuple] = {}  # documents with an open piece
        number, rows = TaskContext.get().partitionId() << 33, []
        n = 0

        def take(windows: Iterator[list[Piece]]) -> None:
            nonlocal number
            for pieces in windows:
                offset = 0
                for p in pieces:
                    name, ids = held[p.document]
                    part = ids[p.start : p.start + p.length].tobytes()
                    rows.append((name, p.start, p.length, part, zlib.crc32(part), len(ids), number, offset))
                    offset += p.length
                number += 1

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for batch in batches:
            for name, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[n] = (name, tokens.ids(body))
                before = packer.tokens
                take(packer.add(n, len(held[n][1])))
                if packer.tokens < before or not packer.open or packer.open[-1].document != n:
                    still = {p.document for p in packer.open}
                    held = {d: x for d, x in held.items() if d in still}
                n += 1
                if len(rows) >= PIECES_A_BATCH:
                    yield out()
        take(packer.last())
        if rows:
            yield out()

    NAMES = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text")).mapInArrow(run, schema)
