"""Byte-level BPE by a traversal of a trie of distinct words.

A prefix of a word is encoded by its last token and the encoding of what stands before it, so
one token is all the state a trie node needs. A token t that ends at a node is the last token exactly
if t is alone, or if the last token p of what stands before t keeps its border with t: merging
the bytes of p and t as BPE does must give p and t again. The trie is walked depth first with the
states of the path on a stack; words that share a prefix share its states.

Pieces are cut from the text by the published byte-level expression, special tokens first. Each
task keeps a bounded table of encoded pieces, fills it batch by batch with the pieces it has not seen, and
writes a document's ids as the joined bytes of its pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text

# fixed value: the published expression of byte-level pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same for texts without the characters of WIDE, where letters and digits are all that \w holds besides _
NARROW_PIECES = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
WIDE = "[\x1c-\x1f²³¹¼-¾ʰ-\U0010ffff]"
KNOWN = 300_000  # pieces that a task remembers
LONG = 64  # longer pieces are encoded without being remembered


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, definition: dict):
        letters = byte_letters()
        model = definition["model"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.id_of: dict[bytes, int] = {b: i for i, b in self.bytes_of.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair to rank and token
        self.parts: dict[int, tuple[int, int, int]] = {}  # token to its pair and rank
        for rank, (a, b) in enumerate(merges):
            left, right, token = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merged[left, right] = (rank, token)
            self.parts.setdefault(token, (left, right, rank))
        self.special: dict[str, int] = {t["content"]: t["id"] for t in definition.get("added_tokens", [])}
        self.longest = max(map(len, self.id_of))
        self.borders: dict[tuple[int, int], bool] = {}
        self.id_of_byte = {b[0]: i for b, i in self.id_of.items() if len(b) == 1}
        self.proven: set[int] = set()
        self.code_of = {i: i.to_bytes(4, "little") for i in self.bytes_of}

    def keeps_border(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of both tokens gives just these two tokens.

        A merge across the border happens if some pair at it, met while the two tokens are
        being built, ranks before the merges that take its sides away. The tokens are undone
        step by step, the later merge first, and each pair at the border is compared.
        """
        key = (left, right)
        known = self.borders.get(key)
        if known is None:
            known = self.borders[key] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        below = len(self.merged)  # a merge across the border must rank below this to come first
        while True:
            across = self.merged.get((left, right))
            if across is not None and across[0] < below:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # of equal ranks the left place merges first, so the right one is undone first
            if a is None or (b is not None and b[2] >= a[2]):
                right, below = b[0], b[2] + 1  # and a pair at the border stands left of the right token's
            else:
                left, below = a[1], a[2]

    def stands(self, token: int) -> bool:
        """Whether BPE over the token's own bytes gives the token; plain merging, once per token."""
        ids = [self.id_of_byte[b] for b in self.bytes_of[token]]
        while len(ids) > 1:
            best = min((self.merged.get(pair, (len(self.merged), -1)) for pair in zip(ids, ids[1:], strict=False)))
            if best[1] < 0:
                return False
            merged, i = [], 0
            while i < len(ids):
                pair = self.merged.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                hit = pair == best
                merged.append(best[1] if hit else ids[i])
                i += 2 if hit else 1
            ids = merged
        return ids == [token]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words as little-endian 32-bit numbers, by one walk of their trie."""
        out: dict[bytes, bytes] = {}
        token_of, border, proven, longest = self.id_of.get, self.borders.get, self.proven, self.longest
        states: list[int] = []  # last token of each prefix on the current path
        codes: list[bytes] = []  # encoding of each prefix on the path, down to LONG bytes
        before = b""
        for word in sorted(words):  # depth-first order of the trie
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared:], codes[shared:]
            for end in range(shared + 1, len(word) + 1):
                # just one token fits, so the order of trial is free
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    token = token_of(word[start:end])
                    if token is None:
                        continue
                    if start:
                        fits = border((states[start - 1], token))
                        if not (self.keeps_border(states[start - 1], token) if fits is None else fits):
                            continue
                    if token not in proven:
                        if not self.stands(token):
                            del self.id_of[word[start:end]]
                            continue
                        proven.add(token)
                    states.append(token)
                    if end <= LONG:  # deeper, whole encodings of each prefix would be quadratic
                        codes.append(codes[start - 1] + self.code_of[token] if start else self.code_of[token])
                    break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            tail, end = [], len(word)
            while end > LONG:
                tail.append(self.code_of[states[end - 1]])
                end -= len(self.bytes_of[states[end - 1]])
            out[word] = (codes[end - 1] if end else b"") + b"".join(reversed(tail))
            before = word
        return out


class Codec:
    """Encodes and decodes texts; ids travel as the bytes of little-endian 32-bit numbers."""

    def __init__(self, definition: dict):
        self.vocabulary = Vocabulary(definition)
        self.known: dict[str, bytes] = {}
        self.pieces = regex.compile(PIECES).findall
        self.narrow_pieces = re.compile(NARROW_PIECES).findall
        self.wide = re.compile(WIDE).search
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        names = self.vocabulary.bytes_of | {i: s.encode("utf-8") for s, i in self.vocabulary.special.items()}
        self.decoded = [names.get(i, b"") for i in range(max(names) + 1)]

    def _cut(self, text: str) -> list[str]:
        return self.pieces(text) if self.wide(text) else self.narrow_pieces(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list] = []
        for text in texts:
            parts: list = []
            at = 0
            for m in self.special.finditer(text) if self.special else ():
                parts += self._cut(text[at : m.start()])
                parts.append(self.vocabulary.special[m[0]])
                at = m.end()
            parts += self._cut(text[at:] if at else text)
            cut.append(parts)
        if len(self.known) > KNOWN:
            self.known.clear()
        new = {p for parts in cut for p in parts if p not in self.known and isinstance(p, str)}
        coded = self.vocabulary.encode_words([p.encode("utf-8") for p in new])
        fresh = {p: coded[p.encode("utf-8")] for p in new}
        self.known.update(fresh)
        numbers = {i: np.array([i], dtype="<u4").tobytes() for i in self.vocabulary.special.values()}
        known = self.known
        out = [b"".join([known[p] if isinstance(p, str) else numbers[p] for p in parts]) for parts in cut]
        for p in fresh:
            if len(p) > LONG:
                del known[p]
        return out

    def decode(self, ids: bytes) -> str:
        names = self.decoded
        return b"".join([names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def read_definition(path: str) -> str:
    """The tokenizer file as text, read where the job is planned; it has a fixed, small size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, definition: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` with token counts and digests of ids and of the decoded text, and ``ids`` if asked for.

    Columns of these names are replaced. Null counts as empty: no tokens, digests of nothing.
    Repeated rows are each encoded.
    """
    schema = RESULT + (", ids binary" if keep_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(json.loads(definition))
        for batch in batches:
            texts = list(batch)
            rows = []
            for i in range(0, len(texts), 512):  # pieces of so many texts at a time
                for ids in codec.encode(texts[i : i + 512]):
                    back = codec.decode(ids)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest())
                    rows.append((*row, ids) if keep_ids else row)
            yield pd.DataFrame(rows, columns=names)

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*rest, run(whole_text(text)).alias("__encoded")).select(*rest, "__encoded.*")
