"""tokenisers and readers chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake.functions.text import tokens

# Parts of a model name, in the order they are looked for.
TOKENISER_BY_PART = [("qwen25vl", "words"), ("qwen2_5_vl", "words"), ("gemma", "words")]

_COUNTERS: dict[str, Callable[[Column], Column]] = {"words": lambda text: F.size(tokens(text))}
_READERS: dict[str, Callable] = {}


def register_counter(part: str, counter: Callable[[Column], Column]) -> None:
    """Use ``counter`` (text column to count column) for model names holding ``part``."""
    _COUNTERS[part] = counter
    TOKENISER_BY_PART.insert(0, (part, part))


def token_counter(model_name: str) -> Callable[[Column], Column]:
    """the token counter for a model, chosen by part of its name."""
    name = model_name.lower()
    for part, counter in TOKENISER_BY_PART:
        if part in name:
            return _COUNTERS[counter]
    raise ValueError(f"no token counter for {model_name!r}")


SLICE = 1 << 18  # characters given to an outside tokeniser at a time, or one text


def _slices(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def outside_counter(load: Callable[[], Callable[[list[str]], Sequence]]) -> Callable[[Column], Column]:
    """a token counter around an outside tokeniser, loaded once per task.

    ``load`` returns the function from a list of texts to their token lists; it runs on the executors. It gets lists of
    bounded characters, since the tokens of an Arrow batch may take many times its bytes.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            counts = []
            for part in _slices(texts):
                found = iter(encode([t for t in part if t is not None]))
                counts += [None if t is None else len(next(found)) for t in part]
            yield pd.Series(counts, dtype="Int32")

    return lambda text: count(text)


def register_reader(part: str, reader: Callable) -> None:
    _READERS[part] = reader


def reader_for(dataset_name: str) -> Callable:
    """the reader for a data set, chosen by part of its name."""
    for part, reader in _READERS.items():
        if part in dataset_name.lower():
            return reader
    raise NotImplementedError(dataset_name)
