"""Words of a column of texts as numbers, for the classifiers: every different word of a batch is looked at once."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are taken at a time.
SLICE_BYTES = 4_000_000
#: What is left out of words: neither letters nor apostrophes.
MARKS = re.compile(r"[^\w'\n]+|[\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def give_back() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The step, after whose last batch the worker gives freed memory back to the machine, since workers outlive a stage."""

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over their range."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Words:
    """Words of a slice of texts: `words`, the different ones; `index`, which one stands at each place; `starts`, where each text's words begin."""

    def __init__(self, texts: pa.Array):
        split = pc.utf8_split_whitespace(texts)
        starts = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        self.starts = starts - starts[0]
        self.words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy().astype(np.int64)
        if "" in self.words:  # leading and trailing white space
            empty = self.words.index("")
            keep = index != empty
            self.starts = np.concatenate([[0], np.cumsum(keep)])[self.starts]
            index = index[keep]
        self.index = index
        self.row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Yield (first row, part) of a string column in slices of at most so many bytes, or one text; nulls as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most)))
        yield at, texts.slice(at, end - at)
        at = end


class Grams:
    """Characters of words in lower case between marks, and hashes of the character n-grams that start at each place."""

    def __init__(self, words: list[str]):
        self.shown = MARKS.sub("", "\n".join(words).lower()).split("\n") if words else []
        self.lettered = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in self.shown], bool)
        joined = "^" + "$^".join(self.shown) + "$" if words else ""
        self.chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.array([len(w) + 2 for w in self.shown], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every n-gram inside a word and its marks."""
        if len(self.chars) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(len(self.chars) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + self.chars[k : len(self.chars) - n + 1 + k]) * MIX
        inside = self.word[: len(h)] == self.word[n - 1 :]
        return self.word[: len(h)][inside], mixed(h[inside])

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first n letters of words that have as many."""
        which = np.flatnonzero(self.size >= n + 2)
        h = np.full(len(which), 1000 + n, np.uint64)
        for k in range(n):
            h = (h + self.chars[self.begin[which] + 1 + k]) * MIX
        return which, mixed(h)

    def whole(self) -> np.ndarray:
        """Hash of each word; the empty word has one too."""
        h = np.zeros(len(self.size), np.uint64)
        if len(self.chars):
            place = np.arange(len(self.chars)) - self.begin[self.word]
            np.add.at(h, self.word, mixed(self.chars * np.uint64(1_000_003) + place.astype(np.uint64)))
        return mixed(h)
