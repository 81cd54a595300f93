"""Helpers that several operators share: Arrow slicing, word splitting, 64-bit hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Text bytes that are worked on at once, so that temporary arrays stay small however large a batch is.
SLICE_BYTES = 2 << 20

#: Words of which a task remembers the hashes (about 20 MB).
WORDS_HELD = 100_000

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of ``column`` each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


_held: dict[object, object] = {}
_last_trim = 0.0


def held(key: object, make: Callable[[], object] = object) -> object:
    """What a Python worker keeps from task to task under ``key``: one thing at a time.

    Spark deals tasks of all stages to the same workers, so a table that one stage has built goes as soon as a task asks for another, and memory
    that a task before has left is given back."""
    global _last_trim
    if key not in _held or time.monotonic() - _last_trim > 1:
        if key not in _held:
            _held.clear()
            gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()
        _last_trim = time.monotonic()
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _trim() -> None:
    """Free heap pages go back to the system, where the C library can do that."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def by_length(batch: pa.RecordBatch, column: str, limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` list elements of ``column`` each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


_BLANK, _BLANK_BYTE = re.compile(r"[ \t-\r]"), re.compile(rb"[ \t-\r]")


def pieces(text, blank: re.Pattern, size: int = 1 << 20) -> Iterator:
    """The text (str or bytes) in pieces of about ``size``, cut before white space only, so that the words of a very long text are never all objects at once."""
    at = 0
    while at < len(text):
        cut = blank.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, filled on demand; forgotten when it has grown to ``most`` words."""

    def __init__(self, most: int = WORDS_HELD):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, text: str | None, lower: bool = False) -> np.ndarray:
        """Hashes of the words of a text: maximal runs without the characters 0x20 and 0x09-0x0D."""
        parts = [np.empty(0, np.uint64)]
        for piece in pieces((text or "").encode(), _BLANK_BYTE):
            words = (piece.lower() if lower else piece).split()
            if len(self) > self.most:
                self.clear()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts) if len(parts) != 2 else parts[1]


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every window of ``width`` words; a shorter text has one shingle, an empty text none."""
    n = len(words)
    if not n:
        return words
    size = min(width, n)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        out = mix64(out * _C1 + words[k : n - size + 1 + k])
    return out


_TERM = re.compile(r"[^\W_]+")


class TermHashes(dict):
    """Hashes of normalised words: runs of letters and digits in lower case."""

    def __init__(self, most: int = WORDS_HELD):
        super().__init__()
        self.most = most

    def __missing__(self, term: str) -> int:
        h = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))
        self[term] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        parts = [np.empty(0, np.uint64)]
        for piece in pieces((text or "").lower(), _BLANK):
            terms = _TERM.findall(piece)
            if len(self) > self.most:
                self.clear()
            parts.append(np.fromiter(map(self.__getitem__, terms), np.uint64, len(terms)))
        return np.concatenate(parts) if len(parts) != 2 else parts[1]


def found_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, -1 where it isn't there."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes: sum of the smaller counts over the sum of the larger ones; 0 for two empty ones."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    total = len(a) + len(b) - common
    return common / total if total else 0.0


def add_column(df: DataFrame, text: str, out: str, kind: str, prepare: Callable[[], Callable[[str | None], object]]) -> DataFrame:
    """Adds (or replaces) ``out``, of the SQL type ``kind``: a function of the whole text, made once for each task by ``prepare``."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T._parse_datatype_string(kind))])
    arrow = to_arrow_type(schema[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = prepare()
        for whole in batches:
            for batch in by_bytes(whole, text):
                values = [of(x) for x in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(values, arrow)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)
