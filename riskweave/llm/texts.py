"""Vectorised splitting of Arrow text columns into words, a bounded number of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words. All bytes of a multi-byte character are 128 or above, so classes of single bytes are classes of characters.
NOT_SPACE = _table(lambda b: not (b == 32 or 9 <= b <= 13))
ALNUM = _table(lambda b: b >= 128 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    """Words of several texts: text i has the words from ``first[i]`` to before ``first[i + 1]``."""

    first: np.ndarray
    array: pa.Array

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """A number per word, and the distinct words in order of those numbers."""
        d = self.array.dictionary_encode()
        return d.indices.to_numpy(), d.dictionary.to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``most`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    offsets, _ = raw(column)
    return np.diff(offsets)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return o - o[0], d


def words(column: pa.Array, word_bytes: np.ndarray, lower: bool = True) -> Words:
    """Splits each text into longest runs of ``word_bytes``; A-Z alone are lower-cased."""
    o, d = raw(column)
    if not len(d):
        return Words(np.zeros(len(o), np.int64), pa.array([], pa.large_binary()))
    inside = word_bytes[d]
    begins = np.zeros(len(d) + 1, bool)
    begins[o] = True
    before = np.empty(len(d), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.empty(len(d), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    kept = d[inside]
    if lower:
        kept = LOWER[kept]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))])
    return Words(np.searchsorted(starts, o).astype(np.int64), array)


def hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    """64 bits of hash for each distinct word, the same in every task."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in distinct), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 64-bit numbers one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per text."""
    c = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def maxima(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    """Largest value per text, or ``empty``."""
    out = np.full(len(first) - 1, empty, np.float64)
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, first[:-1][some])
    return out
