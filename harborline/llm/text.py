"""Words of many texts at once, as arrays: the kernel under the Arrow-based operators.

Texts stay UTF-8 bytes in one buffer. A word is a maximal run of bytes outside a separator set; no
word crosses the end of a text. Hashes are 64-bit: a polynomial over the bytes modulo 2**64, finished
by a bijective mixer, so one pass of prefix sums gives the hash of every word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text handled at a time; a longer single text is handled whole.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that a Python worker's memory does not grow with the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back to the system when it ends: Python workers live on for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, _U)
        step = _U(base)
        while len(have) < n:
            have = np.concatenate([have, have * step])
            with np.errstate(over="ignore"):
                step = step * step
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE, inverse: int = _INVERSE) -> np.ndarray:
    """Hash of values[s:e] for each pair, equal for equal sequences wherever they stand."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of consecutive texts: bytes, text offsets, word offsets, and where each text's words begin."""

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hash((LOWER[self.data] if lower else self.data).astype(_U) + _U(1), self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """Positions at which k words of one text begin."""
        n = len(self.starts)
        ok = np.ones(n, bool)
        for j in range(1, k):
            last = self.first[1:] - j
            ok[last[last >= self.first[:-1]]] = False
        return np.flatnonzero(ok)


def words(data: np.ndarray, texts: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    inside = ~separator[data]
    n = len(data)
    begin, end = inside.copy(), inside.copy()
    if n:
        cut = np.zeros(n + 1, bool)
        cut[texts] = True
        begin[1:] &= ~inside[:-1] | cut[1:n]
        end[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, texts, starts, ends, np.searchsorted(starts, texts))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows of about CHUNK bytes each, with their bytes and offsets from 0."""
    data, offsets = buffers(batch.column(column))
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def per_text(mask: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How many bytes of each text a mask holds."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[texts[1:]] - total[texts[:-1]]


@dataclass
class Lookup:
    """Values by distinct 64-bit keys: an open table of row numbers, so that it is small to send and to keep."""

    slots: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    probes: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Lookup:
        size = 1 << max(4, int(2 * len(keys) - 1).bit_length())
        slots, at = np.full(size, -1, np.int32), (keys & np.uint64(size - 1)).astype(np.int64)
        left, probes = np.arange(len(keys)), 0
        while len(left):
            place = (at[left] + probes) & (size - 1)
            free = slots[place] < 0
            first = np.unique(place[free], return_index=True)[1]
            taken = left[free][first]
            slots[place[free][first]] = taken
            left = np.setdiff1d(left, taken, assume_unique=True)
            probes += 1
        return Lookup(slots, keys, values, probes)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each key, and whether it is there."""
        size = len(self.slots)
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        out, found, left = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.arange(len(keys))
        for j in range(self.probes):
            row = self.slots[(at[left] + j) & (size - 1)]
            full = row >= 0
            hit = full.copy()
            hit[full] = self.keys[row[full]] == keys[left[full]]
            out[left[hit]], found[left[hit]] = row[hit], True
            left = left[full & ~hit]
            if not len(left):
                break
        return out, found
