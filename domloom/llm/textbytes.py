"""Vectorised word access to UTF-8 text, shared by the Arrow-based operators.

A *word* is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``.  All of
these separators are ASCII, so working on UTF-8 bytes finds the same words as
working on code points.  Nothing here imports Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LONG = 1024
_BASE = 0x9E3779B97F4A7C15
_POW = np.array([pow(_BASE, i, 2**64) for i in range(_LONG)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (uint64 in, uint64 out)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Block:
    """Some documents of a batch: raw bytes, document offsets and word bounds."""

    __slots__ = ("data", "ends", "first", "offsets", "starts", "word_offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first
        inside = ~_SEP[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        cuts = offsets[:-1]
        before[cuts[cuts < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        ends = offsets[1:]
        after[ends[ends > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Words of document d: word_offsets[d] to word_offsets[d + 1].
        self.word_offsets = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words())

    def count(self, of_byte: np.ndarray) -> np.ndarray:
        """Per document, the number of bytes for which the table of 256 holds."""
        total = np.concatenate(([0], np.cumsum(of_byte[self.data], dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of every word; with lower, of the word with A-Z lowered."""
        data = _LOWER[self.data] if lower else self.data
        return span_hashes(data, self.starts, self.ends)

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of non-empty, disjoint, ascending spans of bytes.

    The work takes some 50 bytes a byte of text, so it goes in chunks of spans.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.cumsum(ends - starts)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(chunk, total[-1], chunk)), [len(starts)])))
    return np.concatenate([_span_hashes(data, starts[i:j], ends[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    where = np.arange(int(lens.sum())) - np.repeat(at, lens)
    values = _BYTE[data[np.repeat(starts, lens) + where]]
    out = np.add.reduceat(values * _POW[where & (_LONG - 1)], at)
    out = mix(out + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(lens > _LONG):  # powers repeat there: hash these apart
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = 1 << 21) -> Iterator[Block]:
    """The documents of a column in blocks of about so many bytes (one document at least)."""
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1), first + 4096)
        yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def grouped_unique(group: np.ndarray, value: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each group (groups ascending): the values, and n_groups + 1 offsets."""
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    g, v = group[order], value[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return v[keep], np.searchsorted(g[keep], np.arange(n_groups + 1))


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(f: Callable) -> Callable:
    """f, a function of batches, that gives freed memory back to the system when a task ends: workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run
