"""Elias-Fano sequences in memory-mapped files.

A monotone sequence of n integers up to u keeps the low ``l = log2(u / n)`` bits of
each value packed one after the other and the high parts in unary, about ``2 + l``
bits a value; a directory adds the ones before each 64-bit word of the unary part.
Nothing is decoded as a whole: ``get`` selects the bit of a place, ``search`` finds
successors by selecting the run of values that share the high part and halving it.
Both take arrays, since requests come in bulk.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

_HEAD = struct.Struct("<QQQQQ")
_U = np.uint64
#: Place of the k-th one of a byte.
_PLACE = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _PLACE[_byte, _k] = _at
STEP = 1 << 17


def _place_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each 64-bit word."""
    raw = np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.cumsum(np.bitwise_count(raw), axis=1, dtype=np.uint8)
    byte = (ones <= k[:, None]).sum(1)
    row = np.arange(len(raw))
    before = np.where(byte > 0, ones[row, byte - 1], 0)
    return 8 * byte + _PLACE[raw[row, byte], k - before]


def encode(values: np.ndarray) -> bytes:
    """values: uint64, ascending (repeats allowed)."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = min(56, max((top // max(n, 1)).bit_length() - 1, 0))
    lows = []
    for a in range(0, n, 1 << 16):  # a multiple of 8 values is a whole number of bytes
        bits = np.unpackbits(values[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lows.append(np.packbits(bits[:, :low], bitorder="little").tobytes())
    packed = b"".join(lows) + bytes(8)
    high = (values >> _U(low)).astype(np.int64)
    bits = np.zeros(-(-((int(high[-1]) if n else 0) + n + 1) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1  # value i is bit high_i + i, after as many zeros as high_i
    unary = np.packbits(bits, bitorder="little")
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(unary.view("<u8")), dtype=np.int64))).astype("<u4")
    return _HEAD.pack(n, top, low, len(packed), len(unary)) + packed + unary.tobytes() + ones.tobytes()


class Sequence:
    """A sequence at a place of a mapped file (or of bytes)."""

    def __init__(self, raw: memoryview | mmap.mmap | bytes, at: int = 0) -> None:
        self.n, self.top, self.low, a, b = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        self.lows = np.ndarray((a - 7,), "<u8", raw, at, (1,))  # the 64 bits from each byte on
        self.bits = np.frombuffer(raw, "<u8", b // 8, at + a)
        self.ones = np.frombuffer(raw, "<u4", b // 8 + 1, at + a + b)
        self.zeros = np.arange(b // 8 + 1) * 64 - self.ones
        self.end = at + a + b + self.ones.nbytes

    def __len__(self) -> int:
        return self.n

    def _lows(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.low
        return self.lows[bit >> 3] >> (bit & 7).astype(np.uint64) & _U((1 << self.low) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place in the unary part of the k-th one, or zero."""
        before, out = self.ones if one else self.zeros, np.empty(len(k), np.int64)
        for a in range(0, len(k), STEP):
            part = k[a : a + STEP]
            word = np.searchsorted(before, part, "right") - 1
            held = self.bits[word] if one else ~self.bits[word]
            out[a : a + STEP] = 64 * word + _place_in_word(held, part - before[word])
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        return (self._select(at, True) - at).astype(np.uint64) << _U(self.low) | self._lows(at)

    def search(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first place in [begin, end) whose value is x or more (end if there is none), and whether it holds x."""
        x = np.asarray(x, np.uint64)
        begin, end = np.broadcast_to(begin, len(x)), np.broadcast_to(self.n if end is None else end, len(x))
        high, own = x >> _U(self.low), x & _U((1 << self.low) - 1)
        inside = high <= _U(self.top >> self.low)
        known = np.where(inside, high, 0).astype(np.int64)
        first = np.zeros(len(x), np.int64)
        later = np.flatnonzero(known > 0)
        first[later] = self._select(known[later] - 1, False) + 1 - known[later]
        last = np.where(inside, self._select(known, False) - known, self.n)
        first = np.clip(np.where(inside, first, self.n), begin, end)
        last = np.clip(last, begin, end)
        a, b = first.copy(), last.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            middle = (a[live] + b[live]) // 2
            less = self._lows(middle) < own[live]
            a[live[less]], b[live[~less]] = middle[less] + 1, middle[~less]
            live = live[a[live] < b[live]]
        hit = a < last
        hit[hit] = self._lows(a[hit]) == own[hit]
        return a, hit

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is absent."""
        at, hit = self.search(x)
        return np.where(hit, at, -1)
