"""Elias-Fano sequences in flat byte arrays that can be memory-mapped.

An ascending sequence of n numbers below u is kept as n * l low bits, l about log2(u / n), and a bit vector in which the high parts are written
in unary: less than two further bits a number. Numbers are found by bucket (all with the same high part) and bisection of low bits.
"""

from __future__ import annotations

import numpy as np


def pack_bits(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each number, end to end, first bit lowest; 8 bytes of padding."""
    if not width:
        return np.zeros(8, np.uint8)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return np.concatenate([np.packbits(bits.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)])


def read_bits(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers number ``at`` from packed bits of at most 56 bits each."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out |= data[byte + j].astype(np.uint64) << np.uint64(8 * j)
    return (out >> shift) & np.uint64((1 << width) - 1)


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._starts = None

    @classmethod
    def build(cls, values: np.ndarray, bound: int) -> EliasFano:
        """values: ascending uint64 below ``bound``."""
        n = len(values)
        width = min(56, max(0, (int(bound) // max(n, 1)).bit_length() - 1))
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 2 if n else 1), np.uint8)
        bits[ones] = 1
        return cls(n, width, pack_bits(values, width), np.packbits(bits, bitorder="little"))

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high]

    def starts(self) -> np.ndarray:
        """For each high part, how many numbers lie before its bucket (select on the zeros of the bit vector)."""
        if self._starts is None:
            zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
            self._starts = np.minimum(np.concatenate([[0], zeros - np.arange(len(zeros))]), self.n)
        return self._starts

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        high = np.searchsorted(self.starts(), at, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.width)) | read_bits(self.low, at, self.width)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The place of the first number that is not below each value."""
        starts, width = self.starts(), np.uint64(self.width)
        high = np.minimum((values >> width).astype(np.int64), len(starts) - 1)
        low, lo = values & np.uint64((1 << self.width) - 1), starts[high]
        hi = np.where(high + 1 < len(starts), starts[np.minimum(high + 1, len(starts) - 1)], self.n)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            below = read_bits(self.low, mid, self.width) < low[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return lo

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        at = self.successor(values)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.access(inside) == values), at, -1)
