"""A wavelet matrix over token ids: bit planes with rank and select."""

from __future__ import annotations

import numpy as np

#: Bits of a plane between two stored ranks.
BLOCK = 512


class WaveletMatrix:
    """Level l holds, for the order of that level, the l-th bit (from the highest) of each id.

    Ids with a 0 there go first on the next level, in order, then those with a 1.
    """

    def __init__(self, length: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.length, self.zeros, self.planes, self.ranks = length, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for shift in range(levels - 1, -1, -1):
            bit = ((ids >> ids.dtype.type(shift)) & ids.dtype.type(1)).view(np.uint8)[:: ids.dtype.itemsize].astype(bool)
            planes.append(np.packbits(bit, bitorder="little").tobytes())
            blocks = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK), dtype=np.uint32) if len(bit) else np.zeros(0, np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(blocks))).astype("<u4").tobytes())
            ids = np.concatenate((low := ids[~bit], ids[bit]))
            zeros.append(len(low))
        return cls(len(ids), zeros, planes, ranks)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.length, bitorder="little").view(bool)

    def _ones(self, level: int, end: int) -> int:
        """Ones among the first ``end`` bits of a plane."""
        block = end // BLOCK
        known = int(np.frombuffer(self.ranks[level], "<u4")[min(block, len(self.ranks[level]) // 4 - 1)])
        tail = np.frombuffer(self.planes[level], np.uint8)[block * BLOCK // 8 : -(-end // 8)]
        return known + int(np.unpackbits(tail, bitorder="little")[: end - block * BLOCK].sum())

    def _bit(self, level: int, at: int) -> int:
        return self.planes[level][at >> 3] >> (at & 7) & 1

    def access(self, at: int) -> int:
        """The id at a position."""
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = 2 * value + bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id among the first ``end`` positions."""
        if value >> len(self.planes):
            return 0
        a, b = self._range(value, end)
        return b - a

    def occurrences(self, value: int) -> np.ndarray:
        """Ascending positions of an id."""
        if value >> len(self.planes):
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(value, self.length))
        for level in range(len(self.planes) - 1, -1, -1):
            bits = self._bits(level)
            if value >> (len(self.planes) - 1 - level) & 1:
                at = np.flatnonzero(bits)[at - self.zeros[level]]
            else:
                at = np.flatnonzero(~bits)[at]
        return at

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        return int(self.occurrences(value)[k])

    def ids(self) -> np.ndarray:
        """All ids in order, rebuilt from the lowest plane up."""
        dtype = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.length, dtype)
        for level in range(len(self.planes) - 1, -1, -1):
            bits = self._bits(level)
            above = np.empty(self.length, dtype)
            above[~bits] = values[: self.zeros[level]]
            above[bits] = values[self.zeros[level] :] | dtype(1 << (len(self.planes) - 1 - level))
            values = above
        return values
