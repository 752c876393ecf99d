"""Hashes of the words and word windows of whole Arrow text columns.

Words are maximal runs of bytes that are not separators.  All separators are ASCII,
so words can be found in the UTF-8 bytes.  A prefix sum of ``value(byte) * base**i``
gives the hash of any span by one subtraction; there is no Python loop over words.
Such sums modulo 2^64 have pairs of unequal strings of 1,024 bytes and more that collide
whatever the base and values are, so longer spans are hashed by BLAKE2b instead.
Hashes are 64 bits wide; equal words always get equal hashes.  A second, independent hash
(``second``) makes 128 bits of two, where unequal spans must be told apart at any size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Longer spans are not hashed by sums.
SUMMED_BYTES = 128

#: Bases of spans of bytes and of windows of words, of the first and the second hash.
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0x94D049BB133111EB
_SECOND_BASE, _SECOND_WORD_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_SECOND_VALUES = mix(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        known = np.full(size, np.uint64(base))
        known[0] = 1
        _POWERS[base] = known = np.cumprod(known)
        if size > 8 * CHUNK_BYTES:  # one huge text: do not keep its table
            del _POWERS[base]
    return known[:n]


def _span_sums(values: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return sums, pow(base, -1, 1 << 64)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, end row, bytes, row offsets) of slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:  # filling copies the texts
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (one more entry than rows)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    closes = ~inside
    closes[cuts] = True
    closes[1:] &= inside[:-1]
    closes[0] = False
    ends = np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)


def byte_values(fold_case: bool = False, one_space: bool = False) -> np.ndarray:
    """The hash value of each byte; A-Z as a-z, or all ASCII white space as one, if wanted."""
    values = (_FOLDED if fold_case else _VALUES).copy()
    if one_space:
        values[_SPACE] = values[32]
    return values


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of the bytes of each span; spans of any length and order."""
    sums, inverse = _span_sums(values[data], _SECOND_BASE if second else _BASE)
    hashes = mix((sums[ends] - sums[starts]) * _powers(inverse, len(data) + 1)[starts])
    long = np.flatnonzero(ends - starts > SUMMED_BYTES)
    if len(long):
        _, first, same = np.unique(values, return_index=True, return_inverse=True)
        alike = data if len(first) == 256 else first.astype(np.uint8)[same][data]
        for i in long.tolist():
            key = b"second" if second else b""
            hashes[i] = int.from_bytes(hashlib.blake2b(alike[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return hashes


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    return span_hashes(data, starts, ends, _FOLDED if fold_case else _VALUES)


def window_hashes(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of every run of ``size`` words, over row borders too."""
    if len(words) < size or size < 1:
        return np.zeros(0, dtype=np.uint64)
    sums, inverse = _span_sums(words, _SECOND_WORD_BASE if second else _WORD_BASE)
    n = len(words) - size + 1
    return mix((sums[size:] - sums[:n]) * _powers(inverse, n))


def rows_of_words(bounds: np.ndarray) -> np.ndarray:
    """Row of each word from the counts of ``word_spans``."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def hashed_words(column: pa.Array, fold_case: bool = False, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the column in order, word bounds of its rows); the second hash tells A-Z from a-z."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in text_chunks(column):
        starts, ends, bounds = word_spans(data, offsets)
        hashes.append(span_hashes(data, starts, ends, _SECOND_VALUES, True) if second else word_hashes(data, starts, ends, fold_case))
        counts.append(np.diff(bounds))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))
