"""Hashed letter n-grams of whole Arrow text columns."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

from fieldloom.llm.hashing import text_chunks

SPACE = 32
_FOLD: list[np.ndarray] = []
_LOOKALIKE: list[np.ndarray] = []

#: Characters that look like Latin letters, and the letters, in the same order.
LOOKALIKES = (
    "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u04bb\u0261\u03bf\u03b1\u03c1\u03bd\u0131\u1d0f\u0442\u043a\u043c\u0432\u043d",
    "aeopcyxijsdhgoapviotkmbh",
)
#: Digits and signs written for letters.
SUBSTITUTES = ("0134578@$!", "oieastbasi")


def folding() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    if not _FOLD:
        table = np.full(sys.maxunicode + 1, SPACE, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (char := chr(c)).isalpha():
                low = char.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def lookalikes() -> np.ndarray:
    """For each code point the folded letter it stands for: full-width forms, look-alikes, or itself."""
    if not _LOOKALIKE:
        table = folding().copy()
        for wide in range(0xFF21, 0xFF5B):
            if chr(wide).isalpha():
                table[wide] = ord(chr(wide - 0xFEE0).lower())
        for seen, meant in zip(*LOOKALIKES, strict=True):
            for form in {seen, seen.upper()}:
                if len(form) == 1:
                    table[ord(form)] = ord(meant)
        _LOOKALIKE.append(table)
    return _LOOKALIKE[0]


def disguised(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fold look-alikes, and digits or signs beside a letter of the same row to the letters they stand for."""
    folded = lookalikes()[codes]
    letter = folded != SPACE
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[starts] = True
    beside = np.zeros(len(codes), dtype=bool)
    beside[1:] = letter[:-1] & ~first[1 : len(codes)]
    beside[:-1] |= letter[1:] & ~first[1 : len(codes)]
    for seen, meant in zip(*SUBSTITUTES, strict=True):
        folded[beside & (codes == ord(seen))] = ord(meant)
    return folded


def letters(data: np.ndarray, offsets: np.ndarray, fold=None) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, row starts): two spaces before each row and after the last, runs of non-letters as one."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    folded = fold(codes, before[:-1]) if fold else folding()[codes]
    space = folded == SPACE
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[before[:-1][before[:-1] < len(folded)]] = True
    before = np.concatenate(([0], np.cumsum(keep)))[before]
    folded = folded[keep]
    rows = len(offsets) - 1
    out = np.full(len(folded) + 2 * rows + 2, SPACE, np.uint32)
    starts = before[:-1] + 2 * np.arange(rows)
    out[np.arange(len(folded)) + 2 * (np.repeat(np.arange(rows), np.diff(before)) + 1)] = folded
    return out, starts


def gram_hashes(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hash of the gram at each place but the last two."""
    n = len(codes) - 2
    h = np.full(n, (size * 0x9E3779B1) & 0xFFFFFFFF, np.uint32)
    for i in range(size):
        h = (h ^ codes[i : n + i]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)


def gram_chunks(column: pa.Array, sizes: tuple[int, ...], bits: int):
    """(rows, list of hashes for each size, row starts, grams of a size and letters of each row)."""
    for first, end, data, offsets in text_chunks(column):
        codes, starts = letters(data, offsets)
        n = len(codes) - 2
        found = np.add.reduceat((codes[:n] != SPACE).astype(np.int64), starts)
        yield end - first, [gram_hashes(codes, s, bits) for s in sizes], starts, np.diff(np.append(starts, n)), found
