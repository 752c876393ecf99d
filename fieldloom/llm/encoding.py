"""Token ids of whole texts by a public tokenizer file.

A text is cut before white space that follows another character, and before ASCII
punctuation, but for the apostrophe, that follows an ASCII letter or digit.  The
tokenizers' own splitting never joins characters across such a place, so the ids of the
pieces, joined, are the ids of the text.  Pieces repeat: they are told apart by a 64-bit
hash, and a bounded memo keeps the ids of each.  A text with white space beyond ASCII or
with an added token's string is one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fieldloom.llm.hashing import byte_values, span_hashes, text_chunks

#: Distinct pieces (20 bytes each), and their ids, that a Python worker remembers; beyond it the memo starts anew.
MEMO_PIECES, MEMO_IDS = 1_000_000, 4_000_000
#: Bytes of text that are cut together, and unknown pieces that are encoded together; both bound a worker's memory.
TOGETHER_BYTES, TOGETHER_PIECES = 1 << 20, 10_000

#: Texts to put after each piece; the first that keeps these pieces apart is used.
_BORDERS, _PROBE = (" \x01", " \x01 "), (" foo", ",", "bar", "\n", "\nFoo", " \n\nfoo's", "9", ".;", " ")
_SPACE, _ALNUM, _PUNCTUATION, _RARE = (np.zeros(256, dtype=bool) for _ in range(4))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
for _c in range(33, 127):
    (_ALNUM if chr(_c).isalnum() else _PUNCTUATION)[_c] = True
_PUNCTUATION[ord("'")] = False
#: First bytes of white space beyond ASCII, separators 28-31 and the border.
_RARE[[1, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER_SPACE = "[\x01\x1c-\x1f\x85\xa0  -     　]"
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other_space = re.compile(_OTHER_SPACE)
        self.border = None
        probe = [self._whole(p) for p in _PROBE]
        for text in _BORDERS:
            ids = self._whole(text)
            self.border = (text, int(ids[-1]), len(ids)) if len(ids) else None
            if self.border and all(map(np.array_equal, np.split(*self._split(list(_PROBE))), probe)):
                break
            self.border = None
        # Pieces that the tokenizer does not tell apart have one key.
        same = [np.array_equal(self._whole(a), self._whole(b)) for a, b in ((" FooX", " foox"), ("\nfoo", " foo"))]
        self.values = byte_values(*same)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # in order; the others belong to them
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _short(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each piece): one text with a border after each piece."""
        if self.border is None:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.concatenate(found), np.array([len(f) for f in found])
        text, last, size = self.border
        ids = self._whole("".join([p + text for p in pieces]))
        ends = np.flatnonzero(ids == last) + 1
        keep = np.ones(len(ids), dtype=bool)
        for back in range(1, size + 1):
            keep[ends - back] = False
        return ids[keep], np.diff(ends, prepend=0) - size

    def _split(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self._short(pieces)
        return ids, np.cumsum(counts)[:-1]

    def _learn(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)))
        self.pool[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(counts) - counts)
        self.lengths = np.insert(self.lengths, at, counts)
        self.used += len(ids)

    def _alone(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that must stay one piece."""
        rows = set()
        rare = np.flatnonzero(_RARE[data])
        for row in np.unique(np.searchsorted(offsets, rare, side="right") - 1).tolist():
            if self.other_space.search(data[offsets[row] : offsets[row + 1]].tobytes().decode()):
                rows.add(row)
        whole = data.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = whole.find(token, at + 1)
        return sorted(rows)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of each row)."""
        space = _SPACE[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | (_PUNCTUATION[data[1:]] & _ALNUM[data[:-1]])
        alone = self._alone(data, offsets)
        for row in alone:
            cut[offsets[row] : offsets[row + 1]] = False
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys, first, index = np.unique(span_hashes(data, starts, ends, self.values), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMO_PIECES or self.used > MEMO_IDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        unknown = np.flatnonzero(~known)
        if len(unknown):
            whole = set(offsets[alone].tolist())
            text = data.tobytes()
            spots = list(zip(starts[first[unknown]].tolist(), ends[first[unknown]].tolist(), strict=True))
            if whole and any(a in whole for a, _ in spots):
                found = [self._whole(text[a:b].decode()) if a in whole else self._short([text[a:b].decode()])[0] for a, b in spots]
                ids, counts = np.concatenate(found), np.array([len(f) for f in found])
            else:
                found = [
                    self._short([text[a:b].decode() for a, b in spots[i : i + TOGETHER_PIECES]]) for i in range(0, len(spots), TOGETHER_PIECES)
                ]
                ids, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            self._learn(keys[unknown], ids, counts)
            at = np.searchsorted(self.keys, keys)
        of_key = self.starts[at], self.lengths[at].astype(np.int64)
        lengths = of_key[1][index]
        ends_of = np.cumsum(lengths)
        places = np.repeat(of_key[0][index] - (ends_of - lengths), lengths) + np.arange(ends_of[-1] if len(ends_of) else 0)
        bounds = np.concatenate(([0], ends_of))[np.searchsorted(starts, offsets)]
        return self.pool[places], bounds

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, as unsigned 32-bit integers; null counts as empty."""
        for _, _, data, offsets in text_chunks(column, TOGETHER_BYTES):
            ids, bounds = self._chunk(data, offsets)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[a:b]


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
