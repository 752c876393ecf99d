"""Passages repeated across documents, found by difference-cover anchors.

A passage of ``window`` words is repeated if it also starts in a document with a
smaller id.  A set C of residues modulo a period P is a difference cover if every
difference modulo P is a difference of two of its members.  Two equal windows then
hold a pair of equal, aligned anchors: runs of ``window - P + 1`` words that start at
word positions with a residue in C, at the same distance from the start of either
window.  So only anchors are hashed and counted over the corpus; where an anchor
occurs in two documents, it is extended to all windows around it, and only those
windows are compared over the corpus.  A shared anchor only proposes; windows are equal if
two independent hashes of 64 bits are, made of two independent hashes of their words, so
unequal windows do not meet at any size of a corpus.

Documents are dealt to units by a hash of their id.  A unit sends each of its anchor
or window hashes once, packed by hash bucket, so a passage in a third of all rows
costs one entry per unit and no task ever holds the occurrences of a passage.

Defined cases: a null text has no words; a document shorter than the window keeps all;
a repeat inside one document, or in two rows of one id, is no repeat; a row without an
id is neither compared nor changed; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm.hashing import hashed_words, rows_of_words, window_hashes

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)

_NO_DOC = np.iinfo(np.int64).max


def is_difference_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _unit(table: pa.Table, size: int, second: bool = False):
    """(window hashes, row of each, position in the row's words) of all windows inside rows that have an id."""
    words, bounds = hashed_words(table.column("text"), second=second)
    hashes = window_hashes(words, size, second)
    rows = rows_of_words(bounds)
    inside = rows[: len(hashes)] == rows[size - 1 : size - 1 + len(hashes)]
    inside &= ~table.column("doc_id").is_null().to_numpy(zero_copy_only=False)[rows[: len(hashes)]]
    at = np.flatnonzero(inside)
    return hashes, rows, at, bounds


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(_NO_DOC).to_numpy()


def _groups(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """A number from 0 for each pair, the same for equal pairs."""
    order = np.lexsort((checks, hashes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    numbers = np.empty(len(order), dtype=np.int64)
    numbers[order] = np.cumsum(new) - 1
    return numbers


def _least(numbers: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Smallest doc of each number."""
    least = np.full(int(numbers.max()) + 1 if len(numbers) else 0, _NO_DOC)
    np.minimum.at(least, numbers, docs)
    return least


def _first_docs(hashes: np.ndarray, docs: np.ndarray):
    """(distinct hashes, smallest and largest doc of each)."""
    if not len(hashes):
        return hashes, docs, docs
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[new], docs[new], docs[np.append(new[1:], len(docs)) - 1]


def _runs(name: str, keys: np.ndarray, **entries: np.ndarray) -> dict[str, pa.Array]:
    """One row per key with the packed values of its entries, in their order."""
    order = np.argsort(keys, kind="stable")
    names, starts = np.unique(keys[order], return_index=True)
    ends = np.append(starts, len(order))[1:]
    packed = {n: values[order] for n, values in entries.items()}
    return {name: pa.array(names, pa.int32())} | {
        n: pa.array([values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for n, values in packed.items()
    }


def _packed(part: int, buckets: int, hashes: np.ndarray, **more: np.ndarray) -> pa.Table:
    """One row per bucket with entries; the hashes of a bucket stay in order."""
    runs = _runs("bucket", ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), hashes=hashes, **more)
    bucket = runs.pop("bucket")
    return pa.table({"bucket": bucket, "part": pa.array(np.full(len(bucket), part), pa.int32()), **runs})


_PACKED = "bucket int, part int, hashes binary, docs binary"
_ANSWERS = "part int, hashes binary"
_PACKED_WINDOWS = "bucket int, part int, hashes binary, checks binary, docs binary"
_ANSWERED_WINDOWS = "part int, hashes binary, checks binary, docs binary"


def _entries(table: pa.Table, name: str, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _parts(table: pa.Table) -> np.ndarray:
    """Part of each entry."""
    return np.repeat(np.array(table.column("part").to_pylist(), np.int64), [len(h) // 8 for h in table.column("hashes").to_pylist()])


def repeated_words(
    docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, units: int | None = None
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): documents without words of repeated windows.

    ``units`` sets how many pieces the corpus is dealt to (default: twice the shuffle
    partitions); one piece of the text and one bucket of hashes must fit in a task.
    """
    if not 1 <= period <= window or not is_difference_cover(cover, period):
        raise ValueError("cover must be a difference cover modulo a period of at most the window")
    anchor = window - period + 1
    chosen = np.zeros(period, dtype=bool)
    chosen[list(cover)] = True
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units or 2 * partitions
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(units)).cast("int").alias("part"),
    ).repartition(partitions, "part")

    def anchors_of(table):
        hashes, rows, at, bounds = _unit(table, anchor)
        at = at[chosen[(at - bounds[rows[at]]) % period]]
        return hashes, rows, at, bounds

    def send_anchors(table: pa.Table) -> pa.Table:
        hashes, rows, at, _ = anchors_of(table)
        found, least, most = _first_docs(hashes[at], _ids(table)[rows[at]])
        return _packed(table.column("part")[0].as_py(), units, found, docs=(least != most).astype(np.int64))

    def shared_anchors(table: pa.Table) -> pa.Table:
        hashes, own = _entries(table, "hashes"), _entries(table, "docs", np.int64)
        values, index, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = (counts > 1) | (np.bincount(index, weights=own, minlength=len(values)) > 0)
        keep = shared[index]
        return pa.table(_runs("part", _parts(table)[keep], hashes=hashes[keep]))

    def send_windows(table: pa.Table, shared: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        if not table.num_rows:
            return _packed(0, units, none, checks=none, docs=none)
        hashes, rows, at, bounds = anchors_of(table)
        known = np.sort(_entries(shared, "hashes"))
        hit = at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]] if len(known) else at[:0]
        # An anchor at word p lies in the windows that start from p - (window - anchor) to p.
        marks = np.zeros(len(rows) + 2, dtype=np.int64)
        np.add.at(marks, np.maximum(hit - (window - anchor), bounds[rows[hit]]), 1)
        np.add.at(marks, hit + 1, -1)
        near = np.cumsum(marks) > 0
        hashes, rows, at, _ = _unit(table, window)
        at = at[near[at]]
        if not len(at):
            return _packed(0, units, none, checks=none, docs=none)
        hashes, checks = hashes[at], _unit(table, window, second=True)[0][at]
        numbers = _groups(hashes, checks)
        least = _least(numbers, _ids(table)[rows[at]])
        one = np.empty(len(least), dtype=np.int64)
        one[numbers] = np.arange(len(numbers))
        return _packed(table.column("part")[0].as_py(), units, hashes[one], checks=checks[one], docs=least)

    def first_elsewhere(table: pa.Table) -> pa.Table:
        hashes, checks, least = _entries(table, "hashes"), _entries(table, "checks"), _entries(table, "docs", np.int64)
        numbers = _groups(hashes, checks)
        first = _least(numbers, least)[numbers]
        keep = first < least
        return pa.table(_runs("part", _parts(table)[keep], hashes=hashes[keep], checks=checks[keep], docs=first[keep]))

    def remove(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
        hashes, rows, at, bounds = _unit(table, window)
        docs_at = _ids(table)[rows[at]]
        hashes, checks = hashes[at], _unit(table, window, second=True)[0][at]
        # Windows of this unit beside those that start in a smaller document of another.
        numbers = _groups(np.append(hashes, _entries(elsewhere, "hashes")), np.append(checks, _entries(elsewhere, "checks")))
        least = _least(numbers, np.append(docs_at, _entries(elsewhere, "docs", np.int64)))
        hit = at[docs_at > least[numbers[: len(at)]]]
        marks = np.zeros(len(rows) + 1, dtype=np.int64)
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + window, -1)
        kept = np.cumsum(marks)[: len(rows)] == 0
        removed = np.concatenate(([0], np.cumsum(~kept)))
        n_removed = removed[bounds[1:]] - removed[bounds[:-1]]
        texts, digests = [], []
        for i, text in enumerate(table.column("text")):
            words = (text.as_py() or "").encode().split()
            if n_removed[i]:
                words = compress(words, kept[bounds[i] : bounds[i + 1]])
            texts.append(b" ".join(words))
            digests.append(hashlib.sha256(texts[-1]).hexdigest())
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(bounds), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
            "kept": pa.array(texts, pa.binary()).cast(pa.string()),
        })

    by_unit = text.groupBy("part")
    shared = by_unit.applyInArrow(send_anchors, _PACKED).groupBy("bucket").applyInArrow(shared_anchors, _ANSWERS)
    windows = by_unit.cogroup(shared.groupBy("part")).applyInArrow(send_windows, _PACKED_WINDOWS)
    elsewhere = windows.groupBy("bucket").applyInArrow(first_elsewhere, _ANSWERED_WINDOWS)
    return by_unit.cogroup(elsewhere.groupBy("part")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
