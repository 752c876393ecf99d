"""Vector codes by a codebook for each part of a vector, fitted by Lloyd rounds that compare only what moved.

Components are integers.  A vector is cut into equal parts; each part position has a
codebook whose entries start as those parts of the first vectors.  A round assigns every
part to its nearest entry and replaces each entry by the floor of its parts' mean.

A row keeps, for each part, its entry and the exact distance to it.  In the next round a
part whose entry stayed as it was compares only the entries that moved with that
distance: the others are as far as before, and were no better.  A part whose own entry
moved compares all entries.  Equal distances go to the lower index in either case.

Codebooks are small (entries x components) and travel with the tasks; sums and counts
are added up inside a task before one row for each part and entry leaves it.  Rows of a
round are written in the checkpoint folder, so a lost executor costs its own partitions.

Defined cases: rows whose vector is null or has a null or non-finite component take no
part, nor do those whose length is not that of most rows (the smaller of two equally
frequent) or is no multiple of the number of parts; with fewer rows than entries there
is an entry for each row; rows without an id or label take part, the former after all
others when entries are chosen; rows that repeat an id stand in the order of their
vectors; components beyond 2^26 after scaling raise an error, as sums of squares would
leave 64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.plans.order import attach_row, cut_lineage

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Vectors that are compared with all entries at a time.
STEP = 4096
MOST = 1 << 26

_STATE = "vec_id long, label string, vector binary, entry binary, distance binary"
_SUMS = "part int, entry int, count long, sums array<long>"


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``parts`` to each of ``entries`` (integers)."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # All sums are exact in floats while they stay below 2^53; products of floats are much faster.
    kind = np.float64 if 4 * most * most * parts.shape[1] < 1 << 53 else np.int64
    a, b = parts.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry, ties to the lower index."""
    found = distances(parts, entries)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(parts)), best]


def reassign(parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, entry: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` for parts whose entry and distance before some entries ``moved`` (a mask) are known."""
    entry, distance = entry.copy(), distance.copy()
    if not moved.any():
        return entry, distance
    own = moved[entry]
    again, stay = np.flatnonzero(own), np.flatnonzero(~own)
    if len(again):
        entry[again], distance[again] = nearest(parts[again], entries)
    if len(stay):
        active = np.flatnonzero(moved)
        index, found = nearest(parts[stay], entries[active])
        index = active[index]
        better = (found < distance[stay]) | ((found == distance[stay]) & (index < entry[stay]))
        entry[stay[better]], distance[stay[better]] = index[better], found[better]
    return entry, distance


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """The rows of a binary column whose values have one size."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, STEP):
            yield batch.slice(first, STEP)


def _assign(codebooks: np.ndarray, before: np.ndarray | None):
    """Task that brings each row's entries up to date; ``codebooks`` are parts x entries x components."""
    moved = None if before is None else (codebooks != before).any(axis=2)
    n_parts, _, width = codebooks.shape

    def task(batches):
        for batch in _steps(batches):
            vectors = _matrix(batch.column("vector"), np.int32).reshape(batch.num_rows, n_parts, width).astype(np.int64)
            entry, distance = np.zeros((batch.num_rows, n_parts), np.uint8), np.zeros((batch.num_rows, n_parts), np.int64)
            if before is not None:
                entry, distance = _matrix(batch.column("entry"), np.uint8).copy(), _matrix(batch.column("distance"), np.int64).copy()
            for p in range(n_parts):
                if before is None:
                    entry[:, p], distance[:, p] = nearest(vectors[:, p], codebooks[p])
                else:
                    entry[:, p], distance[:, p] = reassign(vectors[:, p], codebooks[p], moved[p], entry[:, p], distance[:, p])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("vector"), _binary(entry), _binary(distance)],
                ["vec_id", "label", "vector", "entry", "distance"],
            )

    return task


def _sums(n_parts: int, n_entries: int, width: int):
    """Task that adds up the parts of each entry and emits them once."""

    def task(batches):
        sums, counts = np.zeros((n_parts * n_entries, width), np.int64), np.zeros(n_parts * n_entries, np.int64)
        for batch in _steps(batches):
            vectors = _matrix(batch.column("vector"), np.int32).reshape(-1, width).astype(np.int64)
            place = (np.arange(n_parts) * n_entries + _matrix(batch.column("entry"), np.uint8)).ravel()
            order = np.argsort(place, kind="stable")
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            sums[place[order][starts]] += np.add.reduceat(vectors[order], starts)
            counts += np.bincount(place, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((used // n_entries).astype(np.int32)), pa.array((used % n_entries).astype(np.int32)),
                pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64())),
            ],
            ["part", "entry", "count", "sums"],
        )

    return task


def _to_integers(size: int, factor: int):
    """Task that drops rows without a whole vector of ``size`` components and scales the others."""

    def task(batches):
        for batch in batches:
            lists = batch.column("vector")
            starts = lists.offsets.to_numpy()[:-1]
            flat = lists.values.to_numpy(zero_copy_only=False)
            values = flat[starts[:, None] + np.arange(size)] if len(starts) else np.zeros((0, size))
            scaled = np.floor(values.astype(np.float64) * factor)
            if (np.abs(scaled) > MOST).any():
                raise ValueError(f"a component is beyond {MOST} after scaling")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(scaled.astype(np.int32))], ["vec_id", "label", "vector"])

    return task


def whole_vectors(vectors: DataFrame, parts: int = PARTS, factor: int = FACTOR) -> tuple[DataFrame, int]:
    """((vec_id, label, vector as 32-bit integers), length) of the rows that take part."""
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = given.where(finite & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    common = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else parts
    return good.where(F.size("vector") == size).mapInArrow(_to_integers(size, factor), "vec_id long, label string, vector binary"), size


class Fitted:
    """Codebooks (parts x entries x components) and the rows assigned to them."""

    def __init__(self, codebooks: np.ndarray, rows: DataFrame):
        self.codebooks, self.rows = codebooks, rows

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> Fitted:
    """Codebooks of ``vectors`` (vec_id, embedding, label) after ``rounds`` rounds; rows: vec_id, label, vector, entry, distance."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte")
    whole, size = whole_vectors(vectors, parts, factor)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    chosen = np.array([np.frombuffer(r.vector, np.int32) for r in first], np.int64).reshape(len(first), parts, size // parts)
    codebooks, before, rows = np.ascontiguousarray(chosen.swapaxes(0, 1)), None, whole
    if not len(first):
        return Fitted(codebooks, whole.select("vec_id", "label", "vector", F.lit(b"").alias("entry"), F.lit(b"").alias("distance")))
    for turn in range(rounds + 1):
        rows = rows.mapInArrow(_assign(codebooks, before), _STATE)
        if turn == rounds:
            break
        rows = cut_lineage(rows)
        added = rows.mapInArrow(_sums(parts, len(first), size // parts), _SUMS).groupBy("part", "entry")
        means = added.agg(F.sum("count").alias("count"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size // parts))).collect()
        before, codebooks = codebooks, codebooks.copy()
        for row in means:  # one for each part and entry
            codebooks[row.part, row.entry] = [total // row["count"] for total in row[3:]]
    return Fitted(codebooks, rows)


def compressed_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label)."""
    model = fit(vectors, parts, entries, rounds, factor)

    def described(batches):
        for batch in batches:
            error = _matrix(batch.column("distance"), np.int64).sum(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            code = [e.hex() for e in batch.column("entry").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = cut_lineage(model.rows.mapInArrow(described, "vec_id long, label string, code string, error long"))
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = coded.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
