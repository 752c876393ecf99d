"""Sequences of a fixed size with a controlled mixture of sources.

Every part is the whole in small: the documents of a source, end to end, are a line of
tokens, and each part gets an equal range of every source's line, documents cut freely.  So
a part holds each source in its proportion of all tokens, to ``LEAST_PIECE`` tokens, however
documents and sources are spread; what a range falls short of its share is in the source's
next range.  Documents come in the order of hash groups, so a place in the line follows from
the token sums of the groups before; a source with a third of all rows or a very long
document is spread over all parts.

In a part, deficit round robin: every window credits each source with its share of the
tokens; a source spends what it has been credited from its queue, and carries the rest to the
next window.  Room that a drained source leaves goes to the largest deficits.  The tail of a
part becomes sequences of a power of two, which need no padding.

Defined cases: a null text is empty and is the end id alone; a null source is a queue of
its own; every row is a document, also if it repeats an id or has none; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.llm.encoding import encoder, vocabulary
from fieldloom.llm.memory import returning
from fieldloom.plans.order import attach_row

WINDOW = 2048
END_ID = 1
#: A source spends its credit in pieces of at least so many tokens, unless room or queue is smaller.
LEAST_PIECE = 32
#: A part has at least so many windows, or there are fewer parts.
LEAST_WINDOWS = 64

DEALT = "part int, source string, place long, doc_id long, doc_tokens long, start long, share double, owed double, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def credit_rates(queues: np.ndarray, shares: np.ndarray, owed: np.ndarray, given: bool) -> np.ndarray:
    """Credit of each source for a token of the part: its share of the part and what it is owed.

    Without ``given`` shares, all queues are to drain together, so a source without tokens in
    the part gets none.
    """
    rates = np.maximum(shares * max(int(queues.sum()), 1) + owed, 0)
    if not given:
        rates[queues == 0] = 0
    return rates / max(rates.sum(), 1e-300)


def fill_windows(queues: np.ndarray, rates: np.ndarray, window: int = WINDOW, least: int = LEAST_PIECE):
    """(window number, source, tokens) of each cut, window by window; ``queues`` are token counts."""
    left, deficit = queues.astype(np.int64), np.zeros(len(queues))
    numbers, sources, cuts = [], [], []
    total, number = int(left.sum()), 0
    while total:
        room = window if total >= window else 1 << (total.bit_length() - 1)
        deficit += rates * room
        take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
        take[(take < least) & (take < left)] = 0
        order = np.argsort(-deficit, kind="stable")
        spent = np.minimum(np.cumsum(take[order]), room)
        take[order] = np.diff(spent, prepend=0)
        rest = room - int(spent[-1])
        if rest:
            order = np.argsort(take - deficit, kind="stable")
            extra = np.minimum(np.cumsum((left - take)[order]), rest)
            take[order] += np.diff(extra, prepend=0)
        used = np.flatnonzero(take)
        numbers.append(np.full(len(used), number))
        sources.append(used)
        cuts.append(take[used])
        deficit -= take
        left -= take
        total -= room
        number += 1
    if not number:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(numbers), np.concatenate(sources), np.concatenate(cuts)


def range_starts(first: int, last: int, tokens: int, parts: int, least: int = LEAST_PIECE) -> np.ndarray:
    """Where the ranges ``first`` to ``last`` of a source with so many tokens start in its line; range ``parts`` starts at its end."""
    numbers = np.arange(first, last + 1)
    return np.where(numbers == parts, tokens, numbers * tokens // parts // least * least)


def _deal_group(docs: pa.Table, lines: pa.Table, units: int, least_part: int, width: str, given: bool) -> pa.Table:
    """The documents of a hash group, cut where ranges of their source's line end, with the part of each range."""
    if not docs.num_rows:
        return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(DEALT.split(", "), _DEALT_TYPES, strict=True)})
    # The order is total, so a task that runs again cuts the same documents at the same places.
    docs = docs.select(["source", "entry"])
    order = pc.sort_indices(docs, sort_keys=[("source", "ascending"), ("entry", "ascending")]).to_numpy()
    names = docs.column("source").to_pylist()
    entries = [b.as_buffer() for b in docs.column("entry")]
    heads = np.array([np.frombuffer(entries[i], ">i8", 2) for i in order])
    ids = [np.frombuffer(entries[i], width, offset=16) for i in order]
    lengths = np.array([len(i) for i in ids])
    tokens = np.concatenate(ids)
    del ids, entries
    doc_ends = np.cumsum(lengths)
    doc_begins = doc_ends - lengths
    line_of = {line["source"]: line for line in lines.to_pylist()}
    firsts = [0] + [k for k in range(1, len(order)) if names[order[k]] != names[order[k - 1]]]
    edges, targets, places, owed, sources, shares = [], [], [], [], [], []
    for first, stop in zip(firsts, firsts[1:] + [len(order)], strict=True):
        name = names[order[first]]
        line = line_of[name]
        total, begin, end = line["source_tokens"], int(doc_begins[first]), int(doc_ends[stop - 1])
        parts = min(units, max(1, line["all_tokens"] // least_part))
        shift = line["before"] - begin
        low = (begin + shift) * parts // total
        starts = range_starts(low, min(parts, (end + shift + LEAST_PIECE) * parts // total + 1), total, parts)
        cuts = starts[(starts > begin + shift) & (starts < end + shift)] - shift
        at = np.unique(np.concatenate((doc_begins[first:stop], cuts)))
        ranges = np.searchsorted(starts, at + shift, side="right") - 1
        edges.append(at)
        places.append(at + shift)
        # Lines start at different parts, so the last ranges, with the rests, do not meet in one.
        targets.append((ranges + low + zlib.crc32(repr(name).encode())) % parts)
        owed.append(np.zeros(len(at)) if given else (ranges + low) * (total / parts) - starts[ranges])
        sources += [name] * len(at)
        shares.append(np.full(len(at), line["share"]))
    edges = np.concatenate(edges)
    bounds = np.append(edges, doc_ends[-1])
    doc = np.searchsorted(doc_begins, edges, side="right") - 1
    offsets = pa.py_buffer((bounds * tokens.itemsize).astype("<i8"))
    return pa.table([
        pa.array(np.concatenate(targets), pa.int32()), pa.array(sources, pa.string()), pa.array(np.concatenate(places), pa.int64()),
        pa.array(heads[doc, 1].astype("<i8"), mask=heads[doc, 0] != 0), pa.array(lengths[doc], pa.int64()), pa.array(edges - doc_begins[doc], pa.int64()),
        pa.array(np.concatenate(shares)), pa.array(np.concatenate(owed)),
        pa.Array.from_buffers(pa.large_binary(), len(edges), [None, offsets, pa.py_buffer(tokens)]).cast(pa.binary()),
    ], names=[c.split()[0] for c in DEALT.split(", ")])


_DEALT_TYPES = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())


def _pack_part(docs: pa.Table, window: int, width: str, given: bool) -> pa.Table:
    part = docs.column("part")[0].as_py()
    order = pc.sort_indices(docs.select(["source", "place"]), sort_keys=[("source", "ascending"), ("place", "ascending")])
    rows = docs.drop_columns(["ids"]).take(order)
    order = order.to_numpy()
    ids = [np.frombuffer(b.as_buffer(), width) for b in docs.column("ids")]
    lengths = np.array([len(ids[i]) for i in order])
    tokens = np.concatenate([ids[i] for i in order]).astype("<u4").tobytes()
    del ids
    names = rows.column("source").to_pylist()
    new = np.array([k == 0 or name != names[k - 1] for k, name in enumerate(names)])
    source = np.cumsum(new) - 1
    queues = np.bincount(source, weights=lengths).astype(np.int64)
    rates = credit_rates(queues, rows.column("share").to_numpy()[new], rows.column("owed").to_numpy()[new], given)
    windows, of, cuts = fill_windows(queues, rates, window)
    # Places of the cuts: in their window, and among all tokens with the queues end to end.
    first = np.searchsorted(windows, windows)
    ends = np.cumsum(cuts)
    offsets = ends - cuts - (ends - cuts)[first]
    by_source = np.argsort(of, kind="stable")
    begin = np.zeros(len(cuts), np.int64)
    begin[by_source] = np.cumsum(cuts[by_source]) - cuts[by_source]
    # A piece ends where a cut or a document, or what the part has of it, ends.
    doc_ends = np.cumsum(lengths)
    doc_begins = doc_ends - lengths
    edges = np.unique(np.concatenate((begin, doc_begins)))
    sizes = np.diff(np.append(edges, doc_ends[-1]))
    doc = np.searchsorted(doc_begins, edges, side="right") - 1
    cut = by_source[np.searchsorted(begin[by_source], edges, side="right") - 1]
    view = memoryview(tokens)
    sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges.tolist(), (edges + sizes).tolist(), strict=True)]
    return pa.table({
        "doc_id": rows.column("doc_id").take(pa.array(doc)), "start": pa.array(rows.column("start").to_numpy()[doc] + edges - doc_begins[doc]),
        "length": pa.array(sizes), "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": pa.array(rows.column("doc_tokens").to_numpy()[doc]),
        "sequence_id": pa.array((np.int64(part) << 32) + windows[cut]), "offset": pa.array(offsets[cut] + edges - begin[cut]),
    })


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, targets: dict[str | None, float] | None = None,
    units: int | None = None,
) -> DataFrame:
    """One row per piece of a document: see ``PIECES``.

    ``targets`` are the wanted token proportions by source; by default each source has its
    share of all tokens, so that all queues drain together.  ``units`` bounds the number of parts
    (default: twice the shuffle partitions); the ids of one part must fit in a task.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units or 2 * partitions
    least_part = LEAST_WINDOWS * window
    width = "<u2" if max(vocabulary(tokenizer) - 1, end_id) < 1 << 16 else "<u4"
    item = np.dtype(width).itemsize
    end = np.array([end_id], width).tobytes()

    def encode(batches):
        for batch in batches:
            docs_of = batch.column("doc_id").to_pylist()
            entries = (
                np.array([doc is None, doc or 0], ">i8").tobytes() + ids.astype(width).tobytes() + end
                for doc, ids in zip(docs_of, encoder(tokenizer).rows(batch.column("text")), strict=True)
            )
            yield pa.record_batch({"part": batch.column("part"), "source": batch.column("source"), "entry": pa.array(entries, pa.binary())})

    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(units)).cast("int").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    encoded = rows.mapInArrow(returning(encode), "part int, source string, entry binary").repartition(partitions, "part")

    # An entry holds whether the document's id is null, the id, and its tokens: the sums need all
    # columns that dealing needs, so both uses share one exchange.
    tokens = (F.octet_length("entry") - 16).cast("long")
    sums = encoded.groupBy("part", "source").agg((F.sum(tokens) / item).cast("long").alias("tokens"))
    of_sources = sums.groupBy("source").agg(F.sum("tokens").alias("source_tokens")).withColumn("weight", F.col("source_tokens").cast("double"))
    if targets is not None:
        wanted = F.coalesce(*(F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in targets.items()), F.lit(0.0))
        of_sources = of_sources.withColumn("weight", wanted)
    whole = of_sources.agg(F.sum("weight").alias("all_weights"), F.sum("source_tokens").alias("all_tokens"))
    shares = attach_row(of_sources, whole).select(
        F.col("source").alias("name"), "source_tokens", "all_tokens", (F.col("weight") / F.greatest("all_weights", F.lit(1e-300))).alias("share")
    )
    within = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lines = (
        sums.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(shares, F.col("source").eqNullSafe(F.col("name"))).select(F.col("part").alias("part"), F.col("source").alias("source"), "before", "source_tokens", "all_tokens", "share")
    )

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        return _deal_group(left, right, units, least_part, width, targets is not None)

    def pack(dealt: pa.Table) -> pa.Table:
        return _pack_part(dealt, window, width, targets is not None)

    dealt = encoded.groupBy("part").cogroup(lines.groupBy("part")).applyInArrow(deal, DEALT)
    return dealt.repartition(partitions, "part").groupBy("part").applyInArrow(pack, PIECES)
