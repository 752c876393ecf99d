"""Near-duplicate documents by bottom-k sketches.

A document is the set of its five-word shingles.  One hash function orders all
shingles; the k smallest values are the document's sketch.

1. Documents with equal sets form a class; only its first document goes on.
2. Inverted lists of retained values: a pair at the threshold shares at least
   ``share`` of its sketches except with a chance below 1e-6, so it meets in one of the
   rarest values of either sketch.  Only those values are listed (a prefix filter), and of
   lists with equal members one is kept.
3. Long lists are dealt to chunks, and two chunks at a time meet in a task, which counts
   overlaps, estimates the similarity from the k smallest values of the union of two
   sketches and emits a spanning forest of the pairs that pass, never the pairs.
4. Components of these forests are the candidate groups; only their documents are read
   again.  Exact set similarity is confirmed inside groups, again chunk by chunk, and a
   spanning forest of the confirmed links gives the final components.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.llm.components import components
from fieldloom.llm.hashing import mix, rows_of_words, text_chunks, window_hashes, word_hashes, word_spans
from fieldloom.llm.memory import returning
from fieldloom.plans.order import cut_lineage

SHINGLE = 5
SKETCH = 48
THRESHOLD = Fraction(85, 100)
#: Overlap of sketches and estimated similarity that a candidate needs: five standard errors below the threshold.
SHARE = Fraction(55, 100)
#: Documents, and values of their sets, of one chunk.
CHUNK_DOCS = 512
CHUNK_VALUES = 1_000_000

_SLICE = 4096
_PAD = np.uint64(2**64 - 1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE):
    """Sorted distinct shingle hashes of each row, in order; empty without words."""
    for _, _, data, offsets in text_chunks(column):
        starts, ends, bounds = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, fold_case=True)
        hashes, rows = window_hashes(words, shingle), rows_of_words(bounds)
        inside = rows[: len(hashes)] == rows[shingle - 1 : shingle - 1 + len(hashes)]
        values, of = hashes[inside], rows[: len(hashes)][inside]
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        if len(values):
            new = np.concatenate(([True], (values[1:] != values[:-1]) | (of[1:] != of[:-1])))
            values, of = values[new], of[new]
        cuts = np.searchsorted(of, np.arange(len(bounds)))
        for i in range(len(bounds) - 1):
            n = bounds[i + 1] - bounds[i]
            yield window_hashes(words[bounds[i] : bounds[i + 1]], n) if 0 < n < shingle else values[cuts[i] : cuts[i + 1]]


def _sketches(batches):
    for batch in batches:
        sizes, first, second, sketches = [], [], [], []
        for values in shingle_sets(batch.column("text")):
            sizes.append(len(values))
            first.append(int(np.bitwise_xor.reduce(values, initial=0)) if len(values) else 0)
            second.append(int(np.add.reduce(mix(values))) if len(values) else 0)
            sketches.append(values[:SKETCH].astype(np.int64))
        ends = np.cumsum([0, *map(len, sketches)])
        flat = np.concatenate([*sketches, np.zeros(0, np.int64)])
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()),
            "c1": pa.array(np.array(first, np.uint64).view(np.int64)), "c2": pa.array(np.array(second, np.uint64).view(np.int64)),
            "sketch": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
        })


def _runs(batches, keys: tuple[str, ...]):
    """Tables of equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _overlaps(rows: np.ndarray, values: np.ndarray, m: int) -> np.ndarray:
    """Number of common values of every two of m sets."""
    if m == 2:
        common = len(values) - len(np.unique(values))
        return np.array([[0, common], [common, 0]], dtype=np.float32)
    _, index, counts = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    wanted = counts[index] > 1
    rows, columns = rows[wanted], number[index[wanted]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((m, m), dtype=np.float32)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, _SLICE):
        a, b = np.searchsorted(columns, (start, start + _SLICE))
        present = np.zeros((m, int(columns[b - 1]) - start + 1), dtype=np.float32)
        present[rows[a:b], columns[a:b] - start] = 1
        total += present @ present.T
    np.fill_diagonal(total, 0)
    return total


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of the pairs: the smallest index of each."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new[labels]]
        if (new == labels).all():
            return labels
        labels = new


def _stars(ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = np.flatnonzero(labels != np.arange(len(labels)))
    return ids[labels[other]], ids[other]


def _union_estimates(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of pairs from the smallest values of the union of two padded sketches."""
    both = np.sort(np.concatenate((sketches[a], sketches[b]), axis=1), axis=1)
    twin = np.zeros(both.shape, dtype=bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    rank = np.cumsum(~twin & (both != _PAD), axis=1)
    within = rank <= sketches.shape[1]
    size = np.minimum(rank[:, -1], sketches.shape[1])
    return (twin & within).sum(axis=1) / np.maximum(size, 1)


def _estimated_forest(batches):
    """Spanning forest of the pairs of each list that pass the union-sketch estimate."""
    for group in _runs(batches, ("value", "lo", "hi")):
        ids, sizes = group.column("node").to_numpy(), group.column("n").to_numpy()
        lists = group.column("sketch").combine_chunks()
        flat = lists.flatten().to_numpy().view(np.uint64)
        lengths = np.diff(lists.offsets.to_numpy())
        m = len(ids)
        rows = np.repeat(np.arange(m), lengths)
        overlap = _overlaps(rows, flat, m)
        need = np.ceil(lengths * float(SHARE) - 1e-9)
        possible = overlap >= np.maximum(need[:, None], need[None, :])
        possible &= np.minimum(sizes[:, None], sizes[None, :]) >= float(THRESHOLD) * np.maximum(sizes[:, None], sizes[None, :]) - 1e-6
        np.fill_diagonal(possible, False)
        if not possible.any():
            continue
        padded = np.full((m, SKETCH), _PAD)
        padded[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        labels = np.arange(m)
        while True:  # each row tries its best partner outside its component
            open_pairs = np.where(possible & (labels[:, None] != labels[None, :]), overlap, -1)
            best = open_pairs.argmax(axis=1)
            a = np.flatnonzero(open_pairs[np.arange(m), best] >= 0)
            if not len(a):
                break
            b = best[a]
            good = _union_estimates(padded, a, b) >= float(SHARE)
            possible[a[~good], b[~good]] = possible[b[~good], a[~good]] = False
            labels = _settle(labels, a[good], b[good])
        a, b = _stars(ids, labels)
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _confirmed_forest(batches):
    """Spanning forest of the pairs of each group whose sets reach the threshold."""
    for group in _runs(batches, ("cluster", "lo", "hi")):
        ids = group.column("node").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        overlap = _overlaps(np.repeat(np.arange(len(ids)), sizes), np.concatenate(sets), len(ids)).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - overlap
        linked = THRESHOLD.denominator * overlap >= THRESHOLD.numerator * union
        np.fill_diagonal(linked, False)
        a, b = np.nonzero(np.triu(linked))
        a, b = _stars(ids, _settle(np.arange(len(ids)), a, b))
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _sets(batches):
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())
        yield pa.record_batch({**{c: batch.column(c) for c in ("cluster", "node", "chunks")}, "shingles": sets})


def _in_chunk_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows with a ``chunks`` count to pairs of chunks of their key; one chunk meets itself."""
    chunk = F.pmod(F.xxhash64("node", key), F.col("chunks")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1), lambda j: (j != F.col("chunk")) | (F.col("chunks") == 1))
    dealt = rows.withColumn("chunk", chunk).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    return dealt.drop("chunk", "other", "chunks").repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Defined cases: a null text, or one without words, has no shingles and is linked with
    nothing; a text shorter than a shingle is one shingle; equal texts are linked; of rows
    that repeat an id each gets the component of its own text; a row without an id is linked with nothing,
    its component is null and it is kept; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut_lineage(docs.mapInArrow(returning(_sketches), "doc_id long, n long, c1 long, c2 long, sketch array<long>"))
    linkable = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("node"))
    nodes = linkable.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(
        F.col("doc_id").alias("node"), "n", "sketch"
    )

    values = nodes.select("node", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1")
    of_node = Window.partitionBy("node")
    needed = F.ceil(F.col("k") * F.lit(float(SHARE)) - F.lit(1e-9))
    rarest = (
        values.join(common, "value")
        .withColumn("rank", F.col("k") - F.count(F.lit(1)).over(of_node) + F.row_number().over(of_node.orderBy("listed", "value")))
        .where(F.col("rank") <= F.col("k") - needed + 1)
        .select("node", "value")
    )
    lists = (
        rarest.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
        .where("members > 1").groupBy("members", "same").agg(F.min("value").alias("value"))
        .select("value", F.ceil(F.col("members") / CHUNK_DOCS).alias("chunks"))
    )
    listed = rarest.join(lists, "value").join(nodes, "node")
    candidates = _in_chunk_pairs(listed, "value").mapInArrow(returning(_estimated_forest), "a long, b long")

    clusters = components(candidates).withColumnRenamed("component", "cluster")
    sized = clusters.join(nodes.select("node", "n"), "node")
    chunks = sized.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS), F.ceil(F.sum("n") / CHUNK_VALUES)).alias("chunks")
    )
    texts = sized.join(chunks, "cluster").select("node", "cluster", "chunks").join(docs.withColumnRenamed("doc_id", "node"), "node")
    sets = texts.mapInArrow(returning(_sets), "cluster long, node long, chunks long, shingles binary")
    links = _in_chunk_pairs(sets, "cluster").mapInArrow(returning(_confirmed_forest), "a long, b long")

    linked = components(links).withColumnRenamed("component", "component_id")
    of_class = classes.join(linked, "node", "left").select("c1", "c2", "n", F.coalesce("component_id", "node").alias("component_id"))
    rows = found.select("doc_id", "n", "c1", "c2").join(of_class, ["c1", "c2", "n"], "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
