"""Exact best-k search over integer vectors by MaxScore.

A vector is a document whose terms are its components.  Vectors are dealt to shards by a
hash; a shard keeps one posting list per component with its largest and smallest value,
which bound what the component can add to a query's score.  For each query, the
components with the smallest bounds whose sum stays below the k-th best score so far are
non-essential.  Essential postings are traversed for all vectors of the shard; the
others are probed, largest bound first, only for vectors that could still reach the k-th
best score.  A shard emits k rows per query, and the shards' rows are merged.

Queries meet shards in blocks of bounded size; no pair of rows is ever a row.

Defined cases: rows without id or vector, or with a null or non-finite component, take no
part; a shorter vector is filled up with zeros; rows with the query's own id are no
candidates; a pair that meets more than once, as ids repeat, counts once with its best
score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

K = 20
#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 8192, 2048
#: Vectors that are scored in full to start with, and components probed at a time.
SEED, STEP = 512, 8

_HITS = "query_id long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    values = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    values[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return values


def _exact_type(queries: np.ndarray, vectors: np.ndarray):
    """The fastest type in which all partial sums are exact."""
    if not queries.size or not vectors.size:
        return np.float64
    most = int(np.abs(queries).max()) * int(np.abs(vectors).max()) * queries.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_shard(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best vectors of a shard for one query; ``postings`` has a row per component."""
    seed = min(SEED, len(ids))
    first = np.flatnonzero(ids[:seed] != own)
    scores, found = _best((query @ postings[:, :seed])[first], ids[:seed][first], k)
    if seed == len(ids):
        return scores, found
    postings, ids = postings[:, seed:], ids[seed:]
    bounds = np.maximum(query * postings.max(axis=1), query * postings.min(axis=1))
    order = np.argsort(bounds, kind="stable")
    threshold = scores[-1] if len(scores) == k else None
    split = 0 if threshold is None else int(np.searchsorted(np.cumsum(np.maximum(bounds[order], 0)), threshold))
    others, essential = order[:split][::-1], order[split:]
    partial = query[essential] @ postings[essential]
    alive = np.flatnonzero(ids != own)
    partial = partial[alive]
    for start in range(0, len(others) + 1, STEP):
        rest = others[start:]
        if threshold is not None:
            competitive = partial + bounds[rest].sum() >= threshold
            alive, partial = alive[competitive], partial[competitive]
        probed = rest[:STEP]
        if not len(probed) or not len(alive):
            break
        partial = partial + query[probed] @ postings[np.ix_(probed, alive)]
    return _best(np.concatenate((scores, partial)), np.concatenate((found, ids[alive])), k)


def scaled(vector: Column, factor: int = 64) -> Column:
    """Integer components floor(factor * x); null for a vector that takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best ``vectors`` for each of ``queries`` (vec_id, vector of longs)."""
    queries = queries.where("vec_id IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").alias("query_id"), "vector")
    vectors = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL").select("vec_id", F.col("vector").alias("values"))
    blocks, shards = (max(1, -(-frame.count() // size)) for frame, size in ((queries, BLOCK), (vectors, SHARD)))
    left = queries.select(
        "query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    right = vectors.select(
        "vec_id", "values", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to_block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("of_shard"),
    )

    def meet(asked: pa.Table, shard: pa.Table) -> pa.Table:
        out = [np.zeros((3, 0), np.int64)]
        if asked.num_rows and shard.num_rows:
            wanted, values = _matrix(asked.column("vector")), _matrix(shard.column("values"))
            size = max(wanted.shape[1], values.shape[1])
            wanted, values = (np.pad(m, ((0, 0), (0, size - m.shape[1]))) for m in (wanted, values))
            kind = _exact_type(wanted, values)
            ids = shard.column("vec_id").to_numpy()
            postings = np.ascontiguousarray(values.T.astype(kind))
            for own, query in zip(asked.column("query_id").to_pylist(), wanted.astype(kind), strict=True):
                scores, found = search_shard(postings, ids, query, own, k)
                out.append(np.array([np.full(len(found), own), found, scores.astype(np.int64)]))
        query_id, vec_id, score = np.concatenate(out, axis=1)
        return pa.table({"query_id": pa.array(query_id), "vec_id": pa.array(vec_id), "score": pa.array(score)})

    hits = left.groupBy("block", "shard").cogroup(right.groupBy("to_block", "of_shard")).applyInArrow(meet, _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
