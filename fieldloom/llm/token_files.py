"""Token ids of a corpus in files that can be searched without unpacking them.

Documents are sorted by id in range partitions.  A partition becomes one file of shards;
a shard is one row with the wavelet matrix of some hundred thousand ids, the ids of its
documents and the end of each inside the shard.  Any file can be written again alone, so
a lost executor costs its own partitions.

Defined cases: a null text is empty and gives the end id alone; rows without an id come
first; rows that repeat an id stay apart, in the order of their texts; an empty table
gives no files' rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldloom.llm.encoding import encoder, vocabulary
from fieldloom.llm.wavelet import WaveletMatrix
from fieldloom.plans.order import ensure_checkpoint_dir

END_ID = 1
#: A shard closes when it holds this many ids; a document is never cut.
SHARD_IDS = 1 << 18

_FILE = (
    "file int, shard int, n long, docs array<long>, ends array<long>, zeros array<int>, planes array<binary>, ranks array<binary>"
)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _shard_row(file: int, shard: int, docs: list, parts: list[np.ndarray], levels: int) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    matrix = WaveletMatrix.build(ids, levels)
    ends = np.cumsum([len(p) for p in parts])
    return pa.record_batch({
        "file": pa.array([file], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([len(ids)], pa.int64()),
        "docs": pa.array([docs], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int64())),
        "zeros": pa.array([matrix.zeros], pa.list_(pa.int32())),
        "planes": pa.array([matrix.planes], pa.list_(pa.binary())), "ranks": pa.array([matrix.ranks], pa.list_(pa.binary())),
    })


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``text`` by the tokenizer file and write shards in ascending ``doc_id`` order."""
    levels = max(1, int(max(vocabulary(tokenizer) - 1, end_id)).bit_length())

    def shards(batches):
        from pyspark import TaskContext

        file, shard, held, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).rows(batch.column("text")), strict=True):
                held.append(doc)
                parts.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size >= shard_ids:
                    yield _shard_row(file, shard, held, parts, levels)
                    shard, held, parts, size = shard + 1, [], [], 0
        if held:
            yield _shard_row(file, shard, held, parts, levels)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(shards, _FILE).write.option("compression", "zstd").parquet(folder)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n"], row["zeros"], row["planes"], row["ranks"])


def _starts(files: DataFrame) -> DataFrame:
    """(file, shard, before): ids in all shards before each; one row per file crosses files."""
    shards = files.select("file", "shard", "n")
    sizes = shards.groupBy("file").agg(F.sum("n").alias("ids"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    of_files = sizes.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("offset"))
    within = shards.select("file", "shard", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    return within.join(of_files, "file").select("file", "shard", (F.col("offset") + F.col("inside")).alias("before"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def documents(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                data = _matrix(row).ids().astype("<u4").tobytes()
                starts = [0, *row["ends"][:-1]]
                yield pa.record_batch({
                    "file": pa.array([row["file"]] * len(starts), pa.int32()), "shard": pa.array([row["shard"]] * len(starts), pa.int32()),
                    "doc_id": pa.array(row["docs"], pa.int64()), "inside": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(starts, row["ends"], strict=True)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, row["ends"], strict=True)], pa.int64()),
                })

    files = spark.read.schema(_FILE).parquet(folder)
    found = files.mapInArrow(documents, "file int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return found.join(_starts(files), ["file", "shard"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(doc_id, position): every occurrence of an id, looked up in the bit planes."""

    def places(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                at = _matrix(row).occurrences(token)
                ends = np.array(row["ends"], np.int64)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.record_batch({
                    "doc_id": pa.array(row["docs"], pa.int64()).take(pa.array(doc)),
                    "position": pa.array(at - np.concatenate(([0], ends[:-1]))[doc], pa.int64()),
                })

    return spark.read.schema(_FILE).parquet(folder).mapInArrow(places, "doc_id long, position long")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, occurrences) over the corpus by rank, without decoding."""

    def counts(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                matrix = _matrix(row)
                yield pa.record_batch({
                    "token": pa.array(tokens, pa.int64()),
                    "n": pa.array([matrix.rank(t, matrix.length) for t in tokens], pa.int64()),
                })

    found = spark.read.schema(_FILE).parquet(folder).mapInArrow(counts, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("occurrences"))


