"""Tables written by foreachBatch, below the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fieldloom.plans.order import ensure_checkpoint_dir

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def utc_instant(wall: Column) -> Column:
    """Instant of a zone-less time read as UTC, whatever the session time zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), wall))


def utc_wall(instant: Column) -> Column:
    """Zone-less UTC time of an instant."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def work_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


class ChangeLog:
    """Changed rows of a table, one folder per batch.

    A batch costs what it changes, not what the table holds, and a batch that runs again
    replaces its own folder.  The table is the latest row per key; with ``keys``, every
    ``compact_every`` batches the changes so far are folded into one base of latest rows,
    and a reader takes the newest complete base and the batches after it.
    """

    def __init__(self, spark: SparkSession, root: str, schema, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("batch",), compact_every: int = 20):
        self.spark, self.root = spark, root
        self.schema = spark.createDataFrame([], schema).schema
        self.keys, self.order, self.compact_every = keys, order, compact_every

    def put(self, batch_id: int, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
        if self.keys and (batch_id + 1) % self.compact_every == 0:
            newest = F.max_by(F.struct(*self.schema.names, "batch"), F.struct(*self.order, *[c for c in ("batch",) if c not in self.order]))
            base = self.rows(batch_id + 1).groupBy(*self.keys).agg(newest.alias("_row")).select("_row.*")
            base.write.mode("overwrite").parquet(f"{self.root}/base/upto={batch_id}")

    def _read(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self, before: int | None = None) -> DataFrame:
        """Changes with their ``batch``, optionally of earlier batches only; those under a base are its rows."""
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        changes = self._read(f"{self.root}/changes", full)
        changes = changes if before is None else changes.where(F.col("batch") < before)
        if not self.keys:
            return changes
        based = self._read(f"{self.root}/base", T.StructType([*full.fields, T.StructField("upto", T.LongType())]))
        based = based if before is None else based.where(F.col("upto") < before)
        upto = based.agg(F.max("upto")).first()[0]  # a partition value, read from the folder names
        if upto is None:
            return changes
        return based.where(F.col("upto") == upto).drop("upto").unionByName(changes.where(F.col("batch") > upto))

    def latest(self, keys: list[str], order: tuple[str, ...] = ("batch",), before: int | None = None) -> DataFrame:
        """Newest row per key; partial aggregation keeps frequent keys cheap."""
        values = [n for n in self.schema.names if n not in keys]
        newest = F.max_by(F.struct(*values), F.struct(*order))
        return self.rows(before).groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*self.schema.names)


def run_available(df: DataFrame, folder: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there now, in bounded batches."""
    (
        df.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(on_batch).start().awaitTermination()
    )
