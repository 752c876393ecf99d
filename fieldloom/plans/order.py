"""Total order over a whole table without sending it to one task.

A window without PARTITION BY (or with one hot partition) sorts everything in a
single task.  Here rows are range-partitioned on a unique sort key, so a hot
value is cut into as many blocks as it needs.  The blocks are fixed by a reliable
checkpoint; afterwards only one small row per block (or per block and group)
crosses blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ensure_checkpoint_dir(spark) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which is shared too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a frame that a global aggregate proves to be one row."""
    left, right = df.withColumn("_k", F.lit(1)), one_row.withColumn("_k", F.lit(1))
    return left.join(F.broadcast(right), "_k").drop("_k")


def sorted_blocks(df: DataFrame, keys: list[Column], blocks: int | None = None) -> DataFrame:
    """Add ``_block`` and ``_pos``: range block and position inside it.

    ``keys`` must end in a unique column so that equal values can be split.
    """
    if blocks is None:
        blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    offset = F.monotonically_increasing_id()
    placed = placed.withColumn("_block", F.shiftright(offset, 33).cast("int")).withColumn(
        "_pos", offset.bitwiseAND(F.lit((1 << 33) - 1))
    )
    return cut_lineage(placed)


def places(ordered: DataFrame, group: str, name: str = "place") -> DataFrame:
    """1-based place of each row among those of its ``group``, read from the order of a frame sorted by ``group`` first.

    Rows are numbered where they lie; one row per part and one per group are joined to
    them, so a group with a third of all rows is never gathered.
    """
    at = F.monotonically_increasing_id()
    rows = cut_lineage(ordered.withColumn("_part", F.shiftright(at, 33)).withColumn("_pos", at.bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_pos"))
    first = numbered.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_first"))
    joined = numbered.join(first, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_part", "_pos", "_start", "_rank", "_group", "_first")


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row in the order of ``keys``."""
    placed = sorted_blocks(df, keys)
    sizes = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    # One row per block: the window runs over block counts, never over the data.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_block")
        .withColumn(name, F.col("_start") + F.col("_pos") + 1)
        .drop("_block", "_pos", "_start")
    )
