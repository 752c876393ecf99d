"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from fieldloom.llm.tables import stored


def _written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs as a table, and a count and sum that tell two tables apart, observed while it is written."""
    seen = Observation()
    total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    table = stored(pairs.observe(seen, F.count(F.lit(1)).alias("pairs"), total.alias("total")), "components")
    return table, (seen.get["pairs"], seen.get["total"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b longs): the smallest node it can reach.

    The steps only group and join edges, so neither a node with very many edges nor a
    large component is held by one task, and their number grows with the logarithm of
    the table.  Each round is one job that writes a table.  Loops (a = b) and repeated
    edges do no harm; an edge with a null end is dropped.
    """
    pairs, state = _written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        pairs, state = _written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        if state == before:
            break
    tops = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )
