"""Best-k matching of two tables without pairing all rows.

Names are cut into bounded blocks of neighbours, by length and letters.  Where a type has
one block, its mentions meet that.  Where it has more, each block has a summary that bounds
what any of its names can score; a mention first meets the block of the greatest bound,
which gives it a k-th best score, and then only the blocks whose bound reaches that.  A
task emits k rows per mention; inside a block tighter bounds leave most names unread
(``functions/similarity.py``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldloom.functions.similarity import NameBlock, Summary, WORD_BITS
from fieldloom.plans.order import cut_lineage, global_rank

#: Summaries (about 1 kB each) that travel in one row.
STRIP = 512

_SUMMARY = "t string, s long, shortest int, longest int, counts binary, words binary"
_CLOSEST = "array<struct<entity_id:long,score:double>>"
_STRIPS = "array<struct<s:long,shortest:int,longest:int,counts:binary,words:binary>>"


def _summarise(table: pd.DataFrame) -> pd.DataFrame:
    shortest, longest, counts, words = NameBlock(table["entity_id"], table["name"]).summary()
    row = (table["t"].iloc[0], int(table["s"].iloc[0]), shortest, longest, counts.astype("<i4").tobytes(), np.packbits(words).tobytes())
    return pd.DataFrame([row], columns=["t", "s", "shortest", "longest", "counts", "words"])


def _bounds(strip) -> tuple[np.ndarray, Summary]:
    """(blocks, their bounds) of a strip of summaries."""
    rows = [tuple(r) if not hasattr(r, "asDict") else tuple(r.asDict().values()) for r in (x.values() if isinstance(x, dict) else x for x in strip)]
    s, shortest, longest, counts, words = zip(*rows, strict=True)
    bits = np.unpackbits(np.frombuffer(b"".join(words), np.uint8).reshape(len(rows), -1), axis=1, count=WORD_BITS).astype(bool)
    letters = np.frombuffer(b"".join(counts), "<i4").reshape(len(rows), -1)
    return np.array(s), Summary(letters, np.array(shortest), np.array(longest), bits)


def _per_strip(frame: pd.DataFrame, visit) -> list[tuple]:
    """``visit(row, blocks, caps)`` for each mention of a batch; a strip is read once for all its mentions."""
    out, known = [], {}
    for row in frame.itertuples(index=False):
        key = (row.entity_type, row.strip)
        if key not in known:
            known.clear()  # one strip at a time
            known[key] = _bounds(row.summaries)
        blocks, summary = known[key]
        # An empty mention scores 0 everywhere.
        caps = summary.caps(row.needle) if row.needle else np.zeros(len(blocks))
        out.extend(visit(row, blocks, caps))
    return out


def _aims(batches):
    """The block of the greatest bound in each strip."""
    for frame in batches:
        rows = _per_strip(frame, lambda r, s, caps: [(r.entity_type, r.needle, int(s[caps.argmax()]), float(caps.max()))])
        yield pd.DataFrame(rows, columns=["t", "needle", "s", "cap"])


def _further(batches):
    """All other blocks whose bound reaches the k-th best score so far."""
    for frame in batches:
        reach = lambda r, s, caps: [(r.entity_type, r.needle, int(x), r.floor) for x in s[(caps >= r.floor) & (s != r.seen)].tolist()]
        rows = _per_strip(frame, reach)
        yield pd.DataFrame(rows, columns=["t", "needle", "s", "floor"])


def closest_names(mentions: DataFrame, names: DataFrame, k: int, block_mentions: int = 20_000, block_names: int = 200_000) -> DataFrame:
    """(entity_type, needle, closest): the k closest entities of its type for each needle, as (entity_id, score), closest first.

    ``mentions``: entity_type, needle (distinct).  ``names``: entity_type, entity_id, name
    (lower case, trimmed).  An entity scores by its best name.  The block holding that name
    keeps the entity among its own k best, so merging block results is exact.  The
    numbers of blocks are columns of the plan; nothing is counted on the driver.
    """
    tasks = max(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    names = names.select(F.col("entity_type").alias("t"), "entity_id", "name").where("name <> ''").distinct()
    letters = F.array_join(F.sort_array(F.array_distinct(F.split("name", ""))), "")
    ranked = global_rank(names, [F.col("t"), F.length("name"), letters, F.col("name"), F.col("entity_id")])
    blocks = cut_lineage(ranked.select("t", "entity_id", "name", F.floor((F.col("rank") - 1) / block_names).alias("s")))
    spread = blocks.groupBy("t").agg(F.min("s").alias("s"), F.max("s").alias("_last"))
    several = blocks.join(spread.where("s < _last").select("t"), "t", "left_semi")
    summaries = several.groupBy("t", "s").applyInPandas(_summarise, _SUMMARY)
    strips = summaries.groupBy("t", F.floor(F.col("s") / STRIP).alias("strip")).agg(
        F.collect_list(F.struct("s", "shortest", "longest", "counts", "words")).cast(_STRIPS).alias("summaries"))
    strips = cut_lineage(strips.withColumnRenamed("t", "entity_type"))
    mentions = cut_lineage(mentions.select("entity_type", "needle"))
    parts = 4 * tasks

    def match(pairs: DataFrame) -> DataFrame:
        """The k best of each (t, needle, s, floor) in its block; mentions of a block are dealt to slices, slices in turn to tasks."""
        sizes = pairs.groupBy("t", "s").agg(F.count(F.lit(1)).alias("_n"))
        left = F.greatest(F.least(F.lit(parts), F.ceil(F.col("_n") / 2_000)), F.ceil(F.col("_n") / block_mentions))
        sizes = sizes.select("t", "s", left.alias("_slices"))
        # One row per block: the window runs over blocks, never over names or mentions.
        before = Window.orderBy("t", "s").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_first", F.coalesce(F.sum("_slices").over(before), F.lit(0)))
        slice_ = lambda b: (F.col("_first") + b).cast("int").alias("b")
        some = pairs.join(sizes, ["t", "s"]).select("t", "s", slice_(F.pmod(F.xxhash64("needle"), F.col("_slices"))), "needle", "floor")
        wanted = blocks.join(sizes, ["t", "s"]).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
        wanted = wanted.select(slice_(F.col("_b")), "entity_id", "name")
        prepared: dict = {}  # slices of a task often meet the same block

        def best(some: pa.Table, inventory: pa.Table) -> pa.Table:
            kinds, needles = some["t"].to_pylist(), some["needle"].to_pylist()
            places, entities, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
            if len(some) and len(inventory):
                key = (kinds[0], some["s"][0].as_py())
                if key not in prepared:
                    prepared.clear()
                    prepared[key] = NameBlock(inventory["entity_id"].to_numpy(), inventory["name"].to_pylist())
                for place, entity, score in prepared[key].best_of(needles, k, some["floor"].to_pylist()):
                    places.append(place)
                    entities.append(entity)
                    scores.append(score)
            ends = np.cumsum([0, *map(len, entities[1:])])
            rows = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(entities), pa.int64(), from_pandas=True), pa.array(np.concatenate(scores), pa.float64())], ["entity_id", "score"])
            return pa.table({
                "entity_type": pa.array([kinds[p] for p in places], pa.string()), "needle": pa.array([needles[p] for p in places], pa.string()),
                "closest": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)})

        # Rows are small and their work is not: slices are dealt by their numbers, not by hash.
        some, wanted = (side.repartitionById(parts, F.col("b")) for side in (some, wanted))
        return some.groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(best, f"entity_type string, needle string, closest {_CLOSEST}")

    single = spread.where("s = _last").join(mentions.withColumnRenamed("entity_type", "t"), "t").select("t", "needle", "s")
    aimed = mentions.join(strips, "entity_type").mapInPandas(_aims, "t string, needle string, s long, cap double")
    aimed = aimed.groupBy("t", "needle").agg(F.max_by("s", F.struct("cap", -F.col("s"))).alias("s"))
    aimed = cut_lineage(aimed.unionByName(single))
    first = cut_lineage(match(aimed.withColumn("floor", F.lit(-1.0))))
    # Where there are several blocks, others may hold closer names.
    split = strips.select("entity_type").distinct()
    ahead = first.join(split, "entity_type", "left_semi")
    floor = F.when(F.size("closest") >= k, F.array_min(F.col("closest")["score"])).otherwise(-1.0)
    seen = aimed.select(F.col("t").alias("entity_type"), "needle", F.col("s").alias("seen")).join(
        ahead.select("entity_type", "needle", floor.alias("floor")), ["entity_type", "needle"], "left")
    # A strip with one block holds the one that was seen.
    open_ = seen.fillna(-1.0, ["floor"]).join(strips, "entity_type").where((F.size("summaries") > 1) | (F.col("summaries")[0]["s"] != F.col("seen")))
    more = open_.mapInPandas(_further, "t string, needle string, s long, floor double")
    found = ahead.unionByName(match(cut_lineage(more))).select("entity_type", "needle", F.inline("closest"))
    found = found.groupBy("entity_type", "needle", "entity_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("entity_type", "needle").orderBy(F.desc("score"), "entity_id")
    found = found.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k)
    merged = found.groupBy("entity_type", "needle").agg(F.sort_array(F.collect_list(F.struct("_place", F.struct("entity_id", "score").alias("_hit"))))["_hit"].alias("closest"))
    return first.join(split, "entity_type", "left_anti").unionByName(merged)


def top_k(scores: DataFrame, mention: str, k: int) -> DataFrame:
    """k best rows per mention by score, ties by entity_id.

    The bound on row_number is applied inside each task before the shuffle, so a
    mention with very many rows is cut early.
    """
    order = Window.partitionBy(mention).orderBy(F.desc("score"), "entity_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
