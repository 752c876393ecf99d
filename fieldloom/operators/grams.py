"""A stored index of character grams: built once, kept current by segments, searched many times.

Texts are the lower-case fields of the items.  A segment holds the items of one update,
dealt to shards of bounded size, and one posting per shard and gram: the slots of the items
that hold it, as differences.  Every term of a query has grams, one as long as itself if it
has fewer than ``GRAM`` letters, so the slots that hold all grams of a term hold all items
that contain it; the terms are then tested on these items' texts.

An update writes only its own items.  An item that replaces or removes an older one names
the slot of it, which is passed over from then on; every ``compact_every`` segments all
items are written again as one.  A segment counts when it is named, after all its files; an
update that runs again under its number replaces its own files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldloom.functions import text as tx
from fieldloom.operators import search
from fieldloom.plans.order import attach_row, cut_lineage
from fieldloom.sources.versions import read_or_empty

GRAM = 3
_PLACE = ["segment", "shard", "slot"]


def grams_of(term: Column) -> Column:
    """The grams that every text with the term holds."""
    size = F.least(F.length(term), F.lit(GRAM))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term) - size + 1), lambda i: F.substring(term, i, size)))


def _postings(items: pa.Table) -> pa.Table:
    slots: dict[str, list[int]] = {}
    places = sorted(zip(items.column("slot").to_pylist(), items.column("text").to_pylist(), strict=True))
    for slot, text in places:
        for gram in {text[i : i + size] for size in range(1, GRAM + 1) for i in range(len(text) - size + 1)}:
            slots.setdefault(gram, []).append(slot)
    order = sorted(slots)
    return pa.table({
        "shard": pa.array([items.column("shard")[0].as_py()] * len(order), pa.int64()), "gram": pa.array(order, pa.string()),
        "slots": pa.array([np.diff(slots[g], prepend=0).astype("<u2").tobytes() for g in order], pa.binary()),
    })


def _meet(postings: pa.Table, terms: pa.Table) -> pa.Table:
    """Slots of a shard that hold all grams of a term, by ANDs of one bit a slot."""
    stored = dict(zip(postings.column("gram").to_pylist(), postings.column("slots").to_pylist(), strict=True))
    bits: dict[str, int] = {}

    def held(gram: str) -> int:
        if gram not in bits:
            mask = np.zeros(1 << 16, bool)
            mask[np.cumsum(np.frombuffer(stored[gram], "<u2").astype(np.int64))] = True
            bits[gram] = int.from_bytes(np.packbits(mask[: np.flatnonzero(mask)[-1] + 1], bitorder="little").tobytes(), "little")
        return bits[gram]

    found: list[np.ndarray] = []
    names: list[str] = []
    for term, grams in zip(terms.column("term").to_pylist(), terms.column("grams").to_pylist(), strict=True):
        if all(g in stored for g in grams):
            both = -1
            for gram in sorted(grams, key=lambda g: len(stored[g])):
                both &= held(gram)
                if not both:
                    break
            if both:
                packed = np.frombuffer(both.to_bytes((both.bit_length() + 7) // 8, "little"), np.uint8)
                found.append(np.flatnonzero(np.unpackbits(packed, bitorder="little")))
                names += [term] * len(found[-1])
    n = len(names)
    place = lambda c: pa.array([terms.column(c)[0].as_py()] * n if n else [], pa.int64())
    return pa.table({
        "segment": place("segment"), "shard": place("shard"),
        "slot": pa.array(np.concatenate(found) if found else np.zeros(0), pa.int64()), "term": pa.array(names, pa.string()),
    })


class GramIndex:
    """``items`` of an update: id, what ``search`` reads, ``version`` (long) and ``live``.

    The newest version of an id counts, of equal ones the one that came last; ``live`` false
    takes the item out of the results.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: str = "string", shard_items: int = 1_000, compact_every: int = 20):
        if shard_items > 1 << 16:
            raise ValueError("a slot has 16 bits")
        self.spark, self.root, self.shard_items, self.compact_every = spark, root, shard_items, compact_every
        self.texts = [f"_l_{n}" for n in ("title", "description", "institution", "category", "fulltext", "_variants")]
        self._kept = f"id {id_type}, version long, live boolean, " + ", ".join(f"{c} string" for c in self.texts)
        self._schema = f"{self._kept}, replaces struct<segment:long,shard:long,slot:long>, shard long, slot long, segment long"

    def _segments(self, before: int | None = None) -> list[int]:
        """The last segment that holds all items, and those after it; at most ``compact_every``."""
        named = read_or_empty(self.spark, f"{self.root}/named", "whole boolean, segment long", "json")
        rows = {r["segment"]: r["whole"] for r in (named if before is None else named.where(F.col("segment") < before)).collect()}
        first = max((s for s, whole in rows.items() if whole), default=-1)
        return sorted(s for s in rows if s >= first)

    def _items(self, segments: list[int]) -> DataFrame:
        """The newest row of every id."""
        rows = read_or_empty(self.spark, f"{self.root}/items", self._schema).where(F.col("segment").isin(segments))
        return rows.join(self._replaced(segments), _PLACE, "left_anti")

    def _replaced(self, segments: list[int]) -> DataFrame:
        rows = read_or_empty(self.spark, f"{self.root}/items", self._schema).where(F.col("segment").isin(segments))
        return rows.where("replaces IS NOT NULL").select("replaces.*")

    def update(self, segment: int, items: DataFrame) -> None:
        """Take in changed items as segment number ``segment``; numbers rise."""
        rows = search._lowered(items).select("id", F.col("version").cast("long").alias("version"), "live", *self.texts)
        rest = [c for c in rows.columns if c != "id"]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("version", "live", *self.texts)).alias("p")).select("id", "p.*")
        segments = self._segments(segment)
        known = self._items(segments)
        places = known.select("id", F.col("version").alias("_version"), F.struct(*_PLACE).alias("replaces"))
        fresh = last.join(places, "id", "left").where("_version IS NULL OR version >= _version").drop("_version")
        whole = len(segments) + 1 >= self.compact_every
        if whole:
            fresh = cut_lineage(fresh)
            fresh = known.join(fresh.select("id"), "id", "left_anti").select(*last.columns).unionByName(fresh.drop("replaces"))
            fresh = fresh.withColumn("replaces", F.lit(None).cast("struct<segment:long,shard:long,slot:long>"))
        # Places are read back from the written items, so a task that runs twice can't disagree with itself.
        placed = fresh.withColumn("_n", F.monotonically_increasing_id()).withColumn("_in_task", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
        placed = placed.withColumn("shard", F.col("_n") - F.col("_in_task") + F.floor(F.col("_in_task") / self.shard_items))
        placed = placed.withColumn("slot", F.col("_in_task") % self.shard_items).drop("_n", "_in_task")
        placed.write.mode("overwrite").parquet(f"{self.root}/items/segment={segment}")
        written = read_or_empty(self.spark, f"{self.root}/items", self._schema).where((F.col("segment") == segment) & F.col("live"))
        texts = written.select("shard", "slot", F.concat_ws("\n", *self.texts).alias("text"))
        postings = texts.groupBy("shard").applyInArrow(_postings, "shard long, gram string, slots binary")
        postings.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.root}/postings/segment={segment}")
        self.spark.range(1).select(F.lit(whole).alias("whole")).coalesce(1).write.mode("overwrite").json(f"{self.root}/named/segment={segment}")

    def lookup(self, terms: DataFrame, block_terms: int = 20_000) -> DataFrame:
        """(segment, shard, slot, term): items that hold all grams of a term, and so all that contain it.

        Terms are cut into bounded blocks; each meets the postings of its grams in each shard.
        """
        segments = self._segments()
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        terms = terms.select("term", grams_of(F.col("term")).alias("grams"))
        needed = terms.select(F.explode("grams").alias("gram")).distinct()
        stored = lambda: read_or_empty(self.spark, f"{self.root}/postings", "shard long, gram string, slots binary, segment long").where(F.col("segment").isin(segments))
        postings = stored().join(needed, "gram", "left_semi")
        sizes = terms.agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_terms), F.lit(1)).cast("int").alias("_blocks"))
        left = attach_row(postings, sizes).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        shards = stored().select("segment", "shard").distinct()
        # Every block of terms meets every shard: the terms, cut into a row per block, cross to the shards.
        blocks = attach_row(terms, sizes).withColumn("b", F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int"))
        blocks = blocks.groupBy("b").agg(F.collect_list(F.struct("term", "grams")).alias("terms"))
        right = attach_row(shards, sizes).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).join(blocks, "b")
        right = right.withColumn("t", F.explode("terms")).select("segment", "shard", "b", "t.*")
        keys = ["segment", "shard", "b"]
        left = left.select(*keys, "gram", "slots").repartition(4 * tasks, *keys)
        right = right.select(*keys, "term", "grams").repartition(4 * tasks, *keys)
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet, "segment long, shard long, slot long, term string")
        return hits.join(self._replaced(segments), _PLACE, "left_anti")

    def search(self, queries: DataFrame, pivots: int = 3) -> DataFrame:
        """(query_id, id, relevance) as ``search.batch_search`` gives it, from the stored index."""
        words = cut_lineage(queries.select("query_id", tx.words(F.col("query")).alias("_w")))
        wanted = search.pivot_terms(words, pivots)
        hits = cut_lineage(self.lookup(wanted.select("term").distinct()))
        found = search.rarest_terms(wanted, hits).join(hits, "term").select("query_id", *_PLACE)
        items = self._items(self._segments()).where("live").select(*_PLACE, "id", *self.texts)
        # Texts meet their queries last, so that no text is shuffled once for each of its queries.
        rows = found.join(words, "query_id").join(items, _PLACE)
        return search.scored(rows).unionByName(search.blank_queries(words, items.schema["id"].dataType))
