"""Fingerprints of documents by one-permutation MinHash, with DataFrame functions only.

A text's set is its distinct runs of ``SHINGLE`` words; a shorter text is one shingle.
Each shingle is hashed once: the high bits of the hash choose one of ``BINS`` bins, and a
bin keeps its least hash.  A bin that stays empty borrows from the first bin that is not
empty in a random order of bins of its own (optimal densification): the first ``PROBES``
of that order are places drawn by a hash, after them all bins stand by their hash.  Of
each bin's value the ``BITS`` low-order bits are kept, eight bins to a 64-bit integer.

The likeness of two fingerprints is the share of equal bins, freed of the share that low
bits have in common by chance: (share - 2^-BITS) / (1 - 2^-BITS), at least 0.

Defined cases: a null text is empty; texts without words have the fingerprint '', are
wholly alike (1) and unlike any other (0); rows without an id come last, rows that repeat
an id in the order of their texts' SHA-256; equal rows follow each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.llm.tables import stored
from fieldloom.plans.order import attach_row, sorted_blocks

SHINGLE = 5
#: Bins of 8 bits: 2 to the power BIN_BITS.
BIN_BITS, BITS = 8, 8
BINS = 1 << BIN_BITS
PROBES = 6
_LANES = 64 // BITS
_SEPARATORS = r"[ \t-\r]+"


def _shingles(hashes: Column, words: Column) -> Column:
    n = F.size(words)
    runs = F.transform(
        F.when(n >= SHINGLE, F.sequence(F.lit(1), n - (SHINGLE - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.element_at(hashes, i + j) for j in range(SHINGLE))),
    )
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(n, hashes))).otherwise(F.array().cast("array<bigint>"))


def _bin(value: Column) -> Column:
    return F.shiftright(value, 64 - BIN_BITS).cast("int") + BINS // 2


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << BITS) - 1))


def _probe(dense: Column, bin_: Column, attempt: int) -> Column:
    return F.get(dense, F.pmod(F.xxhash64(bin_, F.lit(attempt)), F.lit(BINS)).cast("int"))


def _last_resort(least: Column, bin_: Column) -> Column:
    """The bin that comes first in the order by hash, among those that are not empty."""
    ordered = F.transform(least, lambda x: F.struct(F.xxhash64(bin_, _bin(x), F.lit("order")).alias("turn"), _low(x).alias("low")))
    return F.array_min(ordered)["low"]


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the packed fingerprint ``name`` (an array of longs, empty for no words) of a text column.

    Every step is a column of its own, so no array is made again inside a lambda.
    """
    words, hashes, sorted_, least, bins, dense = (f"_{name}_{i}" for i in range(6))
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    rows = rows.withColumn(words, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SEPARATORS), ""))
    rows = rows.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    rows = rows.withColumn(sorted_, F.sort_array(_shingles(F.col(hashes), F.col(words))))
    # In order of the hash a bin's first value is its least.
    opens = lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(sorted_), i - 1)))
    rows = rows.withColumn(least, F.filter(sorted_, opens))
    rows = rows.withColumn(bins, F.transform(least, _bin))
    at = lambda i: F.get(F.col(least), F.array_position(bins, i).cast("int") - 1)
    rows = rows.withColumn(dense, F.transform(every, lambda i: _low(at(i))))
    full = lambda v, i: F.coalesce(v, *(_probe(F.col(dense), i, t) for t in range(PROBES)), _last_resort(F.col(least), i))
    rows = rows.withColumn(dense + "_full", F.transform(dense, full))
    lane = lambda j: reduce(
        Column.bitwiseOR, (F.shiftleft(F.get(F.col(dense + "_full"), j * _LANES + t), BITS * t) for t in range(_LANES))
    )
    packed = F.when(F.size(bins) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS // _LANES - 1)), lane))
    packed = packed.otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(name, packed).drop(words, hashes, sorted_, least, bins, dense, dense + "_full")


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _differing(x: Column) -> Column:
    """How many bytes of a long are not zero: the bits of each byte are gathered in its lowest one."""
    for shift, mask in ((4, 0x0F), (2, 0x03), (1, 0x01)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(int(f"{mask:02X}" * 8, 16)))
    return F.bit_count(x)


def likeness(one: Column, other: Column) -> Column:
    """Estimated similarity, 0 to 1, of two packed fingerprints."""
    differing = F.aggregate(F.zip_with(one, other, lambda a, b: _differing(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (1 - differing / F.lit(float(BINS)) - chance) / (1 - chance))
    empty = [(F.size(x) == 0).cast("int") for x in (one, other)]
    return F.when(empty[0] + empty[1] > 0, (empty[0] * empty[1]).cast("double")).otherwise(estimate)


def _order(id_: Column, sum_: Column) -> Column:
    """Of rows with and without id; compares as rows are sorted."""
    return F.struct(id_.isNull().alias("last"), id_.alias("id"), sum_.alias("sum"))


def _in_blocks(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``block`` and ``guard`` to ``rows`` (id, sum, ...), in ranges of equally many of the ``keys`` (id, sum).

    A block ends with a copy, the guard, of the first row of the next block (the last block
    with that of the first), so that each row's follower is in its block.  Blocks are four
    times as many as shuffle partitions, which deals them evenly enough.
    """
    blocks = 4 * max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = sorted_blocks(keys, [F.col("id").asc_nulls_last(), F.col("sum")], blocks)
    # One row: the first key of each block.
    bounds = placed.where("_pos = 0").agg(F.sort_array(F.collect_list(_order(F.col("id"), F.col("sum")))).alias("bounds"))
    size = math.isqrt(blocks) + 1
    coarse = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("bounds") / size).cast("int") - 1, F.lit(0))), lambda i: F.get("bounds", i * size))
    bounds = bounds.withColumn("coarse", coarse)
    at = F.col("at")
    rows = attach_row(rows.withColumn("at", _order(F.col("id"), F.col("sum"))), bounds)
    rows = rows.withColumn("group", F.size(F.filter("coarse", lambda b: b <= at)) - 1)
    rows = rows.withColumn("block", F.col("group") * size + F.size(F.filter(F.slice("bounds", F.col("group") * size + 1, size), lambda b: b <= at)) - 1)
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guard"))
    ahead = F.struct(F.pmod(F.col("block") - 1, F.size("bounds")).alias("block"), F.lit(True).alias("guard"))
    opens = F.get("bounds", F.col("block")) == at
    rows = rows.withColumn("to", F.explode(F.when(opens, F.array(own, ahead)).otherwise(F.array(own))))
    return rows.select("id", "sum", "text", "copies", "to.block", "to.guard").repartition("block")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of ``docs`` (doc_id, text).

    The edited text is the first half of a text and the beginning of the next document.
    Texts cross the network once, to the block of their id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text")).withColumn("sum", F.sha2("text", 256))
    keys = stored(read.groupBy("id", "sum").agg(F.count(F.lit(1)).alias("copies")), "fingerprint-keys")
    # Equal rows become one, inside tasks first; where there are none, their table is empty.
    several = stored(keys.where("copies > 1").select(F.col("id").alias("k"), F.col("sum").alias("s"), "copies"), "fingerprint-repeated")
    same = F.col("id").eqNullSafe(F.col("k")) & (F.col("sum") == F.col("s"))
    once = read.join(several.drop("copies"), same, "left_anti").select("id", "sum", "text", F.lit(1).cast("long").alias("copies"))
    merged = read.join(several, same).groupBy("id", "sum").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
    blocks = _in_blocks(once.unionByName(merged), keys.select("id", "sum"))

    rows = with_fingerprint(blocks, "text", "print")
    order = Window.partitionBy("block").orderBy("guard", F.col("id").asc_nulls_last(), "sum")
    rows = rows.withColumn("follower", F.lead(F.struct("text", "print")).over(order)).where("NOT guard")
    # Of equal rows all but the last are followed by their like.
    like = F.struct(F.struct("text", "print").alias("follower"), (F.col("copies") - 1).alias("times"))
    next_ = F.struct(F.col("follower"), F.lit(1).cast("long").alias("times"))
    turns = F.when(F.col("copies") > 1, F.array(next_, like)).otherwise(F.array(next_))
    rows = rows.drop("guard").withColumn("turn", F.explode(turns)).select("id", "text", "print", "turn.follower", "turn.times")
    rows = rows.withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("follower.text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("next_print", F.col("follower.print")).drop("text", "follower")
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_print").drop("edited")
    compared = rows.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"), "times",
    )
    return compared.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_copy", "times")
