"""Versioned tables, kept counts and the stored index of grams."""

import os

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import changes, search
from fieldloom.operators.grams import GramIndex
from fieldloom.operators.kept import KeptCounts, average
from fieldloom.sources.versions import StaleVersion, VersionedTable
from fieldloom.streaming import jobs

SCHEMA = "k long, part long, v string, n double"


def upsert(old, new):
    return changes.upsert(old, new, ["k", "part"])


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=8)
    made.replace(spark.range(4_000).select((F.col("id") / 4).cast("long").alias("k"), (F.col("id") % 4).alias("part"), F.lit("old").alias("v"), (F.col("id") % 7).cast("double").alias("n")))
    return made


def test_a_change_set_rewrites_its_buckets_only(spark, table, tmp_path):
    before = size_of(tmp_path / "t" / "data")
    assert table.apply(spark.createDataFrame([(5, 1, "new", None), (5, 9, "new", 1.0)], SCHEMA), upsert) == 1
    assert size_of(tmp_path / "t" / "data") - before < before / 4
    old, new = table.manifest(0), table.manifest(1)
    assert sum(old[b] != new[b] for b in range(8)) == 1
    assert table.read().count() == 4_001 and table.read().where("v = 'new'").count() == 2
    # A version that has been read stays as it was.
    assert table.read(0).count() == 4_000 and table.read(0).where("v = 'new'").count() == 0
    assert table.apply(spark.createDataFrame([], SCHEMA), upsert) == 1


def test_a_lost_or_late_commit_leaves_the_newest_version(spark, table):
    def lost(old, new):
        return upsert(old, new).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        table.apply(spark.createDataFrame([(5, 1, "new", None)], SCHEMA), lost)
    assert table.current() == 0 and table.read().where("v = 'old'").count() == 4_000

    def overtaken(old, new):
        table.apply(spark.createDataFrame([(6, 1, "first", None)], SCHEMA), upsert)
        return upsert(old, new)

    with pytest.raises(StaleVersion):
        table.apply(spark.createDataFrame([(5, 1, "second", None)], SCHEMA), overtaken)
    assert table.current() == 1 and [r.k for r in table.read().where("v <> 'old'").collect()] == [6]


def test_an_empty_table_and_all_rows_deleted(spark, tmp_path):
    made = VersionedTable(spark, str(tmp_path / "e"), SCHEMA, ["k"], buckets=4)
    assert made.current() == -1 and made.read().count() == 0
    made.apply(spark.createDataFrame([(None, 1, None, None), (2, 1, "a", 1.0)], SCHEMA), lambda old, new: old.unionByName(new))
    view = KeptCounts(made, "v", ["v"], {"n_sum": F.col("n")})
    assert {(r.v, r.n, r.n_sum and float(r.n_sum)) for r in view.refresh().collect()} == {(None, 1, 0), ("a", 1, 1.0)}
    made.apply(spark.createDataFrame([(2,), (None,)], "k long"), lambda old, gone: old.where("false"))
    assert made.read().count() == 0 and view.refresh().count() == 0


def test_kept_counts_equal_a_new_count(spark, table):
    view = KeptCounts(table, "by_v", ["v", "part"], {"total": F.col("n").cast("decimal(18,4)"), "scored": F.col("n").isNotNull().cast("int")})
    view.refresh()
    table.apply(spark.range(0, 300, 3).select(F.col("id").alias("k"), F.lit(2).cast("long").alias("part"), F.lit("new").alias("v"), F.lit(None).cast("double").alias("n")), upsert)
    table.apply(spark.createDataFrame([(5_000, 0, "new", 0.1), (5_001, 0, None, 0.2)], SCHEMA), upsert)
    assert view.counted() == 0
    view.refresh()
    table.apply(spark.range(100, 200).select(F.col("id").alias("k")), lambda old, gone: old.join(gone, "k", "left_anti"))
    got = view.refresh()
    assert view.counted() == 3
    want = table.read().groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("n").cast("decimal(18,4)")).cast("double").alias("m"))
    plain = lambda rows: {(r.v, r.part, r.n, r.m if r.m is None else round(r.m, 5)) for r in rows}
    assert plain(got.select("v", "part", "n", average("total", "scored").alias("m")).collect()) == plain(want.collect())


FIELDS = "id string, title string, description string, institution string, category string, fulltext string, entity_variants array<string>"


def item(i, text, version=1, live=True):
    return (str(i), f"Title {i}", None, "Ünïted", "c", text, ["V-1"], version, live)


def test_grams_find_what_a_scan_finds(spark, tmp_path):
    words = ["alpha", "al", "l", "ph", "beta", "bet", "ünï", "v-1", "título", "zz", "😀x", "a" * 300]
    texts = [" ".join(words[j] for j in range(len(words)) if (i >> j) & 1) for i in range(0, 4_096, 37)]
    rows = [item(i, t) for i, t in enumerate(texts)] + [item("empty", ""), item("null", None)]
    items = spark.createDataFrame(rows, FIELDS + ", version long, live boolean")
    asked = [(j, w) for j, w in enumerate(words)] + [(100, "Alpha  BETA"), (101, ""), (102, "nothing"), (103, "l l zz"), (104, "title 7")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = GramIndex(spark, str(tmp_path / "g"), shard_items=16)
    index.update(0, items)
    got = sorted(map(tuple, index.search(queries).collect()), key=str)
    assert got == sorted(map(tuple, search.batch_search(items, queries).collect()), key=str) and len(got) > 300


def test_index_stream_in_batches(spark, tmp_path):
    """Late older versions, removals and repeats; the second form writes all items anew in its last batch."""
    batches = [
        [(1, 10, True, "one first"), (2, 10, True, "two first"), (3, 10, True, "three first")],
        [(1, 20, True, "one second"), (2, 20, False, "two gone"), (4, 5, True, "four first"), (4, 4, True, "four zero")],
        [(1, 15, True, "one late"), (2, 12, True, "two late"), (3, 30, True, "three second"), (3, 30, True, "three second")],
    ]
    for n, rows in enumerate(batches):
        changed = spark.createDataFrame(rows, "source_id long, at long, published boolean, body string")
        changed.select("source_id", F.timestamp_seconds("at").alias("version_ts"), "published", "body").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}.parquet"))

    def build(rows):
        text = F.col("body")
        none = F.lit(None).cast("string")
        return rows.select(F.col("source_id").cast("string").alias("id"), none.alias("title"), none.alias("description"), none.alias("institution"),
                           none.alias("category"), text.alias("fulltext"), F.lit(None).cast("array<string>").alias("entity_variants"))

    queries = spark.createDataFrame([(1, "first"), (2, "second"), (3, "late"), (4, "gone"), (5, "o")], "query_id long, query string")
    want = {(1, "4"), (2, "1"), (2, "3"), (5, "1"), (5, "4"), (5, "3")}
    schema = spark.read.parquet(str(tmp_path / "in" / "0.parquet")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    index = jobs.gram_index_stream(stream, str(tmp_path / "out"), build)
    assert {(r.query_id, r.id) for r in index.search(queries).collect()} == want
    folded = GramIndex(spark, str(tmp_path / "folded"), compact_every=3)
    for n, rows in enumerate(batches):
        last = spark.createDataFrame(rows, "source_id long, version long, live boolean, body string")
        none = F.lit("")
        folded.update(n, last.select(F.col("source_id").cast("string").alias("id"), "version", "live", none.alias("title"), none.alias("description"), none.alias("institution"),
                                     none.alias("category"), F.col("body").alias("fulltext"), F.array().cast("array<string>").alias("entity_variants")))
    assert folded._segments() == [2] and {(r.query_id, r.id) for r in folded.search(queries).collect()} == want
