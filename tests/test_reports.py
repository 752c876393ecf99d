"""Places in a listing, locale order, observed writes, sitemaps, fetch plans and suggestions for many prefixes."""

import glob
import random
import re

from pyspark.sql import functions as F

from fieldloom.operators import capture, publishing, records, search
from fieldloom.operators.kept import KeptStatistics
from fieldloom.plans.order import places
from fieldloom.sources import sinks
from fieldloom.sources.versions import VersionedTable


def test_places_with_a_hot_group_and_a_null_one(spark):
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"g{i % 5}"), (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g string, k long").orderBy("g", "k")
    got = {r["id"]: r["place"] for r in places(df, "g").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        want |= {r[0]: n for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: r[2]), 1)}
    assert got == want
    assert places(df.where("false"), "g").collect() == []


def test_titles_are_in_locale_order(spark):
    titles = ["Zoo", "ähre", "Ahre", "ahrb", "Öl", "öl", "Ol", "straße", "Strasse", "Straßf", "École", "ecole", "Untitled"]
    profiles = spark.createDataFrame([(i, i, f"# {t}", True) for i, t in enumerate(titles)], "profile_id long, source_id long, markdown_content string, published boolean").withColumn(
        "generated_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    sources = profiles.select("source_id", F.lit(1).alias("category_id"))
    got = [r["title"] for r in publishing.category_listing(profiles, sources, "title").collect()]
    assert got == ["ahrb", "Ahre", "ähre", "ecole", "École", "Ol", "Öl", "öl", "Strasse", "straße", "Straßf", "Untitled", "Zoo"]


def test_observed_writes_count_what_they_write(spark, tmp_path):
    parents = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    rows = spark.createDataFrame([(i, [1, 2, 3, None][i % 4], [5, None][i % 2]) for i in range(100)], "k long, parent long, v int")
    flagged = records.with_dangling(rows, "parent", parents, "id", "dangling")
    out = sinks.write_observed(flagged, str(tmp_path / "a"), dangling=F.col("dangling"), large=F.col("v") > 4, none=F.lit(None).cast("boolean"))
    assert out.first().asDict() == {"rows": 100, "dangling": 25, "large": 50, "none": 0}
    assert spark.read.parquet(str(tmp_path / "a")).where("dangling").count() == 25
    # One pass: the rows are made once.
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    assert sinks.write_observed(rows.mapInPandas(seen, rows.schema), str(tmp_path / "b"), low=F.col("v") < 0).first().asDict() == {"rows": 100, "low": 0}
    assert made.value == 100
    assert sinks.write_observed(rows.where("k < 0"), str(tmp_path / "c"), low=F.col("v") < 0).first().asDict() == {"rows": 0, "low": 0}


def test_sitemaps_are_cut_and_closed(spark, tmp_path):
    pages = spark.range(0, 1000, 1, 7).select(F.concat(F.lit("  <url>"), "id", F.lit("</url>")).alias("xml"))
    sinks.write_sitemap(pages, str(tmp_path / "m"), most=90)
    texts = [open(f).read() for f in glob.glob(str(tmp_path / "m" / "part-*"))]
    assert all(t.startswith("<?xml") and t.rstrip().endswith("</urlset>") and t.count("<urlset") == 1 and t.count("<url>") <= 90 for t in texts)
    assert sorted(int(n) for t in texts for n in re.findall(r"<url>(\d+)</url>", t)) == list(range(1000))
    sinks.write_sitemap(pages.where("false"), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_pages_that_are_not_allowed_take_no_time(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.org/x", 0), (2, "https://a.org/private/y", 0), (3, "https://a.org/z", 0), (4, "https://b.org/private/", 5), (5, None, 0)], "request_id long, url string, ready_us long")
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private/")], "host string, robots string")
    got = {r["request_id"]: r["start_us"] for r in capture.allowed_fetch_plan(pages, robots, "bot", 4.0).collect()}
    assert got == {1: 0, 3: 250_000, 4: 5}


def test_suggestions_of_many_prefixes_equal_those_of_each(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abÄ") for _ in range(rnd.randint(1, 4)))
    items = spark.createDataFrame([(rnd.choice(["", word()]), rnd.choice([None, word(), word()])) for _ in range(60)], "institution string, category string")
    entities = spark.createDataFrame([(i, rnd.choice([None, "location"]), rnd.choice([None, word(), word(), word()])) for i in range(80)], "entity_id long, entity_type string, canonical_name string")
    variants = spark.createDataFrame([(rnd.randint(0, 90), rnd.choice([None, "", word()])) for _ in range(80)], "entity_id long, variant_name string")
    asked = ["ab", "AB", "äa", "aba", "b", "", "bÄ", "no such", None, "ab"]
    prefixes = spark.createDataFrame([(p,) for p in asked], "prefix string")
    got = search.autocomplete_batch(items, entities, variants, prefixes).collect()
    for prefix in {p for p in asked if p is not None}:
        one = sorted((r["place"], r["rank"], r["name"]) for r in got if r["prefix"] == prefix)
        want = [(r["rank"], r["name"]) for r in search.autocomplete(items, entities.where("canonical_name IS NOT NULL"), variants, prefix).collect()]
        assert [x[1:] for x in one] == want and [x[0] for x in one] == list(range(1, len(want) + 1))
    assert len({r["prefix"] for r in got}) == 5
    assert search.autocomplete_batch(items, entities, variants, prefixes.where("false")).collect() == []


def test_reports_of_empty_tables(spark, tmp_path):
    table = lambda name, schema: VersionedTable(spark, str(tmp_path / name), schema, ["source_id"], buckets=2)
    sources = table("s", "source_id long, status string, category_id long")
    extractions = table("e", "source_id long, prompt_id long, translation_status string, validated_result string, validated_result_en string, final_confidence double, linked_entity_id long")
    kept = KeptStatistics(sources, extractions, table("p", "source_id long, published boolean")).refresh()
    assert {r["n"] for r in kept.count_by_status().collect()} == {0}
    assert {r["metric"]: r["value"] for r in kept.dashboard().collect()}["avg_confidence"] == 0.0
    new = [(1, 1, None, "x", None, 0.5, None), (1, 2, "translated", "y", "z", None, 3), (2, 1, "failed", "", None, 0.25, None), (2, 2, "translated", "w", None, 0.9, None)]
    extractions.apply(spark.createDataFrame(new, extractions.schema), lambda old, rows: old.unionByName(rows))
    prompts = spark.createDataFrame([(1, True), (2, True), (3, None)], "prompt_id long, translatable boolean")
    got = kept.refresh().translation_stats(prompts).first().asDict()
    assert got == {"total": 3, "translatable": 3, "translated": 2, "pending": 2, "failed": 1, "skipped": 0, "progress": 66.7}
    numbers = {r["metric"]: r["value"] for r in kept.dashboard().collect()}
    assert (numbers["total_extractions"], numbers["low_confidence"], numbers["linked_extractions"], numbers["avg_confidence"]) == (4.0, 2.0, 1.0, 55.0)


def test_suggestions_behind_many_entities_of_an_institutions_name(spark):
    items = spark.createDataFrame([("abx", None)], "institution string, category string")
    entities = spark.createDataFrame([(i, None, "abx") for i in range(100, 1100)] + [(50, "location", "aby")], "entity_id long, entity_type string, canonical_name string")
    variants = spark.createDataFrame([(50, "ab" * 30), (50, "xÄab")], "entity_id long, variant_name string")
    prefixes = spark.createDataFrame([("aB",), ("Äa",), ("ab" * 30,), ("ab" * 40,)], "prefix string")
    got = {(r["prefix"], r["place"], r["rank"], r["name"]) for r in search.autocomplete_batch(items, entities, variants, prefixes).collect()}
    assert got == {("aB", 1, 1, "abx"), ("aB", 2, 2, "aby"), ("Äa", 1, 2, "aby"), ("ab" * 30, 1, 2, "aby")}


def test_texts_are_dealt_once_and_not_for_each_query(spark, capsys):
    items = spark.createDataFrame([(str(i), f"Title {i}", f"word{i % 7} common") for i in range(50)], "id string, title string, fulltext string")
    items = items.select("*", *[F.lit("").alias(c) for c in ("description", "institution", "category")], F.array().cast("array<string>").alias("entity_variants"))
    queries = spark.createDataFrame([(1, "word3 common"), (2, "title common"), (3, "none")], "query_id long, query string")
    found = search.batch_search(items, queries)
    assert found.groupBy("query_id").count().orderBy("query_id").collect() == [(1, 7), (2, 50)]
    capsys.readouterr()
    found.explain("formatted")
    nodes = re.split(r"\n\n", capsys.readouterr().out)
    assert sum("Exchange" in n.split("\n")[0] and "_l_fulltext" in n for n in nodes) == 1
