"""Extraction stage, configuration files, sinks and streams end to end."""

import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_plans import call_rows, collected, frame, plain_outages

from fieldloom.functions import markdown as md
from fieldloom.operators import capture, changes, configuration, extraction, jobs, publishing, records
from fieldloom.sources import config, sinks
from fieldloom.streaming import jobs as streams
from fieldloom.streaming.sinks import ChangeLog

JOB_SCHEMA = "source_id long, prompt_id long, markdown string, extract_prompt string, validate_prompt string, context map<string,string>"


def test_run_extraction(spark):
    rows = [
        (1, 1, "short\nthe longest line", "Find {k}", "Check: {raw_result}", {"k": "v"}), (2, 1, "x", "Find", "Check {oops}", {}), (3, 1, "", "Find", "Check: {raw_result}", {}),
    ]
    got = {r["source_id"]: r for r in extraction.run_extraction(spark.createDataFrame(rows, JOB_SCHEMA)).collect()}
    assert (got[1]["validated_result"], got[1]["validation_quality"], got[1]["final_confidence"]) == ("the longest line", "HIGH", 0.8)
    assert got[2]["error"] == "Prompt format error: 'oops'" and got[2]["validation_quality"] == "INSUFFICIENT" and got[2]["raw_result"] == "x"
    assert got[3]["error"] == "Empty extraction result" and got[3]["final_confidence"] == 0.0


def test_failing_model_gives_error_rows(spark):
    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("endpoint down")

    rows = [(1, 1, "a", "Find", "Check: {raw_result}", {})]
    got = extraction.run_extraction(spark.createDataFrame(rows, JOB_SCHEMA), broken).first()
    assert got["error"] == "endpoint down" and got["validation_notes"] == "endpoint down" and got["raw_result"] is None


def test_model_sees_context_and_prompt(spark):
    def echo(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": batch["message"].to_numpy(), "finish_reason": ["length"] * len(batch)})

    rows = [(1, 1, "ground", "Find {k}", "Check {raw_result} {{k}}", {"k": "v"})]
    got = extraction.run_extraction(spark.createDataFrame(rows, JOB_SCHEMA), echo).first()
    assert got["raw_result"] == "Kontext:\nground\n\nAufgabe:\nFind v" and got["raw_confidence"] == 0.6


def test_translation_language_must_be_known(spark):
    rows = spark.createDataFrame([(1, "Summary", "Projects", None, "Text")], "extraction_id long, display_name string, category string, translation_context string, validated_result string")
    assert extraction.translation_prompts(rows, "xx").first()["error"] == "no language name for code 'xx'"
    got = extraction.translation_prompts(rows, "fr").first()
    assert got["error"] is None and "to French." in got["prompt"] and got["max_tokens"] == 8


CONFIG = """
category:
  internal_name: guide
  display_name: Guide
  steckbrief_template: "# $title"
  field_groups: {base: [title, ghost], more: []}
  active_groups: [base, more]
prompts:
  - {internal_name: title, display_name: Title, field_group: base, prompt_template: Find, output_format: list}
  - {internal_name: other, display_name: Other, field_group: base, extract_prompt: Old, field_type: text, translatable: false, required_confidence: 0.9}
  - {internal_name: other, display_name: Twice}
"""


def test_category_configs(spark, tmp_path):
    (tmp_path / "guide.yaml").write_text(CONFIG)
    (tmp_path / "bad.yaml").write_text("category: [")
    (tmp_path / "none.yaml").write_text("prompts: []")
    configs = config.read_category_configs(spark, str(tmp_path))
    assert {r["config"] for r in configs.where("error IS NOT NULL").collect()} == {"bad.yaml", "none.yaml"}
    rows = config.declared_prompts(configs).orderBy("display_order").collect()
    assert [(r["internal_name"], r["extract_prompt"], r["field_type"], r["display_order"]) for r in rows] == [("title", "Find", "list", 10), ("other", "Old", "text", 20), ("other", "", "text", 30)]
    assert [(r["translatable"], r["required_confidence"]) for r in rows] == [(True, 0.6), (False, 0.9), (True, 0.6)]
    assert rows[0]["validate_prompt"] == config.DEFAULT_VALIDATE_PROMPT
    found = {(r["problem"], r["detail"]) for r in configuration.validate_config(**config.config_tables(configs)).where("config = 'guide.yaml'").collect()}
    broken = configuration.validate_config(**config.config_tables(configs)).where("config <> 'guide.yaml'").collect()
    assert {(r["config"], r["problem"]) for r in broken} == {("bad.yaml", "unreadable definition"), ("none.yaml", "unreadable definition")}
    assert found == {("unknown prompt in group", "base.ghost"), ("active group without fields", "more"), ("duplicate prompt", "other"),
                     ("missing prompt field", "3: field_group"), ("no prompt text", "3")}


def test_written_configs_are_read_back(spark, tmp_path):
    texts = [("guide", CONFIG), ("007", CONFIG), ("a b#/c", "category: ["), ("empty", ""), ("list", "[1]")]
    config.write_category_configs(spark.createDataFrame(texts, "config string, text string"), str(tmp_path / "out"))
    configs = config.read_category_configs(spark, str(tmp_path / "out"), written=True)
    assert {r["config"]: r["error"] is None for r in configs.collect()} == {"guide": True, "007": True, "a b#/c": False, "empty": False, "list": False}
    assert config.declared_prompts(configs).count() == 6


def test_integrity_checks_find_one_bad_row(spark):
    df = spark.createDataFrame([(1, 5, "pending"), (1, 6, "odd"), (2, None, "failed")], "id long, parent long, status string")
    parents = spark.createDataFrame([(5,)], "pid long")
    assert records.duplicate_keys(df, ["id"]).collect() == [(1, 2)]
    assert [r["parent"] for r in records.dangling(df, "parent", parents, "pid").collect()] == [6]
    assert [r["status"] for r in records.outside_enum(df, "status", records.SOURCE_STATES).collect()] == ["odd"]


def test_robots(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x"), (2, "https://a.org/private/y"), (3, "https://b.org/private/y"), (4, "https://c.org/z")], "id long, url string")
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private"), ("c.org", "\x00 not : rules")], "host string, robots string")
    assert sorted(r["id"] for r in capture.robots_filter(pages, robots, "agent").collect()) == [1, 3, 4]


def test_manual_edits_survive_unless_forced(spark):
    now = spark.createDataFrame([(1, 1, "edited", True), (1, 2, "old", False)], "source_id long, prompt_id long, validated_result string, is_manual_edit boolean")
    new = spark.createDataFrame([(1, 1, "n"), (1, 2, "n"), (1, 3, "n")], "source_id long, prompt_id long, validated_result string")
    value = lambda force: [r["validated_result"] for r in changes.upsert_extractions(now, new, force).orderBy("prompt_id").collect()]
    assert value(False) == ["edited", "n", "n"] and value(True) == ["n", "n", "n"]


def test_sinks(spark, tmp_path):
    cats = spark.createDataFrame([(1, "a", True), (2, "b", False)], "category_id long, internal_name string, is_active boolean")
    profiles = spark.sql("SELECT id AS source_id, true AS published, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS generated_at FROM range(5)")
    sinks.write_sitemap(publishing.sitemap(cats, profiles, "https://h", "2024-06-01"), str(tmp_path / "map"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "map" / "part-*")))
    assert text.count("<url>") == 8 and text.count("<urlset") == text.count("</urlset>") == 1 and text.startswith("<?xml")
    items = spark.createDataFrame([("1", "ä"), ("2", "b")], "id string, title string")
    sinks.write_search_index(items, str(tmp_path / "index"))
    lines = [json.loads(line) for f in glob.glob(str(tmp_path / "index" / "part-*")) for line in open(f)]
    assert sorted(x["title"] for x in lines) == ["b", "ä"]
    entries = publishing.entity_index(spark.createDataFrame([(1, "university", "U"), (2, "location", "L")], "entity_id long, entity_type string, canonical_name string"),
                                      spark.createDataFrame([(1, "u2"), (1, "u1")], "entity_id long, variant_name string"))
    sinks.write_entity_index(entries, str(tmp_path / "ent"))
    back = {r["section"]: r for r in spark.read.json(str(tmp_path / "ent")).collect()}
    assert back["institutions"]["search_terms"] == ["U", "u1", "u2"] and back["other"]["name"] == "L"
    for version in ("1", "2"):
        sinks.write_version(items.withColumn("v", F.lit(version)), str(tmp_path / "t"), version)
    assert {r["v"] for r in sinks.read_current(spark, str(tmp_path / "t")).collect()} == {"2"}


def write_files(df, folder, parts):
    """One file per slice with rising modification times, so that batches keep the order."""
    for i, part in enumerate(parts):
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
        for f in glob.glob(folder + "/*.parquet"):
            if os.path.getmtime(f) > 1_000_000_000:
                os.utime(f, (1000 + i, 1000 + i))


def test_outage_stream_equals_batch(spark, tmp_path):
    rows = sorted(call_rows(6, 900), key=lambda r: r[1:3])
    write_files(frame(spark, rows[:1]), str(tmp_path / "in"), [rows[:300], rows[300:600], rows[600:]])
    calls = streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    got = streams.outage_stream(calls, str(tmp_path / "work"), 3, 20)
    assert collected(got, spark.createDataFrame([], "service_id long, kind int, a long, b long"))[0] == plain_outages(rows, 3, 20_000_000)[0]


def test_job_state_stream_in_any_order(spark, tmp_path):
    schema = "event_id long, job_id long, ts timestamp_ntz, status string, error string"
    base = pd.Timestamp("2024-01-01").to_pydatetime()
    rows = [(i, i % 7, base + pd.Timedelta(minutes=(i * 37) % 500), ["pending", "running", "failed", "completed"][i % 4], f"e{i}" if i % 4 == 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, schema)
    write_files(df, str(tmp_path / "in"), [rows[100:], rows[:50], rows[50:100]])
    got = streams.job_state_stream(streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "work"))
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.job_state(df).select(*got.columns).collect()))


def test_batch_that_runs_again_changes_nothing(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "t"), "id long, v string")
    assert log.rows().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    log.put(0, rows((1, "a"), (2, "a")))
    log.put(1, rows((1, "b")))
    log.put(1, rows((1, "b")))
    want = [(1, "b"), (2, "a")]
    assert sorted(map(tuple, log.latest(["id"]).collect())) == want
    assert sorted(map(tuple, log.latest(["id"], before=1).collect())) == [(1, "a"), (2, "a")]


def test_folded_changes_give_the_same_table(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    log = ChangeLog(spark, str(tmp_path / "t"), "id long, v string", keys=("id",), compact_every=2)
    for n in (0, 1, 1, 2, 3, 4):
        log.put(n, rows((n % 2, f"v{n}"), (10 + n, "x")))
    want = sorted([(0, "v4"), (1, "v3"), *((10 + n, "x") for n in range(5))])
    assert sorted(map(tuple, log.latest(["id"]).collect())) == want
    assert log.rows().count() < 12 and log.rows().where("batch = 4").count() == 2
    assert sorted(map(tuple, log.latest(["id"], before=2).collect())) == [(0, "v0"), (1, "v1"), (10, "x"), (11, "x")]


def test_index_stream_keeps_the_newest_version(spark, tmp_path):
    schema = "source_id long, version_ts timestamp, published boolean, markdown_content string"
    at = lambda h: pd.Timestamp(2024, 1, 1, h).to_pydatetime()
    parts = [[(1, at(1), True, "# old"), (1, at(3), True, "# new"), (2, at(1), True, "# two")], [(1, at(2), True, "# late"), (2, at(4), False, "# gone")], [(3, at(1), True, "# three")]]
    df = spark.createDataFrame(parts[0], schema)
    write_files(df, str(tmp_path / "in"), parts)
    build = lambda rows: rows.select(F.col("source_id").cast("string").alias("id"), md.profile_title(F.col("markdown_content")).alias("title"))
    got = streams.index_stream(streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "work"), build)
    assert sorted((r["id"], r["title"]) for r in got.collect()) == [("1", "new"), ("3", "three")]


def test_stuck_watch_drops_keys_that_move_on(spark, tmp_path):
    at = lambda h, m=0: pd.Timestamp(2024, 1, 1, h, m).to_pydatetime()
    parts = [[(1, at(1), "extracting"), (2, at(1), "extracting"), (3, at(1), "extracting")], [(2, at(1, 30), "completed"), (9, at(2, 59), "other")], [(9, at(4), "other")]]
    df = spark.createDataFrame(parts[0], "key long, ts timestamp, status string")
    write_files(df, str(tmp_path / "in"), parts)
    got = streams.collect_stream(streams.stuck_watch(streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)), str(tmp_path / "work"))
    assert sorted(r["key"] for r in got.collect()) == [1, 3]


@pytest.mark.parametrize("now,want", [("2024-01-01 02:00:00", []), ("2024-01-01 02:00:01", [1])])
def test_stuck_limit_is_strict(spark, now, want):
    df = spark.sql("SELECT 1L AS source_id, 'extracting' AS status, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS updated_at, '' AS error_message")
    assert [r[0] for r in records.stuck_extracting(df, F.expr(f"TIMESTAMP_NTZ '{now}'")).collect()] == want


def test_capture_stream_with_failed_and_unknown_pages(spark, tmp_path):
    body = "<html><head><title>T</title></head><body><p>text</p></body></html>"
    parts = [[("https://h/1", body), ("https://h/2", " "), ("https://h/9", body)], [("https://h/1", body), ("https://h/3", body)]]
    df = spark.createDataFrame(parts[0], "url string, html string")
    write_files(df, str(tmp_path / "in"), parts)
    schema = ("source_id long, url string, status string, category_id long, markdown_content string, markdown_size long, pages_crawled long, "
              "crawled_at timestamp_ntz, error_message string")
    sources = spark.createDataFrame([(i, f"https://h/{i}", "pending", 1, None, None, None, None, None) for i in (1, 2, 3, 4)], schema)
    mapping = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "category_id long, prompt_id long")
    prompts = spark.createDataFrame([(1, True), (2, True), (3, False)], "prompt_id long, is_active boolean")
    pages = streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    table, made = streams.capture_stream(pages, sources, mapping, prompts, str(tmp_path / "work"), F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))
    got = {r["source_id"]: r for r in table.collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "crawled", 2: "failed", 3: "crawled", 4: "pending"}
    assert got[2]["error_message"] == "empty page" and got[1]["category_id"] == 1
    assert got[1]["markdown_content"].endswith("## Page-Type: PRIMARY\n\ntext\n") and "Crawl-Timestamp: 2024-06-01T00:00:00Z" in got[1]["markdown_content"]
    assert sorted(map(tuple, made.collect())) == [(1, 1), (1, 2), (3, 1), (3, 2)]


def test_streams_read_tables_that_are_files_or_folders_of_parts(spark, tmp_path):
    rows = spark.range(0, 30, 1, 3).select("id", F.concat(F.lit("t"), "id").alias("text"))
    rows.write.parquet(str(tmp_path / "in" / "a.parquet"))
    rows.where("id < 5").coalesce(1).write.parquet(str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("part-*.parquet")
    (tmp_path / "in" / "b.parquet").write_bytes(file.read_bytes())
    for name, n in (("a.parquet", 30), ("b.parquet", 5), ("*.parquet", 35)):
        got = streams.collect_stream(streams.file_stream(spark, str(tmp_path / "in"), name, 2), str(tmp_path / f"work{n}"))
        assert got.count() == n and got.where("text = concat('t', id)").count() == n


def test_edited_links_are_dealt_to_tasks_by_rows(spark):
    links = spark.createDataFrame([(1, 2, 10), (1, 2, 20), (None, 3, 30), (2, 3, 40), (4, None, 50)], "category_id long, prompt_id long, display_order long")
    add = spark.createDataFrame([(1, 2), (7, 7), (7, 7), (None, 3), (2, 3)], "category_id long, prompt_id long")
    remove = spark.createDataFrame([(2, 3), (None, 3)], "category_id long, prompt_id long")
    out = changes.edit_links(links, add, remove)
    got = sorted([tuple(r) for r in out.collect()], key=str)
    assert got == sorted([(1, 2, 10), (1, 2, 20), (None, 3, 30), (4, None, 50), (7, 7, None), (None, 3, None), (2, 3, None)], key=str)
    # Not merged by size: a task would hold all rows that fit a number of compressed bytes.
    assert out.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_requests_are_read_twice_and_their_addresses_trimmed_once(spark, capsys):
    requests = spark.createDataFrame(
        [(1, " a.org/x "), (2, "https://a.org/x"), (3, " "), (4, None), (5, "b.org"), (5, "c.org"), (None, "d.org"), (6, "old.org")], "request_id long, url string").withColumn(
        "category_id", F.lit(1)).withColumn("rate_limit", F.lit(None).cast("double"))
    sources = spark.createDataFrame([("https://old.org",), (None,)], "url string")
    refused = changes.register_sources(sources, requests)[2]
    got = sorted([tuple(r) for r in refused.collect()], key=str)
    taken = "url already registered"
    assert got == sorted([(2, "https://a.org/x", taken), (3, " ", "invalid url"), (4, None, "invalid url"), (None, "d.org", taken), (6, "old.org", taken)], key=str)
    capsys.readouterr()
    refused.explain()
    assert capsys.readouterr().out.count("regexp_replace") < 8
