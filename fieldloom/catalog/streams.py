"""Streaming jobs run over the given files until nothing is left."""

from pyspark.sql import functions as F

from fieldloom.catalog.publishing import _description, _inst, _title
from fieldloom.catalog.registry import query
from fieldloom.functions import markdown as md
from fieldloom.streaming import jobs as s
from fieldloom.streaming.sinks import utc_instant, utc_wall, work_folder


def _stream(t, name):
    return s.file_stream(t.spark, t.sf_dir, f"{name}.parquet")


_NOW = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"


def _captured(t):
    sources = t.pages.select(
        F.col("page_id").alias("source_id"), "url", F.lit("pending").alias("status"), (F.col("page_id") % 5 + 1).alias("category_id"),
        F.lit(None).cast("string").alias("markdown_content"), F.lit(None).cast("long").alias("markdown_size"), F.lit(None).cast("long").alias("pages_crawled"),
        F.lit(None).cast("timestamp_ntz").alias("crawled_at"), F.lit(None).cast("string").alias("error_message"))
    return s.capture_stream(_stream(t, "pages"), sources, t.fx_category_prompt, t.fx_prompt, work_folder(t.spark), F.expr(_NOW))


@query("stream_captured_sources", """SELECT page_id AS source_id, url, 'crawled' AS status, 1 AS pages_crawled, TIMESTAMP '2024-06-01 00:00:00' AS crawled_at,
    '# [METADATA]' || chr(10) || 'Source-UUID: ' || url || chr(10) || 'Primary-URL: ' || url || chr(10) || 'Crawled-Pages: 1' || chr(10) || 'Crawl-Timestamp: 2024-06-01T00:00:00Z'
      || chr(10) || 'Total-Size: ' || length(html) AS head, true AS size_fits FROM pages""")
def stream_captured_sources(t):
    """The text's own head and the stored size are compared too; its body is the converter's, tested by hand."""
    return _captured(t)[0].select(
        "source_id", "url", "status", F.col("pages_crawled").cast("int").alias("pages_crawled"), "crawled_at",
        F.substring_index("markdown_content", "\n", 6).alias("head"), (F.col("markdown_size") == F.length("markdown_content")).alias("size_fits"))


@query("stream_capture_jobs", """SELECT page_id AS source_id, prompt_id FROM pages JOIN fx_category_prompt m ON m.category_id = page_id % 5 + 1 JOIN fx_prompt USING (prompt_id) WHERE is_active""")
def stream_capture_jobs(t):
    return _captured(t)[1].select("source_id", "prompt_id")


@query("stream_job_state", """SELECT job_id, CASE WHEN last = 'failed' AND attempts < 3 THEN 'pending' ELSE last END AS status, attempts, started_at, completed_at, CASE WHEN attempts >= 3 THEN failed END AS failed_at, last_error FROM (
    SELECT job_id, arg_max(status, (ts, event_id)) AS last, count(*) FILTER (status = 'failed') AS attempts, max(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status = 'completed') AS completed_at,
      max(ts) FILTER (status = 'failed') AS failed, arg_max(error, (ts, event_id)) FILTER (status = 'failed') AS last_error FROM fx_job_event GROUP BY job_id)""")
def stream_job_state(t):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "click", "running").otherwise("pending")
    log = _stream(t, "events").select("event_id", F.col("user_id").alias("job_id"), "ts", status.alias("status"), F.when(kind == "error", F.col("props")).alias("error"))
    return s.job_state_stream(log, work_folder(t.spark))


@query("stream_outages")
def stream_outages(t):
    ok = F.when(F.col("event_id") % 400 < 60, F.col("event_id") % 23 == 0).otherwise(F.col("event_type") != "error")
    calls = _stream(t, "events").select("event_id", (F.col("user_id") % 5).alias("service_id"), F.unix_micros(utc_instant(F.col("ts"))).alias("ts_us"), ok.alias("success"))
    return s.outage_stream(calls, work_folder(t.spark))


@query("stream_stuck_watch", """SELECT key, since FROM (SELECT user_id AS key, max(ts) AS since, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id)
    WHERE last = 'view' AND date_trunc('milliseconds', since) + INTERVAL '2' HOUR <= (SELECT max(ts) - INTERVAL '1' MINUTE FROM events)""".replace("SELECT key, since FROM", "SELECT key, date_trunc('milliseconds', since) AS since FROM"))
def stream_stuck_watch(t):
    status = F.when(F.col("event_type") == "view", "extracting").otherwise("other")
    log = _stream(t, "events").select(F.col("user_id").alias("key"), utc_instant(F.col("ts")).alias("ts"), status.alias("status"))
    out = s.collect_stream(s.stuck_watch(log), work_folder(t.spark))
    return out.select("key", utc_wall(F.timestamp_millis("since_ms")).alias("since"))


@query("stream_additions_per_day", """SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders
    WHERE date_trunc('day', o_orderdate) + INTERVAL '1' DAY <= (SELECT max(o_orderdate) - INTERVAL '1' DAY FROM orders) GROUP BY 1""")
def stream_additions_per_day(t):
    rows = _stream(t, "orders").select(F.col("o_orderdate").alias("created_at"))
    return s.collect_stream(s.additions_per_day_stream(rows), work_folder(t.spark))


_TEXT = "'# Doc ' || CAST(doc_id AS STRING) || chr(10) || 'Institution: Inst ' || CAST(doc_id % 20 AS STRING) || chr(10) || '## Beschreibung' || chr(10) || text"


@query("stream_index", f"""SELECT CAST(doc_id AS VARCHAR) AS id, {_title('m')} AS title, {_inst('m', 20, True)} AS institution, {_description('m')} AS description FROM (
    SELECT doc_id, {_TEXT} AS m FROM documents WHERE doc_id % 3 <> 0)""")
def stream_index(t):
    changed = _stream(t, "documents").select(
        F.col("doc_id").alias("source_id"), F.timestamp_seconds(F.col("doc_id")).alias("version_ts"), (F.col("doc_id") % 3 != 0).alias("published"), F.expr(_TEXT).alias("markdown_content"))

    def build(rows):
        text = F.col("markdown_content")
        return rows.select(
            F.col("source_id").cast("string").alias("id"), md.profile_title(text).alias("title"),
            md.profile_institution(text, lines=20, unlink=True).alias("institution"), md.section_description(text).alias("description"))

    return s.index_stream(changed, work_folder(t.spark), build)
