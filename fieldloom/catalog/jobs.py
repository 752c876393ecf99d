"""Backlog, job state and outage queries over the event log."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.operators import jobs as j

_PRIORITY = "CASE WHEN job_type = 'extract' AND dependent THEN 40 ELSE CASE job_type WHEN 'crawl' THEN 100 WHEN 'extract' THEN 50 WHEN 'validate' THEN 45 WHEN 'normalize' THEN 30 WHEN 'translate' THEN 20 WHEN 'generate' THEN 10 END END"


@query("backlog_rank", f"""SELECT job_id, priority, row_number() OVER (ORDER BY priority DESC, scheduled_at, job_id) AS rank FROM (
    SELECT *, {_PRIORITY} AS priority FROM fx_job WHERE status = 'pending') WHERE priority IS NOT NULL""")
def backlog_rank(t):
    return j.backlog_rank(t.fx_job)[0].select("job_id", "priority", "rank")


@query("unknown_jobs", f"SELECT job_id, job_type, 'no priority for job type ' || job_type AS error FROM fx_job WHERE status = 'pending' AND {_PRIORITY} IS NULL")
def unknown_jobs(t):
    return j.backlog_rank(t.fx_job)[1]


@query("queue_status", """SELECT 'queue' AS section, 'size' AS name, count(*) AS n FROM fx_job WHERE status = 'pending' UNION ALL SELECT 'pending', job_type, count(*) FROM fx_job WHERE status = 'pending' GROUP BY ALL
    UNION ALL SELECT 'state', status, count(*) FROM fx_job GROUP BY ALL""")
def queue_status(t):
    return j.queue_status(t.fx_job)


@query("queue_sample", f"SELECT job_id, job_type, source_id FROM (SELECT *, {_PRIORITY} AS priority FROM fx_job WHERE status = 'pending') WHERE priority IS NOT NULL ORDER BY priority DESC, scheduled_at, job_id LIMIT 10")
def queue_sample(t):
    return j.queue_sample(t.fx_job).select("job_id", "job_type", "source_id")


@query("job_state", """SELECT job_id, CASE WHEN last = 'failed' AND attempts < 3 THEN 'pending' ELSE last END AS status, attempts, started_at, completed_at, CASE WHEN attempts >= 3 THEN failed END AS failed_at, last_error FROM (
    SELECT job_id, arg_max(status, (ts, event_id)) AS last, count(*) FILTER (status = 'failed') AS attempts, max(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status = 'completed') AS completed_at,
      max(ts) FILTER (status = 'failed') AS failed, arg_max(error, (ts, event_id)) FILTER (status = 'failed') AS last_error FROM fx_job_event GROUP BY job_id)""")
def job_state(t):
    return j.job_state(t.fx_job_event)


def calls(t):
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return t.fx_call.select("event_id", "service_id", micros.alias("ts_us"), "success")


@query("outage_episodes")
def outage_episodes(t):
    return j.outage_episodes(calls(t), threshold=10, timeout_seconds=300)[0]
