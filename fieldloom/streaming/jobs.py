"""Streaming forms of the capture chain, job state, alerts and index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom.functions.html import with_markdown
from fieldloom.operators import capture, changes, jobs, records
from fieldloom.operators.grams import GramIndex
from fieldloom.streaming.sinks import ChangeLog, run_available, utc_instant, utc_wall


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is that of the files already there.

    What ``pattern`` names may be files or folders of part files.
    """
    # In braces the name is a glob too, and files of folders that it names are read as well.
    paths = f"{folder.rstrip('/')}/{{{pattern}}}"
    schema = spark.read.parquet(paths).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(paths)


# --- pages to captured sources and extract jobs -------------------------------


def capture_stream(pages: DataFrame, sources: DataFrame, mapping: DataFrame, prompts: DataFrame, folder: str, now) -> tuple[DataFrame, DataFrame]:
    """New page files become captured sources and extract jobs.

    ``pages``: url, html.  ``sources`` is the registered table at the start.  Jobs lie in
    one folder per batch, so a repeated batch replaces its own jobs only.
    """
    spark = pages.sparkSession
    log = ChangeLog(spark, f"{folder}/sources", sources.schema, keys=("source_id",))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # A page may arrive twice; the larger body wins.
        checked = capture.read_pages(batch.select("url", "html")).groupBy("url").agg(
            F.max_by(F.struct("html", "error"), F.length(F.coalesce("html", F.lit("")))).alias("p")).select("url", "p.html", "p.error")
        # Parsed once: the batch is written and read back for its three uses.
        parsed = with_markdown(checked.withColumn("html_size", F.length(F.coalesce("html", F.lit("")))))
        parsed.join(sources.select("source_id", "url"), "url").write.mode("overwrite").parquet(f"{folder}/parsed/batch={batch_id}")
        text = spark.read.parquet(f"{folder}/parsed/batch={batch_id}")
        parts = text.where("error IS NULL").select("source_id", F.lit(0).alias("pos"), "url", "title", "markdown", "html_size")
        good = capture.consolidate_pages(parts, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        results = text.select("source_id", "error").join(good, "source_id", "left").select(
            "source_id", F.col("error").isNull().alias("success"), F.col("markdown_content").alias("markdown"),
            F.col("markdown_size").cast("long").alias("size"), F.col("pages_crawled").alias("pages"), now.alias("finished_at"), "error")
        touched = sources.join(results.select("source_id"), "source_id", "left_semi")
        log.put(batch_id, capture.apply_crawl_results(touched, results))
        fresh = log.rows().where((F.col("batch") == batch_id) & (F.col("status") == "crawled"))
        records.fan_out_extract(fresh, mapping, prompts).write.mode("overwrite").parquet(f"{folder}/jobs/batch={batch_id}")

    run_available(pages, folder, on_batch)
    made = spark.read.schema("source_id long, prompt_id long").parquet(f"{folder}/jobs")
    # A source captured again in a later batch asks for the same jobs once.
    return changes.upsert(sources, log.latest(["source_id"]), ["source_id"]), made.select("source_id", "prompt_id").distinct()


# --- job state -----------------------------------------------------------------


def job_state_stream(events: DataFrame, folder: str) -> DataFrame:
    """Latest state per job, updated batch by batch; arrival order does not matter."""
    state = jobs.job_state(events)
    log = ChangeLog(events.sparkSession, f"{folder}/jobs", state.schema, keys=("job_id",))
    run_available(state, folder, lambda batch, n: log.put(n, batch), mode="update")
    return log.latest(["job_id"])


# --- outage episodes -------------------------------------------------------------


def outage_stream(calls: DataFrame, folder: str, threshold: int = 10, timeout_seconds: int = 300) -> DataFrame:
    """Episodes over a call stream.  Calls of a batch are sorted in time; batches follow arrival."""
    spark = calls.sparkSession
    key = calls.schema["service_id"].dataType.simpleString()
    states = ChangeLog(spark, f"{folder}/states", f"service_id {key}, kind int, a long, b long", keys=("service_id",))
    parts = ChangeLog(spark, f"{folder}/parts", f"service_id {key}, opened_us long, closed_us long, failed_probes long, refused_calls long")

    def on_batch(batch: DataFrame, n: int) -> None:
        # Only earlier batches count, so a batch that runs again starts from the same states.
        begin = states.latest(["service_id"], before=n)
        found, ends = jobs.outage_episodes(batch, threshold, timeout_seconds, start=begin)
        parts.put(n, found)
        states.put(n, ends)

    run_available(calls, folder, on_batch)
    # An episode may span batches; each holds its own part.
    return parts.rows().groupBy("service_id", "opened_us").agg(
        F.max("closed_us").alias("closed_us"), F.sum("failed_probes").alias("failed_probes"), F.sum("refused_calls").alias("refused_calls"))


# --- silent sources --------------------------------------------------------------


def stuck_watch(events: DataFrame, hours: int = 2) -> DataFrame:
    """Alert (key, since) when a key stays silent in 'extracting' for ``hours``.

    ``events``: key (long), ts (timestamp), status.  Rows older than the watermark are
    dropped by Spark before they reach the state.
    """
    gap_ms = hours * 3_600_000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "since_ms": [since]})
            return
        # Only the latest row of the key matters, so batches are reduced one by one.
        latest = (state.get[0], state.get[1]) if state.exists else (-1, "")
        for batch in batches:
            times = batch["ts"].astype("datetime64[ms]").astype("int64")
            at = times.idxmax()
            if times[at] >= latest[0]:
                latest = (int(times[at]), batch["status"][at])
        state.update(latest)
        deadline = latest[0] + gap_ms
        if latest[1] != "extracting":
            state.remove()
        elif deadline > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(deadline)
        else:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "since_ms": [latest[0]]})

    return events.withWatermark("ts", "1 minute").groupBy("key").applyInPandasWithState(
        watch, "key long, since_ms long", "since_ms long, status string", "append", GroupStateTimeout.EventTimeTimeout)


# --- additions per day -------------------------------------------------------------


def additions_per_day_stream(sources: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sources per day of a stream with ``created_at``; a day is final once the watermark passes it."""
    timed = sources.select(utc_instant(F.col("created_at")).alias("created_at")).withWatermark("created_at", delay)
    counts = timed.groupBy(F.window("created_at", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(utc_wall(F.col("window.start")).cast("date").alias("day"), "n")


def collect_stream(df: DataFrame, folder: str) -> DataFrame:
    """Append-mode result as a table."""
    path = f"{folder}/out"
    (
        df.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint").option("path", path).start().awaitTermination()
    )
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- search index --------------------------------------------------------------------


def index_stream(profile_changes: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Index kept current from profile versions; the last version of a source wins.

    ``profile_changes``: source_id, version_ts, published and what ``build`` needs.
    ``build`` turns published rows into items with ``id`` = source_id.
    """
    spark = profile_changes.sparkSession
    names = [c for c in profile_changes.columns if c != "source_id"]
    empty = spark.createDataFrame([], profile_changes.schema)
    item_schema = build(empty).schema
    schema = "id string, version_ts timestamp, live boolean, " + ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in item_schema.fields if f.name != "id")
    log = ChangeLog(spark, f"{folder}/index", schema, keys=("id",), order=("version_ts", "batch"))

    def on_batch(batch: DataFrame, n: int) -> None:
        last = batch.groupBy("source_id").agg(F.max_by(F.struct(*names), "version_ts").alias("p")).select("source_id", "p.*")
        marks = last.select(F.col("source_id").cast("string").alias("id"), "version_ts", F.col("published").alias("live"))
        log.put(n, marks.join(build(last.where("published")), "id", "left"))

    run_available(profile_changes, folder, on_batch)
    # An older version that arrives late stays behind the newer one.
    return log.latest(["id"], order=("version_ts", "batch")).where("live").drop("live", "version_ts")


def gram_index_stream(profile_changes: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame]) -> GramIndex:
    """A searchable index kept current from profile versions: a batch adds one segment of the items it changes.

    Input as for ``index_stream``; ``build`` gives what ``search`` reads.
    """
    index = GramIndex(profile_changes.sparkSession, f"{folder}/grams")
    names = [c for c in profile_changes.columns if c != "source_id"]

    def on_batch(batch: DataFrame, n: int) -> None:
        last = batch.groupBy("source_id").agg(F.max_by(F.struct(*names), "version_ts").alias("p")).select("source_id", "p.*")
        marks = last.select(F.col("source_id").cast("string").alias("id"), F.unix_micros("version_ts").alias("version"), F.col("published").alias("live"))
        index.update(n, marks.join(build(last.where("published")), "id", "left"))

    run_available(profile_changes, folder, on_batch)
    return index
