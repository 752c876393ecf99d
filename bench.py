"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "subpage_plan", "page_markdown", "consolidated_pages", "record_join", "missing_prompts", "review_items", "translation_state",
    "dashboard", "translation_stats", "category_institutions", "auto_link_batch", "entity_candidates", "normalization_decisions",
    "dependency_context", "run_extraction", "response_scan", "rendered_profiles", "index_items", "english_index_items", "search_percent",
    "batch_search", "upserted_extractions", "reextracted_sources", "config_violations", "backlog_rank", "polite_fetch_plan",
    "job_state", "outage_episodes", "stream_job_state", "stream_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fieldloom-bench")
        .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from fieldloom import catalog

    queries = catalog.queries()
    names = [n for n in sys.argv[1:] if n in queries] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
