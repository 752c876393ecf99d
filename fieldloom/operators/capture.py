"""From fetched pages to captured sources."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.operators.changes import last_change
from fieldloom.functions import text as tx, web
from fieldloom.plans.order import sorted_blocks


def read_pages(pages: DataFrame) -> DataFrame:
    """Page rows with an ``error`` column; an empty address or body is an error row."""
    error = F.when(~tx.not_blank(F.col("url")), F.lit("missing url")).when(
        ~tx.not_blank(F.col("html")), F.lit("empty page")
    )
    return pages.withColumn("error", error)


def links_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, link), one row per distinct link of a page."""
    return pages.select("page_id", "url", F.posexplode(web.page_links(F.col("url"), F.col("html"))).alias("pos", "link"))


def first_links(links: DataFrame) -> DataFrame:
    """Keep the first place of a repeated link of a page."""
    return links.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def scored_links(links: DataFrame) -> DataFrame:
    scored = links.withColumn("score", web.link_score(F.col("link"), F.col("url")))
    return scored.where("score > 0")


def select_subpages(links: DataFrame, max_pages: int = 5) -> DataFrame:
    """Best ``max_pages - 1`` links of each page; ties keep document order.

    The row_number bound lets Spark cut every task's share to the bound before
    the shuffle, so a page with very many links stays cheap.
    """
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    ranked = scored_links(links).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max_pages - 1)


def robots_filter(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Pages their host's robots text allows.  A host without a text allows all.

    The text travels with the page rows by a join, so a hot host is spread like
    any other rows (the join splits skewed keys); each task parses a text once.
    """
    names = [f.name for f in pages.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers: dict[str, RobotFileParser] = {}

        def may_fetch(rules: str, url: str) -> bool:
            if rules not in parsers:
                if len(parsers) > 10_000:
                    parsers.clear()
                parsers[rules] = RobotFileParser()
                parsers[rules].parse(rules.splitlines())
            try:
                return parsers[rules].can_fetch(agent, url)
            except Exception:  # malformed rules do not stop a capture
                return True

        for batch in batches:
            keep = [pd.isna(r) or may_fetch(r, u) for r, u in zip(batch["_rules"], batch["url"])]
            yield batch.loc[keep, names]

    rules = robots.select(F.col("host").alias("_host"), F.col("robots").alias("_rules"))
    joined = pages.withColumn("_host", web.host(F.col("url"))).join(rules, "_host", "left")
    return joined.select(*names, "_rules").mapInPandas(allowed, schema)


def polite_fetch_plan(requests: DataFrame) -> DataFrame:
    """Earliest fetch time of each request with a gap of 1/rate per host.

    ``requests``: request_id, host, ready_us (long), gap_us (long).  The recurrence
    start = max(ready, previous start + gap) is a running maximum of
    ready - place * gap.  It is computed per block of a range-sorted table and
    carried over blocks by one row per host and block, so a hot host is not one task.
    """
    placed = sorted_blocks(requests, [F.col("host"), F.col("ready_us"), F.col("request_id")])
    inside = Window.partitionBy("host", "_block").orderBy("_pos")
    local = placed.withColumn("_j", F.row_number().over(inside)).withColumn(
        "_slack", F.col("ready_us") - F.col("_j") * F.col("gap_us")
    )
    blocks = local.groupBy("host", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_slack").alias("_top"), F.max("gap_us").alias("_gap")
    )
    earlier = Window.partitionBy("host").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_carry", F.max(F.col("_top") - F.col("_before") * F.col("_gap")).over(earlier))
    joined = local.join(blocks.select("host", "_block", "_before", "_carry"), ["host", "_block"])
    running = F.max("_slack").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    best = F.greatest(running - F.col("_before") * F.col("gap_us"), F.col("_carry"))
    start = best + (F.col("_before") + F.col("_j")) * F.col("gap_us")
    return joined.select("request_id", "host", "ready_us", start.alias("start_us"))


def allowed_fetch_plan(pages: DataFrame, robots: DataFrame, agent: str, requests_per_second: float = 1.0) -> DataFrame:
    """Fetch times of the pages that their hosts allow.

    ``pages``: request_id, url, ready_us.  A page that is not allowed takes no place in its
    host's queue; a page without an address has no host and no time.
    """
    gap = F.lit(round(1_000_000 / requests_per_second)).cast("long")
    known = pages.where("url IS NOT NULL").select("request_id", "url", "ready_us")
    allowed = robots_filter(known, robots, agent)
    return polite_fetch_plan(allowed.select("request_id", web.host(F.col("url")).alias("host"), "ready_us", gap.alias("gap_us")))


def consolidate_pages(pages: DataFrame, captured_at: Column, limit: int = 200_000) -> DataFrame:
    """One Markdown text per source from its captured pages.

    ``pages``: source_id, pos (0 is the main page), url, title, markdown, html_size.
    A source has at most the capture's page limit of rows, so a group is small.
    """
    kind = web.page_type(F.col("url"))
    main = F.concat(
        F.lit("# [MAIN_PAGE]\n## URL: "), F.col("url"), F.lit("\n## Title: "), F.col("title"),
        F.lit("\n## Page-Type: PRIMARY\n\n"), F.col("markdown"), F.lit("\n"),
    )
    usable = pages.where(F.col("markdown").isNotNull())
    part = F.struct("pos", "url", "title", "markdown", kind.alias("kind"), F.when(F.col("pos") == 0, main).alias("main"))
    grouped = usable.groupBy("source_id").agg(
        F.array_sort(F.collect_list(part)).alias("_parts"),
        F.count(F.lit(1)).alias("pages_crawled"),
        F.sum("html_size").alias("_size"),
        F.min_by("url", "pos").alias("_url"),
    )
    sections = F.transform(
        F.col("_parts"),
        lambda p, i: F.coalesce(
            p["main"],
            F.concat(
                F.lit("---\n\n# [SUBPAGE_"), i.cast("string"), F.lit(": "), p["kind"], F.lit("]\n## URL: "), p["url"],
                F.lit("\n## Title: "), p["title"], F.lit("\n## Page-Type: "), p["kind"], F.lit("\n\n"), p["markdown"], F.lit("\n"),
            ),
        ),
    )
    head = F.concat(
        F.lit("# [METADATA]\nSource-UUID: "), F.col("_url"), F.lit("\nPrimary-URL: "), F.col("_url"),
        F.lit("\nCrawled-Pages: "), F.col("pages_crawled").cast("string"), F.lit("\nCrawl-Timestamp: "), captured_at,
        F.lit("\nTotal-Size: "), F.col("_size").cast("string"), F.lit("\n\n"),
    )
    text = tx.truncate_markdown(tx.sanitize(F.concat(head, F.array_join(sections, "\n"))), limit)
    return grouped.select("source_id", "pages_crawled", text.alias("markdown_content")).withColumn(
        "markdown_size", F.length("markdown_content")
    )


def apply_crawl_results(sources: DataFrame, results: DataFrame) -> DataFrame:
    """New ``sources`` table after a capture run.

    ``results``: source_id, success, markdown, size, pages, finished_at, error; the last result of a source counts.
    """
    names = ("success", "markdown", "size", "pages", "finished_at", "error")
    last = last_change(results.select("source_id", *names), ["source_id"], ("finished_at",))
    new = last.select("source_id", *[F.col(c).alias("_" + c) for c in names])
    ok, bad = F.coalesce(F.col("_success"), F.lit(False)), F.coalesce(~F.col("_success"), F.lit(False))

    def pick(name, fresh):
        return F.when(ok, fresh).otherwise(F.col(name)).alias(name)

    changed = {
        "markdown_content": pick("markdown_content", F.col("_markdown")),
        "markdown_size": pick("markdown_size", F.col("_size")),
        "pages_crawled": pick("pages_crawled", F.col("_pages")),
        "crawled_at": pick("crawled_at", F.col("_finished_at")),
        "status": F.when(ok, "crawled").when(bad, "failed").otherwise(F.col("status")).alias("status"),
        "error_message": F.when(ok, F.lit(None).cast("string")).when(bad, F.col("_error")).otherwise(F.col("error_message")).alias("error_message"),
    }
    joined = sources.join(new, "source_id", "left")
    return joined.select(*[changed.get(c, F.col(c)) for c in sources.columns])
