"""Capture queries over ``pages`` and ``documents``."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.functions import html, text as tx, web
from fieldloom.operators import capture

_HOST = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_ROOT = "regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_HIGH = "'team|kontakt|contact|about|ueber|%c3%bcber|menschen|people|staff|mitarbeiter'"
_MEDIUM = "'projekt|project|forschung|research'"
_LOW = "'publikation|publication|veroeffentlichung|paper|service|angebot|offer'"
_EXCLUDED = "'impressum|imprint|datenschutz|privacy|cookie|login|agb|terms|legal|barrierefreiheit|accessibility|sitemap'"


def _score(link: str, page: str) -> str:
    return f"""(CASE WHEN regexp_matches(lower({link}), {_HIGH}) THEN 10 WHEN regexp_matches(lower({link}), {_MEDIUM}) THEN 8
        WHEN regexp_matches(lower({link}), {_LOW}) THEN 6 ELSE 3 END
        - CASE WHEN regexp_matches(lower({link}), {_EXCLUDED}) THEN 5 ELSE 0 END
        - CASE WHEN {_HOST.format(link)} <> {_HOST.format(page)} THEN 10 ELSE 0 END)"""


def _type(url: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({url}), 'team|menschen|people|staff|mitarbeiter|about|ueber|%c3%bcber') THEN 'TEAM'
        WHEN regexp_matches(lower({url}), 'kontakt|contact') THEN 'CONTACT'
        WHEN regexp_matches(lower({url}), 'publikation|publication|veroeffentlichung|paper') THEN 'PUBLICATIONS'
        WHEN regexp_matches(lower({url}), 'projekt|project|forschung|research') THEN 'PROJECT'
        WHEN regexp_matches(lower({url}), 'service|angebot|offer|tool') THEN 'SERVICE' ELSE 'OTHER' END"""


# All links in the data are root-relative, so the twin needs no general resolver.
_LINKS = f"""raw_links AS (
    SELECT page_id, url, unnest(found) AS href, generate_subscripts(found, 1) AS place
    FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS found FROM pages)
), abs_links AS (
    SELECT page_id, url, place, regexp_replace({_ROOT.format('url')} || replace(trim(href), '&amp;', '&'), '#.*$', '') AS link
    FROM raw_links WHERE trim(href) <> ''
), links AS (
    SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY min(place)) - 1 AS pos
    FROM abs_links WHERE link <> url GROUP BY page_id, url, link
)"""
_TITLE = """trim(replace(replace(replace(replace(replace(
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))"""


@query("read_pages", """SELECT page_id, url, length(html) AS size,
    CASE WHEN trim(coalesce(url, '')) = '' THEN 'missing url' WHEN trim(coalesce(html, '')) = '' THEN 'empty page' END AS error
    FROM (SELECT page_id, url, CASE WHEN page_id % 10 = 3 THEN ' ' ELSE html END AS html FROM pages)""")
def read_pages(t):
    pages = t.pages.withColumn("html", F.when(F.col("page_id") % 10 == 3, " ").otherwise(F.col("html")))
    return capture.read_pages(pages).select("page_id", "url", F.length("html").cast("long").alias("size"), "error")


@query("page_titles", f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(t):
    return t.pages.select("page_id", web.page_title(F.col("html")).alias("title"))


@query("page_hosts", f"SELECT page_id, {_HOST.format('url')} AS host, {_ROOT.format('url')} AS base FROM pages")
def page_hosts(t):
    return t.pages.select("page_id", web.host(F.col("url")).alias("host"), web.base_url(F.col("url")).alias("base"))


@query("page_links", "SELECT page_id, url, pos, link FROM links", _LINKS)
def page_links(t):
    return capture.links_of_pages(t.pages).withColumn("pos", F.col("pos").cast("long"))


@query("first_links", """SELECT page_id, link, min(pos) AS pos FROM (
    SELECT page_id, link, pos * 2 AS pos FROM links UNION ALL SELECT page_id, link, pos * 3 + 1 FROM links) GROUP BY page_id, link""", _LINKS)
def first_links(t):
    links = capture.links_of_pages(t.pages).withColumn("pos", F.col("pos").cast("long"))
    twice = links.withColumn("pos", F.explode(F.array(F.col("pos") * 2, F.col("pos") * 3 + 1)))
    return capture.first_links(twice)


@query("link_scores", f"""SELECT page_id, link, {_score('link', 'url')} AS score FROM (
    SELECT page_id, url, regexp_replace({_ROOT.format('url')} || href, '#.*$', '') AS link FROM fx_link)
    WHERE {_score('link', 'url')} > 0""")
def link_scores(t):
    links = t.fx_link.withColumn("link", F.regexp_replace(web.resolve_url(F.col("url"), F.col("href")), "#.*$", ""))
    return capture.scored_links(links).select("page_id", "link", "score")


@query("page_types", f"SELECT page_id, href, {_type('href')} AS page_type FROM fx_link")
def page_types(t):
    return t.fx_link.select("page_id", "href", web.page_type(F.col("href")).alias("page_type"))


@query("subpage_plan", f"""SELECT page_id, title, link, score, page_type, rank FROM (
    SELECT page_id, link, {_score('link', 'url')} AS score, {_type('link')} AS page_type,
           row_number() OVER (PARTITION BY page_id ORDER BY {_score('link', 'url')} DESC, pos) AS rank
    FROM links WHERE {_score('link', 'url')} > 0) JOIN (SELECT page_id, {_TITLE} AS title FROM pages) USING (page_id)
    WHERE rank <= 4""", _LINKS)
def subpage_plan(t):
    # Title and links come from one pass over the page text.
    parsed = t.pages.select(
        "page_id", "url", web.page_title(F.col("html")).alias("title"),
        F.posexplode(web.page_links(F.col("url"), F.col("html"))).alias("pos", "link"),
    )
    best = capture.select_subpages(parsed, max_pages=5)
    return best.select("page_id", "title", "link", "score", web.page_type(F.col("link")).alias("page_type"), F.col("rank").cast("long").alias("rank"))


_RAW_URL = """CASE page_id % 6 WHEN 0 THEN '  ' || url || chr(10) WHEN 1 THEN regexp_replace(url, '^https?://', '')
    WHEN 2 THEN chr(9) || ' ' WHEN 3 THEN 'http:///path' WHEN 4 THEN NULL ELSE 'ftp://' || url END"""


@query("normalized_urls", f"""SELECT page_id, CASE WHEN trimmed = '' THEN NULL WHEN {_HOST.format('whole')} = '' THEN NULL ELSE whole END AS url FROM (
    SELECT page_id, trimmed, CASE WHEN trimmed LIKE 'http://%' OR trimmed LIKE 'https://%' THEN trimmed ELSE 'https://' || trimmed END AS whole
    FROM (SELECT page_id, trim(raw, ' ' || chr(9) || chr(10)) AS trimmed FROM (SELECT page_id, {_RAW_URL} AS raw FROM pages)))""")
def normalized_urls(t):
    raw = t.pages.select("page_id", F.expr(_RAW_URL).alias("raw"))
    return raw.select("page_id", web.normalize_url(F.col("raw")).alias("url"))


@query("sanitized_text", """SELECT doc_id, regexp_replace(text || chr(1) || 'a' || chr(11) || chr(31) || chr(9) || 'b',
    '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS text FROM documents""")
def sanitized_text(t):
    dirty = F.expr("text || chr(1) || 'a' || chr(11) || chr(31) || chr(9) || 'b'")
    return t.documents.select("doc_id", tx.sanitize(dirty).alias("text"))


@query("truncated_text", """SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || chr(10) || chr(10) || '[TRUNCATED]' ELSE text END AS text,
    CASE WHEN length(text) > 3000 THEN 3013 ELSE length(text) END AS size FROM documents""")
def truncated_text(t):
    cut = t.documents.select("doc_id", tx.truncate_markdown(F.col("text"), 3000).alias("text"))
    return cut.withColumn("size", F.length("text").cast("long"))


@query("page_markdown")
def page_markdown(t):
    return html.with_markdown(t.pages.select("page_id", "url", "html"))


_ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /\n"


@query("allowed_pages", f"""SELECT page_id, url FROM pages
    WHERE length({_HOST.format('url')}) % 2 = 1 OR regexp_extract(url, '^[a-z]+://[^/]*(/[^/]*/)', 1) <> '/fr/'""")
def allowed_pages(t):
    hosts = t.pages.select(web.host(F.col("url")).alias("host")).distinct()
    robots = hosts.where(F.length("host") % 2 == 0).withColumn("robots", F.lit(_ROBOTS))
    return capture.robots_filter(t.pages.select("page_id", "url"), robots, "fieldloom")


@query("polite_fetch_plan", """SELECT request_id, host, ready_us,
    max(ready_us - j * 1000000) OVER (PARTITION BY host ORDER BY ready_us, request_id ROWS UNBOUNDED PRECEDING) + j * 1000000 AS start_us
    FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ready_us, request_id) AS j FROM (
        SELECT event_id AS request_id, CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE 'h' || CAST(user_id % 40 AS STRING) END AS host,
               (epoch_us(ts) // 300) AS ready_us FROM events))""")
def polite_fetch_plan(t):
    requests = t.events.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string"))).alias("host"),
        F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 300).alias("ready_us"),
        F.lit(1_000_000).cast("long").alias("gap_us"),
    )
    return capture.polite_fetch_plan(requests)


@query("allowed_fetch_plan", f"""SELECT request_id, host, ready_us,
    max(ready_us - j * 500000) OVER (PARTITION BY host ORDER BY ready_us, request_id ROWS UNBOUNDED PRECEDING) + j * 500000 AS start_us
    FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ready_us, request_id) AS j FROM (
        SELECT page_id AS request_id, {_HOST.format('url')} AS host, CAST(length(html) * 1000 AS BIGINT) AS ready_us FROM pages
        WHERE length({_HOST.format('url')}) % 2 = 1 OR regexp_extract(url, '^[a-z]+://[^/]*(/[^/]*/)', 1) <> '/fr/'))""")
def allowed_fetch_plan(t):
    """Only pages that robots rules allow are given a time, two a second and host."""
    hosts = t.pages.select(web.host(F.col("url")).alias("host")).distinct()
    robots = hosts.where(F.length("host") % 2 == 0).withColumn("robots", F.lit(_ROBOTS))
    requests = t.pages.select(F.col("page_id").alias("request_id"), "url", (F.length("html") * 1000).cast("long").alias("ready_us"))
    return capture.allowed_fetch_plan(requests, robots, "fieldloom", 2.0)


_PAGE_ROWS = """SELECT page_id - page_id % 4 AS source_id, page_id % 4 AS pos, url, 'T' || CAST(page_id AS STRING) AS title,
    CASE WHEN page_id % 13 = 5 THEN NULL ELSE html END AS markdown, length(html) AS html_size FROM {pages}"""


@query("consolidated_pages", f"""SELECT source_id, pages_crawled, markdown_content, length(markdown_content) AS markdown_size FROM (
    SELECT source_id, count(*) AS pages_crawled,
    regexp_replace('# [METADATA]' || chr(10) || 'Source-UUID: ' || arg_min(url, pos) || chr(10) || 'Primary-URL: ' || arg_min(url, pos) || chr(10)
    || 'Crawled-Pages: ' || count(*) || chr(10) || 'Crawl-Timestamp: 2024-06-01T00:00:00Z' || chr(10) || 'Total-Size: ' || sum(html_size) || chr(10) || chr(10)
    || string_agg(CASE WHEN pos = 0 THEN '# [MAIN_PAGE]' || chr(10) || '## URL: ' || url || chr(10) || '## Title: ' || title || chr(10) || '## Page-Type: PRIMARY'
       ELSE '---' || chr(10) || chr(10) || '# [SUBPAGE_' || (k - 1) || ': ' || kind || ']' || chr(10) || '## URL: ' || url || chr(10) || '## Title: ' || title
            || chr(10) || '## Page-Type: ' || kind END || chr(10) || chr(10) || markdown || chr(10), chr(10) ORDER BY pos),
    '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS markdown_content
    FROM (SELECT *, {_type('url')} AS kind, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS k
          FROM ({_PAGE_ROWS.replace('{pages}', 'pages')}) WHERE markdown IS NOT NULL) GROUP BY source_id)""")
def consolidated_pages(t):
    out = capture.consolidate_pages(t.sql(_PAGE_ROWS), F.lit("2024-06-01T00:00:00Z"), limit=2_000_000)
    return out.withColumn("markdown_size", F.col("markdown_size").cast("long"))


_CRAWLED = """SELECT page_id AS source_id, page_id % 5 <> 2 AS success, 'text ' || url AS markdown, page_id + 100 AS size, page_id % 3 + 1 AS pages,
    TIMESTAMP_NTZ '2024-06-01 00:00:00' AS finished_at, 'http ' || CAST(400 + page_id % 5 AS STRING) AS error FROM {pages}"""


@query("crawl_results_applied", f"""SELECT source_id,
    CASE WHEN success THEN markdown ELSE markdown_content END AS markdown_content,
    CASE WHEN success THEN size END AS markdown_size, CASE WHEN success THEN pages END AS pages_crawled,
    CASE WHEN success THEN TIMESTAMP '2024-06-01 00:00:00' ELSE crawled_at END AS crawled_at,
    CASE WHEN success THEN 'crawled' WHEN NOT success THEN 'failed' ELSE status END AS status,
    CASE WHEN success THEN NULL WHEN NOT success THEN error ELSE error_message END AS error_message
    FROM fx_source LEFT JOIN ({_CRAWLED.replace('{pages}', 'pages').replace('TIMESTAMP_NTZ', 'TIMESTAMP')}) USING (source_id)""")
def crawl_results_applied(t):
    sources = t.fx_source.select(
        "source_id", "markdown_content", F.lit(None).cast("long").alias("markdown_size"),
        F.lit(None).cast("long").alias("pages_crawled"), "crawled_at", "status", "error_message",
    )
    return capture.apply_crawl_results(sources, t.sql(_CRAWLED))
