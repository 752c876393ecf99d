"""Template filters as SQL functions of a session.

All are SQL expressions but ``markdown``, which parses line by line and is an Arrow function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from fieldloom.functions.markdown import teaser_sql
from fieldloom.functions.render import markdown_to_html

_STRIP = r"regexp_replace({0}, r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '')"
_TITLE = "CASE WHEN startswith(coalesce(text, ''), '#') THEN " + _STRIP.format("regexp_replace(split(text, '\\n')[0], '^#+', '')") + " ELSE 'Untitled' END"
_VALUE = _STRIP.format("regexp_replace(" + _STRIP.format("regexp_replace(x, '^[^:]*:', '')") + r", r'\*+', '')")
_HITS = "filter(slice(split(coalesce(text, ''), '\\n'), 1, 15), x -> contains(x, 'Institution') AND contains(x, ':'))"
_LINE = r"r'(?i)^(\*\*Institution:\*\*\s*|\*\*Institution\*\*:\s*|Institution:\s*)(.+)$'"
_NAME = _STRIP.format(f"regexp_extract(x, {_LINE}, 2)")
_PLAIN = _STRIP.format(f"regexp_replace({_NAME}, r'\\*+', '')")
_QUOTED = f"replace(replace(replace(replace(url_encode({_PLAIN}), '+', '%20'), '%2F', '/'), '%7E', '~'), '*', '%2A')"
_PAGE = "CASE WHEN contains(prefix, '/en') THEN 'search.html' ELSE 'suche.html' END"

FILTERS = {
    "striptags(text STRING)": "coalesce(regexp_replace(text, '<[^>]+>', ''), '')",
    "get_title(text STRING)": _TITLE,
    "title_with_institution(text STRING)": _TITLE,
    "get_institution(text STRING)": f"coalesce(get(filter(transform({_HITS}, x -> {_VALUE}), v -> v NOT IN ('', '-', 'Nicht angegeben')), 0), '')",
    "linkify_institutions(text STRING, prefix STRING)": (
        f"array_join(transform(split(text, '\\n'), x -> CASE WHEN x RLIKE {_LINE} AND {_PLAIN} NOT IN ('', '-', 'Nicht angegeben', 'N/A') "
        f"THEN regexp_extract(x, {_LINE}, 1) || '[' || {_NAME} || '](' || prefix || '/' || {_PAGE} || '?q=' || {_QUOTED} || ')' ELSE x END), '\\n')"
    ),
    "get_description(text STRING)": teaser_sql("text"),
    "date_text(text STRING, pattern STRING)": (
        "coalesce(date_format(CASE WHEN text RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T' THEN try_cast(substr(text, 1, 19) AS TIMESTAMP_NTZ) "
        "WHEN length(text) = 10 THEN try_cast(try_cast(text AS DATE) AS TIMESTAMP_NTZ) END, pattern), text, '')"
    ),
}


def register_filters(spark: SparkSession) -> None:
    for signature, body in FILTERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
    spark.udf.register("markdown", markdown_to_html)
