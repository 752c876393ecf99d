"""Record tables derived from the test data.

One text serves Spark and the SQL twin: ``{name}`` marks a table.  Only forms
that mean the same in both dialects are used; ``sha2(x, 256)`` and
``TIMESTAMP_NTZ`` are respelled for the twin.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables whose rows hold long texts.

SQL: dict[str, str] = {
    "fx_category": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS category_id, lower(r_name) AS internal_name,
               r_name AS display_name,
               CASE WHEN r_regionkey % 2 = 0 THEN r_name || ' (EN)' END AS display_name_en,
               CASE WHEN r_regionkey % 2 = 0 THEN 'base,topics,contents' ELSE 'base,funding,contact' END AS group_list,
               '# $project_name' || chr(10) || chr(10) || '**Institution:** $' || '{institution}' || chr(10) || chr(10)
                 || '## Beschreibung' || chr(10) || '$short_description costs $$5, $unknown_field' || chr(10)
                 || '$source_url ($crawled_at)' AS template,
               r_regionkey <> 4 AS is_active FROM {region}""",
    "fx_prompt": """
        SELECT CAST(prompt_id AS BIGINT) AS prompt_id, internal_name, display_name, field_group, entity_type,
               CAST(required_confidence AS DOUBLE) AS required_confidence, translatable, translation_context, is_active,
               'Find ' || display_name || ' of {institution} in {project}.' AS extract_prompt,
               'Check ' || display_name || ': {raw_result} ({institution})' AS validate_prompt
        FROM (VALUES
         (1, 'project_name', 'Project', 'base', NULL, 0.7, false, NULL, true),
         (2, 'institution', 'Institution', 'base', 'university', 0.7, false, NULL, true),
         (3, 'short_description', 'Summary', 'base', NULL, 0.6, true, 'one sentence', true),
         (4, 'keywords', 'Keywords', 'topics', NULL, 0.5, true, NULL, true),
         (5, 'funding_body', 'Funding', 'funding', NULL, 0.6, false, NULL, true),
         (6, 'goals', 'Goals', 'contents', NULL, 0.5, true, '  ', true),
         (7, 'contact_email', 'Contact', 'contact', NULL, 0.4, false, NULL, false))
         AS p(prompt_id, internal_name, display_name, field_group, entity_type, required_confidence,
              translatable, translation_context, is_active)""",
    # Every category leaves out the fields whose number completes it to a multiple of 4.
    "fx_category_prompt": " UNION ALL ".join(
        f"SELECT CAST(r_regionkey + 1 AS BIGINT) AS category_id, CAST({p} AS BIGINT) AS prompt_id, CAST({10 * p} AS BIGINT) AS display_order "
        f"FROM {{region}} WHERE (r_regionkey + 1 + {p}) % 4 <> 0"
        for p in range(1, 8)
    ),
    "fx_source": """
        SELECT o_orderkey AS source_id,
               'https://host' || CAST(o_custkey % 50 AS STRING) || '.example.org/p/' || CAST(o_orderkey AS STRING) AS url,
               CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'crawled' WHEN 2 THEN 'extracting'
                                   WHEN 3 THEN 'completed' ELSE 'failed' END AS status,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_custkey % 5 + 1 END AS category_id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE '# Page ' || CAST(o_orderkey AS STRING) || chr(10) || o_orderpriority END AS markdown_content,
               CASE WHEN o_orderkey % 5 = 4 THEN 'timeout' END AS error_message,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL '3' DAY END AS crawled_at,
               o_orderdate AS created_at, o_orderdate + INTERVAL '1' HOUR AS updated_at FROM {orders}""",
    "fx_extraction": """
        SELECT *, least(coalesce(raw_confidence, 0.0), coalesce(validation_score, 0.0)) AS final_confidence,
               source_id * 10 + prompt_id AS extraction_id
        FROM (SELECT l_orderkey AS source_id, CAST(l_linenumber AS BIGINT) AS prompt_id,
               'raw ' || CAST(max(l_partkey) AS STRING) AS raw_result,
               CASE WHEN max(l_suppkey) % 19 = 0 THEN NULL ELSE max(l_quantity) / 50 END AS raw_confidence,
               CASE WHEN max(l_partkey) % 11 = 0 THEN NULL
                    ELSE CAST(max(l_partkey) % 100 AS DOUBLE) / 100 END AS validation_score,
               CASE WHEN max(l_partkey) % 13 = 0 THEN '' WHEN max(l_partkey) % 17 = 0 THEN NULL
                    WHEN max(l_partkey) % 23 = 0 THEN '   '
                    WHEN l_linenumber = 2 AND max(l_suppkey) % 4 = 0
                      THEN 'Supplier#' || lpad(CAST(max(l_suppkey) AS STRING), 9, '0')
                    WHEN l_linenumber = 2 AND max(l_suppkey) % 4 = 1
                      THEN '  SUPPLIER#' || lpad(CAST(max(l_suppkey) AS STRING), 9, '0') || ' '
                    WHEN l_linenumber = 2 AND max(l_suppkey) % 4 = 2 THEN 'sup-' || CAST(max(l_suppkey) AS STRING)
                    ELSE 'value ' || CAST(max(l_partkey) AS STRING) END AS validated_result,
               CASE WHEN max(l_partkey) % 3 = 0 THEN 'english ' || CAST(max(l_partkey) AS STRING) END AS validated_result_en,
               CASE max(l_partkey) % 4 WHEN 0 THEN 'translated' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' END AS translation_status,
               CASE max(l_partkey) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INSUFFICIENT' END AS validation_quality,
               CASE WHEN l_linenumber = 2 AND max(l_suppkey) % 3 = 0 THEN max(l_suppkey) END AS linked_entity_id,
               max(l_partkey) % 29 = 0 AS is_manual_edit,
               max(l_shipdate) AS extracted_at
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber)""",
    "fx_entity": """
        SELECT s_suppkey AS entity_id, CASE WHEN s_nationkey % 5 = 0 THEN 'location' ELSE 'university' END AS entity_type,
               s_name AS canonical_name, n_name AS country
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "fx_variant": """
        SELECT s_suppkey AS entity_id, 'SUP-' || CAST(s_suppkey AS STRING) AS variant_name FROM {supplier}
        UNION ALL
        SELECT s_suppkey, 'S/' || CAST(s_suppkey AS STRING) || '/' || CAST(s_nationkey AS STRING)
        FROM {supplier} WHERE s_suppkey % 2 = 0""",
    "fx_profile": """
        SELECT doc_id AS profile_id, doc_id AS source_id,
               CASE WHEN doc_id % 31 = 0 THEN '' ELSE
               CASE WHEN doc_id % 9 = 0 THEN '' ELSE '# ' END || 'Profile ' || CAST(doc_id AS STRING) || chr(10) || chr(10)
                 || CASE doc_id % 3 WHEN 0 THEN '**Institution:** ' WHEN 1 THEN '**Institution**: ' ELSE 'Institution: ' END
                 || CASE WHEN doc_id % 7 = 0 THEN '-' WHEN doc_id % 7 = 1 THEN '[Inst ' || CAST(doc_id % 20 AS STRING) || '](http://x.y/z)'
                         ELSE 'Inst ' || CAST(doc_id % 20 AS STRING) END
                 || chr(10) || chr(10)
                 || CASE doc_id % 4 WHEN 0 THEN '## Description' WHEN 1 THEN '## Inhalt' ELSE '## Beschreibung' END
                 || chr(10) || chr(10) || text || chr(10) || '## Ende' || chr(10) || 'last' END AS markdown_content,
               doc_id % 3 <> 0 AS published,
               TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS generated_at,
               CASE WHEN doc_id % 6 = 1 THEN TIMESTAMP_NTZ '2024-02-01 00:00:00' + doc_id * INTERVAL '1' HOUR END AS published_at
        FROM {documents}""",
    "fx_translation": """
        SELECT profile_id, 'en' AS language, replace(markdown_content, 'Profile', 'Record') AS markdown_content,
               CASE WHEN profile_id % 5 = 0 THEN 'stale' ELSE sha2(markdown_content, 256) END AS source_hash
        FROM {fx_profile} WHERE profile_id % 4 <> 0""",
    "fx_review": """
        SELECT extraction_id AS review_id, extraction_id, validated_result AS raw_text, 'university' AS entity_type,
               CASE WHEN extraction_id % 3 <> 0 THEN CAST(right(validated_result, 4) AS BIGINT) END AS suggestion_id,
               CASE WHEN extraction_id % 5 <> 0 THEN CAST(0.75 AS DOUBLE) END AS confidence,
               CASE source_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'reviewed' ELSE 'ignored' END AS status
        FROM {fx_extraction} WHERE prompt_id = 2 AND validated_result LIKE 'Supplier#%'""",
    "fx_job": """
        SELECT event_id AS job_id,
               CASE event_type WHEN 'view' THEN 'crawl' WHEN 'click' THEN 'extract' WHEN 'signup' THEN 'validate'
                    WHEN 'purchase' THEN 'generate' ELSE CASE WHEN event_id % 3 = 0 THEN 'rest' ELSE 'normalize' END END AS job_type,
               user_id AS source_id, event_id % 11 = 0 AS dependent,
               CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'pending' END AS status,
               ts AS scheduled_at FROM {events}""",
    "fx_job_event": """
        SELECT event_id, user_id AS job_id, ts, event_type <> 'error' AS success,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
                    WHEN 'click' THEN 'running' ELSE 'pending' END AS status,
               CASE WHEN event_type = 'error' THEN props END AS error FROM {events}""",
    "fx_call": """
        SELECT event_id, user_id % 5 AS service_id, ts,
               CASE WHEN event_id % 400 < 60 THEN event_id % 23 = 0 ELSE event_type <> 'error' END AS success FROM {events}""",
    "fx_link": """
        SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN '/team' WHEN 1 THEN '/forschung/x' WHEN 2 THEN '/publikation'
               WHEN 3 THEN '/impressum' WHEN 4 THEN '/about/privacy' WHEN 5 THEN '/service/login'
               WHEN 6 THEN '/other' ELSE '/kontakt#a' END AS href FROM {pages}""",
    "cfg_category": """
        SELECT s_suppkey AS category_id, 'cat_' || CAST(s_suppkey AS STRING) AS internal_name, s_name AS display_name,
               s_nationkey % 5 <> 4 AS is_active FROM {supplier}""",
    "cfg_prompt": """
        SELECT p_partkey AS prompt_id, 'field_' || CAST(p_partkey AS STRING) AS internal_name, p_name AS display_name,
               lower(p_type) AS field_group, CASE WHEN p_size % 2 = 0 THEN 'list' ELSE 'text' END AS field_type,
               'Find ' || p_name AS extract_prompt, p_size % 3 = 0 AS translatable,
               CASE WHEN p_size % 10 = 0 THEN 'university' END AS entity_type,
               p_size % 9 <> 0 AS is_active FROM {part}""",
    "cfg_mapping": """
        SELECT l_suppkey AS category_id, l_partkey AS prompt_id, CAST(10 * min(l_linenumber) AS BIGINT) AS display_order
        FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "cfg_dependency": """
        SELECT p_partkey AS prompt_id, p_partkey % 64 AS set_id,
               CASE WHEN p_partkey % 64 >= 60 AND p_partkey >= 128 AND p_partkey < 192 THEN p_partkey - 64
                    WHEN p_partkey % 64 >= 60 AND p_partkey >= 64 AND p_partkey < 128 THEN p_partkey + 64
                    WHEN p_partkey >= 128 THEN p_partkey % 64 + 64 * ((p_partkey - p_partkey % 128) / 128)
                    END AS depends_on
        FROM {part}""",
}
# Integer halving is spelled with CAST so both dialects agree.
SQL["cfg_dependency"] = SQL["cfg_dependency"].replace(
    "64 * ((p_partkey - p_partkey % 128) / 128)", "64 * CAST((p_partkey - p_partkey % 128) / 128 AS BIGINT)"
)

_MARK = re.compile(r"\{([a-z]+(?:_[a-z]+)*)\}")
_TABLES = set(BASE) | set(SQL)


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_MARK.findall(sql)) if n in _TABLES]


class Tables:
    """Given and derived tables of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _TABLES:
            raise AttributeError(name)
        if name not in self._built:
            if name in BASE:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                df = self.sql(SQL[name])
            self._built[name] = df
        return self._built[name]

    def sql(self, text: str) -> DataFrame:
        names = _needs(text)
        # Braces that are not table marks belong to literals.
        safe = _MARK.sub(lambda m: m[0] if m[1] in _TABLES else "{{" + m[1] + "}}", text)
        if not names:
            return self.spark.sql(text)
        return self.spark.sql(safe, **{n: getattr(self, n) for n in names})


def _twin(text: str) -> str:
    text = _MARK.sub(lambda m: m[1] if m[1] in _TABLES else m[0], text)
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("sha2(", "sha256(").replace(", 256)", ")")


def twin_sql(body: str, ctes: str = "") -> str:
    """DuckDB text of a query whose derived tables become leading WITH entries."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b((?:fx|cfg)_[a-z_]+)\b", text):
            if name in SQL and name not in order:
                visit(SQL[name])
                if name not in order:
                    order.append(name)

    visit(ctes + " " + body)
    parts = [f"{n} AS ({_twin(SQL[n]).strip()})" for n in order]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return head + body.strip()
