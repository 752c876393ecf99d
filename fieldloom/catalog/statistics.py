"""Report queries."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.records import _JOBS, _MISSING, _STATE, _VALUE
from fieldloom.operators import records as r, statistics as s


@query("count_by_status", """SELECT status, (SELECT count(*) FROM fx_source f WHERE f.status = v.status) AS n
    FROM (VALUES ('pending'), ('crawled'), ('extracting'), ('completed'), ('failed')) v(status)""")
def count_by_status(t):
    return s.count_by_status(t.fx_source)


@query("count_by_category", "SELECT category_id, count(*) AS n FROM fx_source WHERE status = 'completed' AND category_id IS NOT NULL GROUP BY category_id")
def count_by_category(t):
    return s.count_by_category(t.fx_source, "completed")


@query("count_since", "SELECT count(*) AS n FROM fx_source WHERE created_at >= TIMESTAMP '1997-06-01 00:00:00' AND status = 'completed'")
def count_since(t):
    return s.count_since(t.fx_source, F.expr("TIMESTAMP_NTZ '1997-06-01 00:00:00'"), "completed")


@query("public_categories", """SELECT c.category_id, c.display_name, count(f.source_id) AS completed FROM fx_category c
    LEFT JOIN fx_source f ON f.category_id = c.category_id AND f.status = 'completed' WHERE c.is_active GROUP BY ALL""")
def public_categories(t):
    return s.public_categories(t.fx_category, t.fx_source).select("category_id", "display_name", "completed")


@query("public_statistics", """SELECT total, recent, by_category FROM
    (SELECT count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL '30' DAY) AS recent FROM fx_source WHERE status = 'completed'),
    (SELECT string_agg(display_name || '=' || n, ';' ORDER BY display_name) AS by_category FROM (
        SELECT c.display_name, count(f.source_id) AS n FROM fx_category c LEFT JOIN fx_source f ON f.category_id = c.category_id AND f.status = 'completed'
        WHERE c.is_active GROUP BY ALL))""")
def public_statistics(t):
    out = s.public_statistics(t.fx_category, t.fx_source, F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    text = F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.select("total", "recent", text.alias("by_category"))


@query("admin_categories", """SELECT category_id, display_name, (SELECT count(*) FROM fx_source f WHERE f.category_id = c.category_id) AS source_count,
    (SELECT count(*) FROM fx_category_prompt m WHERE m.category_id = c.category_id) AS prompt_count FROM fx_category c""")
def admin_categories(t):
    return s.admin_categories(t.fx_category, t.fx_source, t.fx_category_prompt).select("category_id", "display_name", "source_count", "prompt_count")


@query("category_ranking", """SELECT category_id, display_name, count(o_orderkey) AS source_count FROM cfg_category
    LEFT JOIN orders ON o_custkey % 1000 = category_id GROUP BY ALL""")
def category_ranking(t):
    sources = t.orders.select((F.col("o_custkey") % 1000).alias("category_id"))
    return s.category_ranking(t.cfg_category, sources).select("category_id", "display_name", "source_count")


def _metric(table: str, **cols: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM {table}" for k, v in cols.items())


@query("dashboard", " UNION ALL ".join([
    _metric("fx_source", total_sources="count(*)", completed_sources="count(*) FILTER (status = 'completed')",
            failed_sources="count(*) FILTER (status = 'failed')", open_sources="count(*) FILTER (status IN ('pending', 'crawled', 'extracting'))"),
    _metric("fx_profile", total_profiles="count(*)", published_profiles="count(*) FILTER (published)", unpublished_profiles="count(*) FILTER (NOT published)"),
    _metric("fx_extraction", total_extractions="count(*)", validated_extractions=f"count(*) FILTER ({_VALUE})", linked_extractions="count(linked_entity_id)",
            low_confidence="count(*) FILTER (final_confidence < 0.7)", avg_confidence="round(avg(final_confidence) * 100, 1)"),
    _metric("fx_entity", total_entities="count(*)"), _metric("fx_variant", total_variants="count(*)")]))
def dashboard(t):
    return s.dashboard(t.fx_source, t.fx_profile, t.fx_extraction, t.fx_entity, t.fx_variant)


@query("translation_stats", f"""SELECT *, total - translatable AS skipped, round(translated / translatable * 100, 1) AS progress FROM (
    SELECT count(*) FILTER ({_VALUE}) AS total, count(*) FILTER ({_VALUE} AND translatable) AS translatable,
      count(*) FILTER (translation_status = 'translated') AS translated,
      count(*) FILTER ({_VALUE} AND translatable AND (translation_status = 'pending' OR translation_status IS NULL OR validated_result_en IS NULL)) AS pending,
      count(*) FILTER (translation_status = 'failed') AS failed FROM fx_extraction JOIN fx_prompt USING (prompt_id))""")
def translation_stats(t):
    return s.translation_stats(t.fx_extraction, t.fx_prompt)


@query("translation_status_counts", f"""SELECT translation_state, count(*) FILTER (published) AS published, count(*) AS all_profiles FROM ({_STATE}) GROUP BY ALL""")
def translation_status_counts(t):
    return s.translation_status_counts(t.fx_profile, t.fx_translation)


@query("link_stats", """SELECT 'total' AS metric, CAST(total AS VARCHAR) AS value FROM x UNION ALL SELECT 'linked', CAST(linked AS VARCHAR) FROM x
    UNION ALL SELECT 'unlinked', CAST(total - linked AS VARCHAR) FROM x UNION ALL SELECT 'rate', printf('%.1f%%', linked / total * 100) FROM x
    UNION ALL SELECT 'entities_' || entity_type, CAST(count(*) AS VARCHAR) FROM fx_entity GROUP BY entity_type
    UNION ALL SELECT 'variants', CAST(count(*) AS VARCHAR) FROM fx_variant""",
    """x AS (SELECT count(*) AS total, count(linked_entity_id) AS linked FROM fx_extraction JOIN fx_prompt USING (prompt_id) WHERE entity_type IS NOT NULL)""")
def link_stats(t):
    return s.link_stats(t.fx_extraction, t.fx_prompt, t.fx_entity, t.fx_variant)


@query("source_completion", """SELECT f.source_id, actual, expected FROM fx_source f
    JOIN (SELECT category_id, count(*) AS expected FROM fx_category_prompt JOIN fx_prompt USING (prompt_id) WHERE is_active GROUP BY category_id) e ON e.category_id = f.category_id
    JOIN (SELECT source_id, count(*) AS actual FROM fx_extraction GROUP BY source_id) a ON a.source_id = f.source_id WHERE actual >= expected""")
def source_completion(t):
    return s.source_completion(t.fx_source, t.fx_category_prompt, t.fx_prompt, t.fx_extraction).select("source_id", "actual", "expected")


@query("system_counts", """SELECT 'sources' AS "table", count(*) AS n FROM fx_source UNION ALL SELECT 'extractions', count(*) FROM fx_extraction
    UNION ALL SELECT 'entities', count(*) FROM fx_entity UNION ALL SELECT 'variants', count(*) FROM fx_variant UNION ALL SELECT 'profiles', count(*) FROM fx_profile
    UNION ALL SELECT 'translations', count(*) FROM fx_translation UNION ALL SELECT 'jobs', count(*) FROM fx_job UNION ALL SELECT 'reviews', count(*) FROM fx_review""")
def system_counts(t):
    return s.system_counts(sources=t.fx_source, extractions=t.fx_extraction, entities=t.fx_entity, variants=t.fx_variant,
                           profiles=t.fx_profile, translations=t.fx_translation, jobs=t.fx_job, reviews=t.fx_review)


@query("setup_counts", """SELECT 'categories' AS "table", count(*) AS n FROM cfg_category UNION ALL SELECT 'prompts', count(*) FROM cfg_prompt
    UNION ALL SELECT 'mappings', count(*) FROM cfg_mapping""")
def setup_counts(t):
    return s.system_counts(categories=t.cfg_category, prompts=t.cfg_prompt, mappings=t.cfg_mapping)


@query("per_country", """SELECT coalesce(country, '??') AS country, count(*) AS n FROM (
    SELECT CASE WHEN c_custkey % 7 <> 0 THEN n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1 ORDER BY n DESC, country LIMIT 10""")
def per_country(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return s.per_country(rows.select(F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).alias("country")))


@query("prompts_by_group", "SELECT field_group, count(*) AS n FROM cfg_prompt GROUP BY 1")
def prompts_by_group(t):
    return s.prompts_by_group(t.cfg_prompt)


@query("homepage_counts", """SELECT c.category_id, c.internal_name, count(x.source_id) AS profiles FROM fx_category c
    LEFT JOIN (SELECT p.source_id, f.category_id FROM fx_profile p JOIN fx_source f USING (source_id) WHERE published) x ON x.category_id = c.category_id GROUP BY ALL""")
def homepage_counts(t):
    return s.homepage_counts(t.fx_category, t.fx_source, t.fx_profile).select("category_id", "internal_name", "profiles")


@query("english_homepage_counts", """SELECT c.category_id, c.display_name || ' (en)' AS display_name, count(*) AS profiles FROM fx_category c
    JOIN fx_source f ON f.category_id = c.category_id JOIN fx_profile p ON p.source_id = f.source_id WHERE p.published GROUP BY ALL""")
def english_homepage_counts(t):
    named = t.fx_category.withColumn("display_name_en", F.concat("display_name", F.lit(" (en)")))
    return s.homepage_counts(named, t.fx_source, t.fx_profile, "en").select("category_id", "display_name", "profiles")


@query("category_institutions", """SELECT DISTINCT f.category_id, e.validated_result AS institution FROM fx_extraction e JOIN fx_prompt p USING (prompt_id)
    JOIN fx_source f ON f.source_id = e.source_id JOIN fx_profile d ON d.source_id = f.source_id
    WHERE p.internal_name = 'institution' AND trim(e.validated_result) <> '' AND d.published""")
def category_institutions(t):
    return s.category_institutions(t.fx_extraction, t.fx_prompt, t.fx_source, t.fx_profile)


@query("profile_page_stats", """SELECT count(*) AS total, count(*) FILTER (published) AS published, count(*) FILTER (NOT published) AS unpublished,
    count(x.profile_id) AS translated, count(*) - count(x.profile_id) AS untranslated FROM fx_profile p LEFT JOIN fx_translation x ON x.profile_id = p.profile_id""")
def profile_page_stats(t):
    return s.profile_page_stats(t.fx_profile, t.fx_translation)


@query("revalidation_stats", """SELECT count(*) AS total, count(*) FILTER (raw_result <> '') AS with_raw,
    count(*) FILTER (raw_result <> '' AND (validated_result IS NULL OR validated_result = '')) AS missing_validation FROM fx_extraction""")
def revalidation_stats(t):
    return s.revalidation_stats(t.fx_extraction)


@query("quality_distribution", "SELECT validation_quality, count(*) AS n FROM fx_extraction GROUP BY 1")
def quality_distribution(t):
    return s.quality_distribution(t.fx_extraction)


@query("additions_per_day", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM fx_source GROUP BY 1")
def additions_per_day(t):
    return s.additions_per_day(t.fx_source)


_RECOVERY = f"""SELECT source_id, NULL::BIGINT AS prompt_id, 'crawl' AS job_type, 'pending' AS from_state FROM fx_source WHERE status = 'pending'
    UNION ALL SELECT source_id, prompt_id, 'extract', 'crawled' FROM ({_JOBS} AND s.status = 'crawled')
    UNION ALL SELECT source_id, prompt_id, 'extract', 'extracting' FROM ({_MISSING})"""


@query("recovery_jobs", _RECOVERY)
def recovery_jobs(t):
    return s.recovery_plan(t.fx_source, t.fx_category_prompt, t.fx_prompt, t.fx_extraction)[0]


@query("recovery_counts", f"""SELECT f.from_state, f.sources, coalesce(j.jobs, 0) AS jobs, CASE WHEN f.from_state = 'extracting' THEN (
        SELECT count(*) FROM fx_source WHERE status = 'extracting' AND category_id IS NOT NULL AND markdown_content <> ''
        AND source_id NOT IN (SELECT source_id FROM ({_MISSING}))) ELSE 0 END AS auto_completed
    FROM (SELECT status AS from_state, count(*) AS sources FROM fx_source WHERE status IN ('pending', 'crawled', 'extracting') GROUP BY 1) f
    LEFT JOIN (SELECT from_state, count(*) AS jobs FROM ({_RECOVERY}) GROUP BY 1) j USING (from_state)""")
def recovery_counts(t):
    return s.recovery_plan(t.fx_source, t.fx_category_prompt, t.fx_prompt, t.fx_extraction)[1]


@query("requeue_failed", "SELECT source_id, 'pending' AS status, NULL::VARCHAR AS error_message FROM fx_source WHERE status = 'failed'")
def requeue_failed(t):
    return s.reset_failed(t.fx_source).select("source_id", "status", "error_message")


@query("retry_extracting", f"{_JOBS} AND s.status = 'extracting'")
def retry_extracting(t):
    return r.fan_out_extract(t.fx_source.where("status = 'extracting'"), t.fx_category_prompt, t.fx_prompt)
