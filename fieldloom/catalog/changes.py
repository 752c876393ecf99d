"""State change queries: each returns the new table or the outcome rows."""

from pyspark.sql import functions as F

from fieldloom.catalog.publishing import _VEN, _categories, _field_rows
from fieldloom.catalog.records import _JOBS
from fieldloom.catalog.registry import query
from fieldloom.operators import changes as c, publishing as p

_NOW = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"
_DNOW = "TIMESTAMP '2024-06-01 00:00:00'"


def _d(text: str) -> str:
    """Table marks of a shared text as the twin writes them."""
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text).replace("TIMESTAMP_NTZ", "TIMESTAMP")


def _key(name: str, *parts: str) -> str:
    """The key that a new row gets."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{name}', {', '.join(parts)})), 1, 15) AS BIGINT)"


_NEW_EX = """SELECT source_id + CASE WHEN source_id % 2 = 0 THEN 1000000 ELSE 0 END AS source_id, prompt_id, 'new ' || raw_result AS raw_result,
    'checked' AS validated_result, 0.5 AS final_confidence FROM {fx_extraction} WHERE source_id % 3 = 0"""


@query("upserted_extractions", f"""SELECT coalesce(e.source_id, n.source_id) AS source_id, coalesce(e.prompt_id, n.prompt_id) AS prompt_id,
    CASE WHEN n.source_id IS NULL OR e.is_manual_edit THEN e.raw_result ELSE n.raw_result END AS raw_result,
    CASE WHEN n.source_id IS NULL OR e.is_manual_edit THEN e.validated_result ELSE n.validated_result END AS validated_result,
    CASE WHEN n.source_id IS NULL OR e.is_manual_edit THEN e.final_confidence ELSE CAST(n.final_confidence AS DOUBLE) END AS final_confidence, coalesce(e.is_manual_edit, false) AS is_manual_edit
    FROM fx_extraction e FULL JOIN ({_d(_NEW_EX)}) n ON n.source_id = e.source_id AND n.prompt_id = e.prompt_id""")
def upserted_extractions(t):
    rows = t.fx_extraction.select("source_id", "prompt_id", "raw_result", "validated_result", "final_confidence", "is_manual_edit")
    return c.upsert_extractions(rows, t.sql(_NEW_EX).withColumn("final_confidence", F.col("final_confidence").cast("double")))


@query("manual_edits", f"""SELECT extraction_id, CASE WHEN hit THEN 'fixed ' || extraction_id ELSE validated_result END AS validated_result, is_manual_edit OR hit AS is_manual_edit,
    CASE WHEN hit THEN 'editor' END AS edited_by, CASE WHEN hit THEN {_DNOW} ELSE extracted_at END AS updated_at FROM (SELECT *, source_id % 10 = 1 AS hit FROM fx_extraction)""")
def manual_edits(t):
    rows = t.fx_extraction.select("extraction_id", "validated_result", "is_manual_edit", F.lit(None).cast("string").alias("edited_by"), F.col("extracted_at").alias("updated_at"))
    edits = t.fx_extraction.where("source_id % 10 = 1").select("extraction_id", F.concat(F.lit("fixed "), F.col("extraction_id").cast("string")).alias("value"), F.lit("editor").alias("editor"), F.expr(_NOW).alias("edited_at"))
    return c.apply_manual_edits(rows, edits)


_ACTIONS = f"""SELECT review_id + CASE WHEN review_id % 41 = 0 THEN 100000000 ELSE 0 END AS review_id, CASE review_id % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'later' ELSE 'confirm' END AS action,
    CASE WHEN review_id % 4 = 2 THEN suggestion_id ELSE review_id % 50 END AS entity_id, 'ann' AS reviewer, {_NOW} AS at FROM {{fx_review}} WHERE review_id % 5 <> 3"""


@query("review_errors", f"""SELECT a.review_id, a.action, CASE WHEN q.review_id IS NULL THEN 'unknown review' WHEN a.action = 'later' THEN 'unknown action' ELSE 'entity required' END AS error
    FROM ({_d(_ACTIONS)}) a LEFT JOIN fx_review q ON q.review_id = a.review_id WHERE q.review_id IS NULL OR a.action = 'later' OR (a.action = 'confirm' AND a.entity_id IS NULL)""")
def review_errors(t):
    return c.review_errors(t.fx_review, t.sql(_ACTIONS))


_VALID = f"(SELECT * FROM ({_d(_ACTIONS)}) WHERE action = 'reject' OR (action = 'confirm' AND entity_id IS NOT NULL))"


def _reviews(t):
    reviews = t.fx_review.withColumn("reviewed_by", F.lit(None).cast("string")).withColumn("reviewed_at", F.lit(None).cast("timestamp_ntz"))
    rows = t.fx_extraction.select("extraction_id", "linked_entity_id", F.lit(None).cast("double").alias("entity_confidence"))
    return c.apply_reviews(reviews, rows, t.sql(_ACTIONS))


@query("applied_reviews", f"""SELECT q.review_id, CASE a.action WHEN 'confirm' THEN 'reviewed' WHEN 'reject' THEN 'ignored' ELSE q.status END AS status, a.reviewer AS reviewed_by, a.at AS reviewed_at
    FROM fx_review q LEFT JOIN {_VALID} a ON a.review_id = q.review_id""")
def applied_reviews(t):
    return _reviews(t)[0].select("review_id", "status", "reviewed_by", "reviewed_at")


@query("reviewed_links", f"""SELECT e.extraction_id, CASE WHEN x.review_id IS NOT NULL THEN x.entity_id ELSE e.linked_entity_id END AS linked_entity_id,
    CASE WHEN x.review_id IS NOT NULL THEN CAST(coalesce(x.confidence, 1.0) AS DOUBLE) END AS entity_confidence FROM fx_extraction e LEFT JOIN (
      SELECT a.review_id, a.entity_id, q.extraction_id, q.confidence FROM {_VALID} a JOIN fx_review q ON q.review_id = a.review_id WHERE a.action = 'confirm') x ON x.extraction_id = e.extraction_id""")
def reviewed_links(t):
    return _reviews(t)[1]


@query("published_some", f"""SELECT profile_id, CASE WHEN hit THEN true ELSE published END AS published, CASE WHEN hit THEN {_DNOW} ELSE published_at END AS published_at
    FROM (SELECT *, profile_id % 4 = 0 AS hit FROM fx_profile)""")
def published_some(t):
    return c.publish(t.fx_profile, t.fx_profile.where("profile_id % 4 = 0"), True, F.expr(_NOW)).select("profile_id", "published", "published_at")


@query("unpublished_some", """SELECT profile_id, CASE WHEN hit THEN false ELSE published END AS published, CASE WHEN hit THEN NULL ELSE published_at END AS published_at
    FROM (SELECT *, profile_id % 4 = 1 AS hit FROM fx_profile)""")
def unpublished_some(t):
    return c.publish(t.fx_profile, t.fx_profile.where("profile_id % 4 = 1"), False, F.expr(_NOW)).select("profile_id", "published", "published_at")


@query("published_all", f"SELECT profile_id, true AS published, CASE WHEN NOT published THEN {_DNOW} ELSE published_at END AS published_at FROM fx_profile")
def published_all(t):
    return c.publish(t.fx_profile, None, True, F.expr(_NOW)).select("profile_id", "published", "published_at")


def _gone_sources(t):
    return t.fx_profile.where("profile_id % 3 = 0").select((F.col("source_id") * 20).alias("source_id"))


@query("deleted_sources", "SELECT source_id, prompt_id FROM fx_extraction WHERE source_id NOT IN (SELECT source_id * 20 FROM fx_profile WHERE profile_id % 3 = 0)")
def deleted_sources(t):
    return c.delete_cascade(_gone_sources(t), "source_id", extractions=t.fx_extraction)["extractions"].select("source_id", "prompt_id")


@query("delete_counts", """WITH_GONE SELECT 'sources' AS "table", count(*) AS n FROM fx_source WHERE source_id IN (SELECT id FROM gone) UNION ALL
    SELECT 'extractions', count(*) FROM fx_extraction WHERE source_id IN (SELECT id FROM gone) UNION ALL SELECT 'profiles', count(*) FROM fx_profile WHERE source_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'not_found', count(*) FROM gone WHERE id NOT IN (SELECT source_id FROM fx_source)""".replace("WITH_GONE ", ""),
    "gone AS (SELECT source_id * 20 AS id FROM fx_profile WHERE profile_id % 3 = 0)")
def delete_counts(t):
    return c.delete_counts(_gone_sources(t), "source_id", sources=t.fx_source, extractions=t.fx_extraction, profiles=t.fx_profile)


@query("delete_not_found", "SELECT DISTINCT id AS source_id FROM gone WHERE id NOT IN (SELECT source_id FROM fx_source)",
    "gone AS (SELECT source_id * 20 AS id FROM fx_profile WHERE profile_id % 3 = 0)")
def delete_not_found(t):
    return c.not_found(_gone_sources(t), "source_id", t.fx_source)


def _without_entities(t):
    return c.delete_entities(t.fx_entity.where("entity_id % 6 = 0"), t.fx_entity, t.fx_variant, t.fx_extraction, t.fx_review)


@query("entities_deleted_links", """SELECT extraction_id, CASE WHEN linked_entity_id IN (SELECT entity_id FROM fx_entity WHERE entity_id % 6 = 0) THEN NULL ELSE linked_entity_id END AS linked_entity_id FROM fx_extraction""")
def entities_deleted_links(t):
    return _without_entities(t)["extractions"].select("extraction_id", "linked_entity_id")


@query("entities_deleted_reviews", """SELECT review_id, CASE WHEN hit THEN NULL ELSE suggestion_id END AS suggestion_id, CASE WHEN hit THEN NULL ELSE CAST(confidence AS DOUBLE) END AS confidence
    FROM (SELECT *, coalesce(suggestion_id IN (SELECT entity_id FROM fx_entity WHERE entity_id % 6 = 0), false) AS hit FROM fx_review)""")
def entities_deleted_reviews(t):
    return _without_entities(t)["reviews"].select("review_id", "suggestion_id", F.col("confidence").cast("double").alias("confidence"))


@query("entities_deleted_variants", "SELECT entity_id, variant_name FROM fx_variant WHERE entity_id % 6 <> 0")
def entities_deleted_variants(t):
    return _without_entities(t)["variants"].select("entity_id", "variant_name")


_RENDERED = "SELECT source_id, 'text of ' || url AS markdown_content FROM {fx_source} WHERE status = 'completed'"


@query("upserted_profiles", f"""SELECT coalesce(p.source_id, n.source_id) AS source_id, coalesce(p.profile_id, {_key("profile_id", "n.source_id")}) AS profile_id, CASE WHEN n.source_id IS NOT NULL THEN n.markdown_content ELSE p.markdown_content END AS markdown_content,
    coalesce(p.published, false) AS published, CASE WHEN n.source_id IS NOT NULL THEN {_DNOW} ELSE p.generated_at END AS generated_at, p.published_at
    FROM fx_profile p FULL JOIN ({_d(_RENDERED)}) n ON n.source_id = p.source_id""")
def upserted_profiles(t):
    return c.upsert_profiles(t.fx_profile, t.sql(_RENDERED), F.expr(_NOW))


@query("upserted_translations", f"""SELECT coalesce(x.profile_id, n.profile_id) AS profile_id, 'en' AS language, coalesce(n.markdown_content, x.markdown_content) AS markdown_content,
    coalesce(n.source_hash, x.source_hash) AS source_hash FROM fx_translation x FULL JOIN (
      SELECT p.profile_id, r.markdown_content, sha256(p.markdown_content) AS source_hash FROM ({_d(_RENDERED)}) r JOIN fx_profile p USING (source_id)) n ON n.profile_id = x.profile_id""")
def upserted_translations(t):
    rows = t.fx_translation.withColumn("translated_at", F.lit(None).cast("timestamp_ntz"))
    return c.upsert_translations(rows, t.fx_profile, t.sql(_RENDERED), "en", F.expr(_NOW))[0].drop("translated_at")


@query("translations_without_base", f"SELECT source_id, 'no base profile' AS error FROM ({_d(_RENDERED)}) WHERE source_id NOT IN (SELECT source_id FROM fx_profile)")
def translations_without_base(t):
    rows = t.fx_translation.withColumn("translated_at", F.lit(None).cast("timestamp_ntz"))
    return c.upsert_translations(rows, t.fx_profile, t.sql(_RENDERED), "en", F.expr(_NOW))[1]


_ACTIVE = "SELECT DISTINCT category_id FROM fx_category_prompt JOIN fx_prompt USING (prompt_id) WHERE is_active"
# Extra sources of a category without prompts, which fail.
_MORE = "more AS (SELECT * FROM fx_source UNION ALL SELECT * REPLACE (-source_id AS source_id, 99 AS category_id) FROM fx_source WHERE source_id % 50 = 1)"


def _more_sources(t):
    kinds = {c: t.fx_source.schema[c].dataType for c in ("source_id", "category_id")}
    stray = t.fx_source.where("source_id % 50 = 1").withColumns({"source_id": (-F.col("source_id")).cast(kinds["source_id"]), "category_id": F.lit(99).cast(kinds["category_id"])})
    return t.fx_source.unionByName(stray)


def _reextract(t):
    return c.reextract_all(_more_sources(t), t.fx_extraction, t.fx_profile, t.fx_category_prompt, t.fx_prompt)


@query("reextracted_sources", f"""SELECT source_id, CASE WHEN NOT hit THEN status WHEN ok THEN 'crawled' ELSE 'failed' END AS status,
    CASE WHEN NOT hit THEN error_message WHEN NOT ok THEN 'no prompts for this category' END AS error_message
    FROM (SELECT *, status IN ('completed', 'extracting') AS hit, coalesce(category_id IN ({_ACTIVE}), false) AS ok FROM more)""", _MORE)
def reextracted_sources(t):
    return _reextract(t)["sources"].select("source_id", "status", "error_message")


@query("reextract_jobs", f"{_JOBS} AND s.status IN ('completed', 'extracting')")
def reextract_jobs(t):
    return _reextract(t)["jobs"]


@query("reextract_kept", """SELECT extraction_id FROM fx_extraction
    WHERE is_manual_edit OR source_id NOT IN (SELECT source_id FROM fx_source WHERE status IN ('completed', 'extracting'))""")
def reextract_kept(t):
    return _reextract(t)["extractions"].select("extraction_id")


# Some move to a category without prompts.
_NEW_CATEGORY = "CASE WHEN source_id % 45 = 2 THEN 99 ELSE source_id % 5 + 1 END"


def _moved(t):
    moves = t.fx_source.where("source_id % 9 = 2").select("source_id", F.expr(_NEW_CATEGORY).alias("category_id"))
    return c.change_category(t.fx_source, moves, t.fx_extraction, t.fx_profile, t.fx_category_prompt, t.fx_prompt)


@query("moved_sources", f"""SELECT source_id, new_cat AS category_id, CASE WHEN run THEN 'crawled' ELSE status END AS status, CASE WHEN run THEN NULL ELSE error_message END AS error_message FROM (
    SELECT *, hit AND status IN ('completed', 'crawled', 'extracting') AND new_cat IN ({_ACTIVE}) AS run FROM (
    SELECT *, source_id % 9 = 2 AS hit, CASE WHEN source_id % 9 = 2 THEN {_NEW_CATEGORY} ELSE category_id END AS new_cat FROM fx_source))""")
def moved_sources(t):
    return _moved(t)["sources"].select("source_id", "category_id", "status", "error_message")


@query("moved_source_jobs", f"""SELECT s.source_id, m.prompt_id FROM fx_source s JOIN fx_category_prompt m ON m.category_id = ({_NEW_CATEGORY}) JOIN fx_prompt p ON p.prompt_id = m.prompt_id
    WHERE p.is_active AND s.source_id % 9 = 2 AND s.status IN ('completed', 'crawled', 'extracting') AND s.markdown_content <> ''""")
def moved_source_jobs(t):
    return _moved(t)["jobs"]


_RECHECK = """SELECT extraction_id, 'again ' || raw_result AS result, 'LOW' AS quality, CAST(extraction_id % 100 AS DOUBLE) / 100 AS score, '-' AS notes,
    CASE WHEN extraction_id % 7 = 0 THEN 'refused' END AS error FROM {fx_extraction} WHERE validated_result IS NULL OR validated_result = '' OR is_manual_edit"""


@query("revalidated", f"""SELECT e.extraction_id, CASE WHEN n.extraction_id IS NOT NULL THEN n.result ELSE e.validated_result END AS validated_result,
    CASE WHEN n.extraction_id IS NOT NULL THEN n.quality ELSE e.validation_quality END AS validation_quality, CASE WHEN n.extraction_id IS NOT NULL THEN n.score ELSE e.validation_score END AS validation_score,
    CASE WHEN n.extraction_id IS NOT NULL THEN least(coalesce(e.raw_confidence, 0.0), n.score) ELSE e.final_confidence END AS final_confidence
    FROM fx_extraction e LEFT JOIN (SELECT * FROM ({_d(_RECHECK)}) WHERE error IS NULL) n ON n.extraction_id = e.extraction_id AND NOT e.is_manual_edit""")
def revalidated(t):
    return c.revalidate(t.fx_extraction, t.sql(_RECHECK)).select("extraction_id", "validated_result", "validation_quality", "validation_score", "final_confidence")


@query("revalidation_counts", f"SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS validated, count(error) AS failed FROM ({_d(_RECHECK)})")
def revalidation_counts(t):
    return c.revalidation_counts(t.sql(_RECHECK))


_REQUESTS = """SELECT event_id AS request_id, CASE WHEN event_id % 13 = 0 THEN ' ' WHEN event_id % 4 = 0 THEN 'host' || CAST(event_id % 50 AS STRING) || '.example.org/p/' || CAST(event_id AS STRING)
    ELSE ' https://new.example.org/' || CAST(event_id % 40 AS STRING) END AS url, user_id % 5 + 1 AS category_id, CASE WHEN event_id % 3 = 0 THEN value END AS rate_limit FROM {events}"""
_CLEANED = f"""SELECT *, CASE WHEN trim(url) = '' THEN NULL WHEN trim(url) LIKE 'http%' THEN trim(url) ELSE 'https://' || trim(url) END AS u FROM ({_d(_REQUESTS)})"""
_FRESH = f"""SELECT min(request_id) FROM ({_CLEANED}) WHERE u IS NOT NULL AND u NOT IN (SELECT url FROM fx_source) GROUP BY u"""


@query("registered_sources", f"SELECT request_id, {_key('source_id', 'u')} AS source_id, u AS url, category_id, 'pending' AS status FROM ({_CLEANED}) WHERE request_id IN ({_FRESH})")
def registered_sources(t):
    return c.register_sources(t.fx_source, t.sql(_REQUESTS))[0]


@query("registered_jobs", f"SELECT request_id, {_key('source_id', 'u')} AS source_id, u AS url, 'crawl' AS job_type, coalesce(rate_limit, 1.0) AS rate_limit FROM ({_CLEANED}) WHERE request_id IN ({_FRESH})")
def registered_jobs(t):
    return c.register_sources(t.fx_source, t.sql(_REQUESTS))[1]


@query("refused_sources", f"SELECT request_id, url, CASE WHEN u IS NULL THEN 'invalid url' ELSE 'url already registered' END AS error FROM ({_CLEANED}) WHERE request_id NOT IN ({_FRESH})")
def refused_sources(t):
    return c.register_sources(t.fx_source, t.sql(_REQUESTS))[2]


@query("partial_updates", """SELECT source_id, CASE WHEN source_id % 3 = 1 THEN 'failed' ELSE status END AS status, CASE WHEN source_id % 3 = 1 THEN NULL WHEN source_id % 3 = 2 THEN 4 ELSE category_id END AS category_id, url
    FROM fx_source""")
def partial_updates(t):
    values = F.when(F.col("source_id") % 3 == 1, F.create_map(F.lit("status"), F.lit("failed"), F.lit("category_id"), F.lit(None).cast("string"))).otherwise(
        F.create_map(F.lit("category_id"), F.lit("4")))
    changes = t.fx_source.where("source_id % 3 <> 0").select("source_id", values.alias("values"))
    return c.apply_updates(t.fx_source.select("source_id", "status", "category_id", "url"), changes, "source_id")


@query("insert_conflicts", "SELECT p_partkey, 'Supplier#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS canonical_name, 'already exists' AS error FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def insert_conflicts(t):
    new = t.part.select("p_partkey", F.expr("'Supplier#' || lpad(CAST(p_partkey AS STRING), 9, '0')").alias("canonical_name"))
    return c.insert_unique(t.fx_entity, new, "canonical_name")[1]


@query("flagged_prompts", "SELECT prompt_id, CASE WHEN display_name LIKE '%ring' THEN false ELSE translatable END AS translatable FROM cfg_prompt")
def flagged_prompts(t):
    names = t.cfg_prompt.where("display_name LIKE '%ring'").select("internal_name")
    return c.set_flag(t.cfg_prompt, names, "internal_name", "translatable", False).select("prompt_id", "translatable")


@query("edited_mapping", """SELECT category_id, prompt_id FROM cfg_mapping WHERE prompt_id % 10 <> 3 UNION SELECT s_suppkey, s_suppkey * 3 FROM supplier""")
def edited_mapping(t):
    add = t.supplier.select(F.col("s_suppkey").alias("category_id"), (F.col("s_suppkey") * 3).alias("prompt_id"))
    remove = t.cfg_mapping.where("prompt_id % 10 = 3")
    return c.edit_links(t.cfg_mapping, add, remove).select("category_id", "prompt_id")


@query("retired_categories", """SELECT category_id, n AS sources, CASE WHEN n > 0 THEN 'deactivated' ELSE 'deleted' END AS action FROM (
    SELECT c.category_id, count(o_orderkey) AS n FROM cfg_category c LEFT JOIN orders ON o_custkey % 1500 = c.category_id WHERE c.category_id % 2 = 0 GROUP BY ALL)""")
def retired_categories(t):
    sources = t.orders.select((F.col("o_custkey") % 1500).alias("category_id"))
    return c.retire_categories(t.cfg_category, t.cfg_category.where("category_id % 2 = 0"), sources)


@query("deleted_prompts", """SELECT prompt_id, n AS extractions, CASE WHEN n > 0 THEN 'refused' ELSE 'deleted' END AS action FROM (
    SELECT p.prompt_id, count(l_partkey) AS n FROM cfg_prompt p LEFT JOIN lineitem ON l_partkey = p.prompt_id WHERE p.prompt_id % 2 = 1 GROUP BY ALL)""")
def deleted_prompts(t):
    used = t.lineitem.select(F.col("l_partkey").alias("prompt_id"))
    return c.delete_prompts(t.cfg_prompt, t.cfg_prompt.where("prompt_id % 2 = 1"), used)


_NEW_VARIANTS = """SELECT c_custkey AS request_id, c_custkey % 50 AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'SUP-' || CAST(c_custkey % 400 AS STRING) ELSE 'alias ' || CAST(c_custkey % 700 AS STRING) END AS variant_name FROM {customer}"""
_FIRST = f"SELECT n.*, o.owner, first_value(n.entity_id) OVER w AS first_entity, first_value(n.request_id) OVER w AS first_request FROM ({_d(_NEW_VARIANTS)}) n LEFT JOIN (SELECT variant_name, min(entity_id) AS owner FROM fx_variant GROUP BY 1) o USING (variant_name) WINDOW w AS (PARTITION BY n.variant_name ORDER BY n.request_id)"


@query("added_variants", f"SELECT request_id, entity_id, variant_name FROM ({_FIRST}) WHERE owner IS NULL AND first_request = request_id")
def added_variants(t):
    return c.add_variants(t.fx_variant, t.fx_entity, t.sql(_NEW_VARIANTS))[0]


@query("variant_conflicts", f"""SELECT f.request_id, f.variant_name, coalesce(f.owner, f.first_entity) AS owner_id, e.canonical_name AS owner FROM ({_FIRST}) f
    LEFT JOIN fx_entity e ON e.entity_id = coalesce(f.owner, f.first_entity) WHERE f.owner IS NOT NULL OR f.first_request <> f.request_id""")
def variant_conflicts(t):
    return c.add_variants(t.fx_variant, t.fx_entity, t.sql(_NEW_VARIANTS))[1]


@query("regenerated_profiles", f"""SELECT {_key('profile_id', 's.source_id')} AS profile_id, s.source_id, '# ' || coalesce(a, '-') || chr(10) || chr(10) || '**Institution:** ' || coalesce(b, '-') || chr(10) || chr(10) || '## Beschreibung' || chr(10)
    || coalesce(d, '-') || ' costs $5, -' || chr(10) || s.url || ' (' || strftime(coalesce(s.crawled_at, {_DNOW}), '%Y-%m-%d') || ')' AS markdown_content, false AS published, {_DNOW} AS generated_at
    FROM fx_source s JOIN fx_category c ON c.category_id = s.category_id LEFT JOIN (SELECT source_id, max(v) FILTER (internal_name = 'project_name') AS a,
      max(v) FILTER (internal_name = 'institution') AS b, max(v) FILTER (internal_name = 'short_description') AS d FROM ({_field_rows(_VEN)}) GROUP BY source_id) x ON x.source_id = s.source_id
    WHERE s.status = 'completed'""")
def regenerated_profiles(t):
    rendered = p.render_profiles(t.fx_extraction, t.fx_prompt, t.fx_source, _categories(t), F.expr(_NOW), "en")
    return c.regenerate_profiles(t.fx_source, rendered, F.expr(_NOW))


_EDITS = """SELECT extraction_id, 'edit ' || CAST(k AS STRING) || ' of ' || CAST(extraction_id AS STRING) AS value, 'editor ' || CAST(k AS STRING) AS editor,
    CASE WHEN k = 2 THEN TIMESTAMP_NTZ '2024-05-02 00:00:00' ELSE TIMESTAMP_NTZ '2024-05-01 00:00:00' END AS edited_at
    FROM {fx_extraction} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE source_id % 7 < k"""


@query("repeated_edits", f"""SELECT e.extraction_id, coalesce(n.value, e.validated_result) AS validated_result, e.is_manual_edit OR n.value IS NOT NULL AS is_manual_edit, n.editor AS edited_by
    FROM fx_extraction e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY edited_at DESC, value DESC) AS r FROM ({_d(_EDITS)})) n
    ON n.extraction_id = e.extraction_id AND n.r = 1""")
def repeated_edits(t):
    rows = t.fx_extraction.select("extraction_id", "validated_result", "is_manual_edit", F.lit(None).cast("string").alias("edited_by"), F.col("extracted_at").alias("updated_at"))
    return c.apply_manual_edits(rows, t.sql(_EDITS)).drop("updated_at")


@query("inserted_extractions", f"""SELECT coalesce(e.extraction_id, {_key("extraction_id", "n.source_id", "n.prompt_id")}) AS extraction_id
    FROM fx_extraction e FULL JOIN ({_d(_NEW_EX)}) n ON n.source_id = e.source_id AND n.prompt_id = e.prompt_id""")
def inserted_extractions(t):
    """Twice the same new rows: each is inserted once, with a key."""
    new = t.sql(_NEW_EX).withColumn("final_confidence", F.col("final_confidence").cast("double"))
    return c.upsert_extractions(t.fx_extraction, new.unionByName(new)).select("extraction_id")


_STEPS = """SELECT source_id, k AS at, CASE WHEN k = 1 THEN 'status' WHEN k = 2 THEN 'category_id' ELSE 'status' END AS name, CASE WHEN k = 1 THEN 'failed' WHEN k = 2 THEN '4' ELSE 'step 3' END AS value
    FROM {fx_source} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE source_id % 4 >= k"""


@query("successive_updates", """SELECT source_id, CASE WHEN source_id % 4 = 3 THEN 'step 3' WHEN source_id % 4 >= 1 THEN 'failed' ELSE status END AS status,
    CASE WHEN source_id % 4 >= 2 THEN 4 ELSE category_id END AS category_id FROM fx_source""")
def successive_updates(t):
    changes = t.sql(_STEPS).select("source_id", "at", F.create_map("name", "value").alias("values"))
    return c.apply_updates(t.fx_source.select("source_id", "status", "category_id"), changes, "source_id")
