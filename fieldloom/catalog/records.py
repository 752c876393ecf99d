"""Selection, join and integrity queries over the record tables."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.operators import records as r
from fieldloom.plans.order import attach_row
from fieldloom.sources.sinks import write_observed
from fieldloom.streaming.sinks import work_folder

_VALUE = "validated_result IS NOT NULL AND validated_result <> ''"
_NOTBLANK = "trim(coalesce(validated_result, '')) <> ''"


@query("list_sources", """SELECT source_id, url, status, category_id FROM fx_source
    WHERE status = 'completed' AND category_id = 2 ORDER BY source_id LIMIT 50 OFFSET 10""")
def list_sources(t):
    return r.list_sources(t.fx_source, "completed", 2, offset=10, limit=50).select("source_id", "url", "status", "category_id")


@query("active_prompts", "SELECT prompt_id, internal_name, field_group FROM cfg_prompt WHERE is_active AND entity_type = 'university'")
def active_prompts(t):
    return r.active_only(t.cfg_prompt).where("entity_type = 'university'").select("prompt_id", "internal_name", "field_group")


@query("entities_of_type", "SELECT entity_id, canonical_name FROM fx_entity WHERE entity_type = 'university'")
def entities_of_type(t):
    return t.fx_entity.where("entity_type = 'university'").select("entity_id", "canonical_name")


@query("sources_by_url", """SELECT source_id, url, status FROM fx_source
    WHERE url IN (SELECT 'https://host' || CAST(user_id % 50 AS STRING) || '.example.org/p/' || CAST(event_id AS STRING) FROM events)""")
def sources_by_url(t):
    wanted = t.events.select(F.expr("'https://host' || CAST(user_id % 50 AS STRING) || '.example.org/p/' || CAST(event_id AS STRING)").alias("url"))
    return r.lookup(t.fx_source, wanted, ["url"]).select("source_id", "url", "status")


@query("extraction_by_key", """SELECT source_id, prompt_id, validated_result FROM fx_extraction
    WHERE (source_id, prompt_id) IN (SELECT event_id, user_id % 7 + 1 FROM events)""")
def extraction_by_key(t):
    wanted = t.events.select(F.col("event_id").alias("source_id"), (F.col("user_id") % 7 + 1).alias("prompt_id"))
    return r.lookup(t.fx_extraction, wanted, ["source_id", "prompt_id"]).select("source_id", "prompt_id", "validated_result")


@query("entity_by_variant", """SELECT DISTINCT entity_id, canonical_name, variant_name FROM fx_variant JOIN fx_entity USING (entity_id)
    WHERE variant_name IN (SELECT upper(validated_result) FROM fx_extraction)""")
def entity_by_variant(t):
    asked = t.fx_extraction.select(F.upper("validated_result").alias("variant_name"))
    return r.entities_by_variant(t.fx_entity, t.fx_variant, asked).select("entity_id", "canonical_name", "variant_name")


@query("record_join", """SELECT e.source_id, e.prompt_id, p.internal_name AS field, s.url, c.display_name AS category, e.validated_result
    FROM fx_extraction e JOIN fx_prompt p USING (prompt_id) JOIN fx_source s USING (source_id) JOIN fx_category c ON s.category_id = c.category_id""")
def record_join(t):
    return r.record_join(t.fx_extraction, t.fx_prompt, t.fx_source, t.fx_category).select(
        "source_id", "prompt_id", "field", "url", "category", "validated_result")


@query("low_confidence", """SELECT e.source_id, e.prompt_id, e.final_confidence, s.url, c.display_name AS category, p.internal_name AS field
    FROM fx_extraction e JOIN fx_prompt p USING (prompt_id) JOIN fx_source s USING (source_id) JOIN fx_category c ON s.category_id = c.category_id
    WHERE e.final_confidence < 0.7""")
def low_confidence(t):
    joined = r.record_join(r.low_confidence(t.fx_extraction), t.fx_prompt, t.fx_source, t.fx_category)
    return joined.select("source_id", "prompt_id", "final_confidence", "url", "category", "field")


@query("below_required", """SELECT source_id, prompt_id, final_confidence, required_confidence FROM fx_extraction JOIN fx_prompt USING (prompt_id)
    WHERE final_confidence < required_confidence""")
def below_required(t):
    return r.below_required(t.fx_extraction, t.fx_prompt).select("source_id", "prompt_id", "final_confidence", "required_confidence")


@query("publishable_fields", f"""SELECT source_id, internal_name, validated_result, final_confidence FROM fx_extraction JOIN fx_prompt USING (prompt_id)
    WHERE {_NOTBLANK} AND final_confidence >= required_confidence""")
def publishable_fields(t):
    return r.publishable_fields(t.fx_extraction, t.fx_prompt).select("source_id", "internal_name", "validated_result", "final_confidence")


@query("normalization_candidates", """SELECT source_id, prompt_id, validated_result FROM fx_extraction
    WHERE linked_entity_id IS NULL AND validated_result IS NOT NULL
      AND prompt_id IN (SELECT prompt_id FROM fx_prompt WHERE entity_type = 'university')""")
def normalization_candidates(t):
    return r.normalization_candidates(t.fx_extraction, t.fx_prompt, "university").select("source_id", "prompt_id", "validated_result")


@query("review_items", """SELECT q.review_id, q.raw_text, q.confidence, s.url, c.display_name AS category, p.internal_name AS field,
    n.canonical_name AS suggestion, v.names AS variants
    FROM fx_review q JOIN fx_extraction e USING (extraction_id) JOIN fx_source s ON e.source_id = s.source_id
    LEFT JOIN fx_category c ON s.category_id = c.category_id JOIN fx_prompt p ON p.prompt_id = e.prompt_id
    LEFT JOIN fx_entity n ON n.entity_id = q.suggestion_id
    LEFT JOIN (SELECT entity_id, string_agg(variant_name, '; ' ORDER BY variant_name) AS names FROM fx_variant GROUP BY entity_id) v ON v.entity_id = n.entity_id
    WHERE q.status = 'pending' AND q.entity_type = 'university'""")
def review_items(t):
    out = r.review_items(t.fx_review, t.fx_extraction, t.fx_source, t.fx_category, t.fx_prompt, t.fx_entity, t.fx_variant, "pending", "university")
    return out.select("review_id", "raw_text", "confidence", "url", "category", "field", "suggestion", F.array_join("variants", "; ").alias("variants"))


@query("pending_translation", f"""SELECT source_id, prompt_id, validated_result FROM fx_extraction
    WHERE {_VALUE} AND (translation_status = 'pending' OR translation_status IS NULL)""")
def pending_translation(t):
    return r.pending_translation(t.fx_extraction).select("source_id", "prompt_id", "validated_result")


@query("pending_translation_batch", f"""SELECT source_id, prompt_id FROM fx_extraction JOIN fx_prompt USING (prompt_id)
    WHERE {_VALUE} AND translatable AND (translation_status = 'pending' OR translation_status IS NULL OR validated_result_en IS NULL)""")
def pending_translation_batch(t):
    return r.pending_translation_batch(t.fx_extraction, t.fx_prompt).select("source_id", "prompt_id")


@query("forced_translation", f"SELECT source_id, prompt_id FROM fx_extraction JOIN fx_prompt USING (prompt_id) WHERE {_VALUE} AND translatable")
def forced_translation(t):
    return r.pending_translation_batch(t.fx_extraction, t.fx_prompt, force=True).select("source_id", "prompt_id")


@query("sources_needing_translation", f"""SELECT DISTINCT source_id FROM fx_extraction
    WHERE {_VALUE} AND (validated_result_en IS NULL OR validated_result_en = '')""")
def sources_needing_translation(t):
    return r.sources_needing_translation(t.fx_extraction, t.fx_profile)


_STATE = """SELECT p.profile_id, p.source_id, p.published, CASE WHEN x.profile_id IS NULL THEN 'pending'
    WHEN x.source_hash <> sha256(coalesce(p.markdown_content, '')) THEN 'outdated' ELSE 'translated' END AS translation_state
    FROM fx_profile p LEFT JOIN (SELECT * FROM fx_translation WHERE language = 'en') x ON x.profile_id = p.profile_id"""


@query("translation_state", _STATE)
def translation_state(t):
    return r.translation_state(t.fx_profile, t.fx_translation)


@query("profiles_needing_translation", f"SELECT profile_id FROM ({_STATE}) WHERE published AND translation_state <> 'translated'")
def profiles_needing_translation(t):
    return r.profiles_needing_translation(t.fx_profile, t.fx_translation)


@query("translated_profiles", """SELECT p.profile_id, x.markdown_content AS translated_markdown,
    (SELECT count(*) FROM fx_profile WHERE profile_id NOT IN (SELECT profile_id FROM fx_translation)) AS skipped
    FROM fx_profile p JOIN fx_translation x USING (profile_id)""")
def translated_profiles(t):
    kept, skipped = r.translated_profiles(t.fx_profile, t.fx_translation)
    return attach_row(kept.select("profile_id", "translated_markdown"), skipped)


@query("has_translation", """SELECT DISTINCT source_id FROM fx_extraction JOIN fx_prompt USING (prompt_id)
    WHERE translatable AND validated_result_en <> ''""")
def has_translation(t):
    return r.has_translation(t.fx_extraction, t.fx_prompt)


@query("stuck_extracting", """SELECT source_id, 'failed' AS status, 'no progress for 2 h' AS error_message FROM fx_source
    WHERE status = 'extracting' AND updated_at < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL '2' HOUR""")
def stuck_extracting(t):
    now = F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    return r.stuck_extracting(t.fx_source, now).select("source_id", "status", "error_message")


@query("revalidation_candidates", """SELECT source_id, prompt_id, raw_result FROM fx_extraction
    WHERE raw_result <> '' AND (validated_result IS NULL OR validated_result = '')""")
def revalidation_candidates(t):
    return r.revalidation_candidates(t.fx_extraction).select("source_id", "prompt_id", "raw_result")


@query("profiles_by_status", """SELECT profile_id, source_id, category_id FROM fx_profile JOIN fx_source USING (source_id)
    WHERE NOT published AND category_id = 3""")
def profiles_by_status(t):
    return r.profiles_by_status(t.fx_profile, t.fx_source, published=False, category_id=3).select("profile_id", "source_id", "category_id")


@query("published_profiles", """SELECT profile_id, source_id, url AS source_url, markdown_content FROM fx_profile JOIN
    (SELECT source_id, url FROM fx_source) USING (source_id) WHERE published""")
def published_profiles(t):
    return r.published_profile(t.fx_profile, t.fx_source).select("profile_id", "source_id", "source_url", "markdown_content")


@query("source_markdown", "SELECT source_id, markdown_content FROM fx_source WHERE markdown_content <> ''")
def source_markdown(t):
    return r.source_markdown(t.fx_source)


@query("category_prompts_ordered", """SELECT c.internal_name AS category, p.internal_name AS field, m.display_order
    FROM cfg_mapping m JOIN cfg_category c USING (category_id) JOIN cfg_prompt p USING (prompt_id)""")
def category_prompts_ordered(t):
    return r.category_prompts_ordered(t.cfg_category, t.cfg_mapping, t.cfg_prompt).select("category", "field", "display_order")


_JOBS = """SELECT s.source_id, m.prompt_id FROM fx_source s JOIN fx_category_prompt m ON s.category_id = m.category_id
    JOIN fx_prompt p ON p.prompt_id = m.prompt_id WHERE p.is_active AND s.markdown_content <> ''"""


@query("fan_out_extract", f"{_JOBS} AND s.status = 'crawled'")
def fan_out_extract(t):
    return r.fan_out_extract(t.fx_source.where("status = 'crawled'"), t.fx_category_prompt, t.fx_prompt)


_MISSING = f"{_JOBS} AND s.status = 'extracting' AND (s.source_id, m.prompt_id) NOT IN (SELECT source_id, prompt_id FROM fx_extraction)"


@query("missing_prompts", _MISSING)
def missing_prompts(t):
    return r.missing_prompts(t.fx_source.where("status = 'extracting'"), t.fx_category_prompt, t.fx_prompt, t.fx_extraction)


@query("fully_extracted", f"""SELECT source_id FROM fx_source WHERE status = 'extracting' AND category_id IS NOT NULL AND markdown_content <> ''
    AND source_id NOT IN (SELECT source_id FROM ({_MISSING}))""")
def fully_extracted(t):
    return r.fully_extracted(t.fx_source.where("status = 'extracting'"), t.fx_category_prompt, t.fx_prompt, t.fx_extraction)


@query("unassigned_prompts", """SELECT prompt_id, internal_name FROM cfg_prompt WHERE is_active
    AND prompt_id NOT IN (SELECT prompt_id FROM cfg_mapping WHERE category_id = 3)""")
def unassigned_prompts(t):
    return r.unassigned_prompts(t.cfg_mapping, t.cfg_prompt, 3).select("prompt_id", "internal_name")


@query("sources_without_profile", """SELECT source_id, url FROM fx_source WHERE status = 'completed'
    AND source_id NOT IN (SELECT source_id FROM fx_profile)""")
def sources_without_profile(t):
    return r.sources_without_profile(t.fx_source, t.fx_profile).select("source_id", "url")


@query("extractions_sorted", """SELECT source_id, field_group, internal_name, validated_result FROM fx_extraction JOIN fx_prompt USING (prompt_id)""")
def extractions_sorted(t):
    return r.extractions_sorted(t.fx_extraction, t.fx_prompt).select("source_id", "field_group", "internal_name", "validated_result")


@query("duplicate_keys", """SELECT l_orderkey AS source_id, l_linenumber AS prompt_id, count(*) AS copies FROM lineitem
    GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("prompt_id"))
    return r.duplicate_keys(rows, ["source_id", "prompt_id"])


@query("dangling_links", """SELECT event_id, user_id AS entity_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def dangling_links(t):
    rows = t.events.select("event_id", F.col("user_id").alias("entity_id"))
    return r.dangling(rows, "entity_id", t.fx_entity, "entity_id").select("event_id", "entity_id")


@query("outside_enum", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def outside_enum(t):
    return r.outside_enum(t.events, "event_type", ["view", "click", "purchase"]).select("event_id", "event_type")


@query("observed_violations", """SELECT count(*) AS "rows", count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS outside_enum,
    count(*) FILTER (user_id NOT IN (SELECT s_suppkey FROM supplier)) AS dangling, count(*) FILTER (value < 10) AS low FROM events""")
def observed_violations(t):
    """Violations counted by the pass that writes the rows."""
    rows = r.with_dangling(t.events, "user_id", t.fx_entity, "entity_id", "_dangling")
    outside = ~F.col("event_type").isin("view", "click", "purchase")
    return write_observed(rows, f"{work_folder(t.spark)}/events", outside_enum=outside, dangling=F.col("_dangling"), low=F.col("value") < 10)
