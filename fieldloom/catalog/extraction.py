"""Extraction and translation queries."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.functions import answers
from fieldloom.operators import extraction as x, records as r

# Dependencies of the seven record fields.
_EDGES = """SELECT CAST(prompt_id AS BIGINT) AS prompt_id, CAST(depends_on AS BIGINT) AS depends_on, context_key, is_required FROM (VALUES
    (2, 1, 'project', true), (3, 1, 'project', true), (3, 2, 'institution', true), (4, 3, 'summary', false), (5, 2, 'institution', false), (6, 3, 'summary', true))
    AS d(prompt_id, depends_on, context_key, is_required)"""


def _map_text(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


_CONTEXT = f"""SELECT j.source_id, j.prompt_id, coalesce(string_agg(d.context_key || '=' || v.validated_result, ';' ORDER BY d.context_key), '') AS context,
    coalesce(string_agg(CASE WHEN v.source_id IS NULL AND d.is_required THEN d.context_key END, ';' ORDER BY d.context_key), '') AS missing
    FROM fx_extraction j LEFT JOIN ({_EDGES}) d ON d.prompt_id = j.prompt_id
    LEFT JOIN (SELECT source_id, prompt_id, validated_result FROM fx_extraction WHERE validated_result <> '') v ON v.source_id = j.source_id AND v.prompt_id = d.depends_on
    GROUP BY j.source_id, j.prompt_id"""


def _context(t):
    jobs = t.fx_extraction.select("source_id", "prompt_id")
    return x.dependency_context(jobs, t.sql(_EDGES), t.fx_extraction)


@query("dependency_context", _CONTEXT)
def dependency_context(t):
    return _context(t).select("source_id", "prompt_id", _map_text("context").alias("context"), F.array_join("missing", ";").alias("missing"))


@query("dependency_waves", """SELECT d.set_id, d.prompt_id, coalesce(l.wave, coalesce(m.last, 0) + 1) AS wave FROM cfg_dependency d
    LEFT JOIN lev l ON l.prompt_id = d.prompt_id LEFT JOIN (SELECT set_id, max(wave) AS last FROM lev GROUP BY set_id) m ON m.set_id = d.set_id""",
    """lev AS (SELECT set_id, prompt_id, 1 AS wave FROM cfg_dependency WHERE depends_on IS NULL
       UNION ALL SELECT c.set_id, c.prompt_id, lev.wave + 1 FROM cfg_dependency c JOIN lev ON c.depends_on = lev.prompt_id)""")
def dependency_waves(t):
    edges = t.cfg_dependency.where("depends_on IS NOT NULL")
    return x.dependency_waves(t.cfg_dependency.select("set_id", "prompt_id"), edges)


@query("injected_prompts", f"""SELECT source_id, prompt_id, replace(replace(extract_prompt, '{{institution}}', coalesce(i, '{{institution}}')), '{{project}}', coalesce(j, '{{project}}')) AS prompt
    FROM (SELECT e.source_id, e.prompt_id, max(CASE WHEN d.context_key = 'institution' THEN v.validated_result END) AS i,
        max(CASE WHEN d.context_key = 'project' THEN v.validated_result END) AS j FROM fx_extraction e LEFT JOIN ({_EDGES}) d ON d.prompt_id = e.prompt_id
        LEFT JOIN fx_extraction v ON v.source_id = e.source_id AND v.prompt_id = d.depends_on AND v.validated_result <> '' GROUP BY ALL) JOIN fx_prompt USING (prompt_id)""")
def injected_prompts(t):
    rows = _context(t).join(t.fx_prompt.select("prompt_id", "extract_prompt"), "prompt_id")
    return rows.select("source_id", "prompt_id", x.inject_context(F.col("extract_prompt"), F.col("context")).alias("prompt"))


@query("validation_prompts", """SELECT extraction_id, CASE extraction_id % 4 WHEN 0 THEN 'Check ' || raw_result || ' and {x}' WHEN 3 THEN 'No mark' END AS validate_text,
    CASE extraction_id % 4 WHEN 1 THEN 'Prompt format error: ''other''' WHEN 2 THEN 'Prompt format error: single brace' END AS format_error FROM fx_extraction""")
def validation_prompts(t):
    braces = F.when(F.col("extraction_id") % 4 == 0, "Check {raw_result} and {{x}}").when(F.col("extraction_id") % 4 == 1, "Check {other}: {raw_result}").when(
        F.col("extraction_id") % 4 == 2, "Open { brace").otherwise("No mark")
    rows = t.fx_extraction.select("extraction_id", "raw_result", braces.alias("validate_prompt"), F.create_map().cast("map<string,string>").alias("context"))
    return x.format_validation(rows).select("extraction_id", "validate_text", "format_error")


@query("composed_messages", """SELECT doc_id, CASE WHEN trim(ctx) <> '' THEN 'Kontext:' || chr(10) || substr(ctx, 1, 200000) || chr(10) || chr(10) || 'Aufgabe:' || chr(10) || substr(text, 1, 10000)
    ELSE substr(text, 1, 10000) END AS message, greatest(0.0, least(2.0, coalesce(temp, 0.3))) AS temperature
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END AS ctx, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 7 - 2 AS DOUBLE) END AS temp FROM documents)""")
def composed_messages(t):
    ctx = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text"))
    temp = F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 7 - 2).cast("double"))
    return t.documents.select("doc_id", x.compose_message(F.col("text"), ctx).alias("message"), x.clamp_temperature(temp).alias("temperature"))


_RESPONSE = """SELECT event_id, CASE event_id % 10 WHEN 0 THEN '{"choices":[],"model":"m"}' WHEN 1 THEN '{"choices":[{"finish_reason":"stop"}],"model":"m"}'
    WHEN 2 THEN '{"choices":[{"message":{"role":"a"},"finish_reason":"stop"}],"model":"m"}' WHEN 3 THEN '{"choices":[{"message":{"content":null},"finish_reason":"length"}],"model":"m"}'
    WHEN 4 THEN '{"choices":[{"message":{"content":" ab "},"finish_reason":"stop"}],"model":"m","usage":{"total_tokens":5}}'
    WHEN 5 THEN '{"model":"m"}'
    WHEN 6 THEN '{"choices":[{"message":{"content":"filtered out"},"finish_reason":"content_filter"}],"model":"n","usage":{"total_tokens":' || CAST(user_id AS STRING) || '}}'
    WHEN 7 THEN '{"choices":[{"message":{"content":"with logs"},"finish_reason":"stop","logprobs":{"token_logprobs":[-' || CAST(value AS STRING) || ',-1.0,-0.5]}}],"model":"n"}'
    ELSE '{"choices":[{"message":{"content":"' || event_type || ' result"},"finish_reason":"tool"}],"model":"n"}' END AS response FROM <events>"""


def _responses(t):
    t.events.createOrReplaceTempView("fieldloom_events")
    return t.spark.sql(_RESPONSE.replace("<events>", "fieldloom_events"))


@query("response_scan", f"""SELECT event_id, error, model, tokens, CASE WHEN error IS NULL THEN content END AS content, CASE WHEN error IS NULL THEN
      round_even(CASE WHEN length(content) > 0 AND length(trim(content)) < 5 THEN least(base, 0.5) ELSE base END, 2) END AS confidence FROM (
    SELECT *, CASE WHEN len(logs) > 0 THEN greatest(0.5, least(1.0, (list_sum(logs) / len(logs) + 10) / 10)) WHEN reason = 'stop' OR reason IS NULL THEN 0.8
      WHEN reason = 'length' THEN 0.6 WHEN reason = 'content_filter' THEN 0.3 ELSE 0.5 END AS base FROM (
    SELECT event_id, coalesce(json_extract_string(response, '$.choices[0].message.content'), '') AS content, json_extract_string(response, '$.choices[0].finish_reason') AS reason,
      CAST(json_extract(response, '$.choices[0].logprobs.token_logprobs') AS DOUBLE[]) AS logs, json_extract_string(response, '$.model') AS model,
      CAST(json_extract(response, '$.usage.total_tokens') AS BIGINT) AS tokens,
      CASE WHEN coalesce(json_array_length(response, '$.choices'), 0) = 0 THEN 'no choices' WHEN json_extract(response, '$.choices[0].message') IS NULL THEN 'no message'
           WHEN json_extract(response, '$.choices[0].message.content') IS NULL THEN 'no content' END AS error FROM ({_RESPONSE.replace('<events>', 'events')})))""")
def response_scan(t):
    return x.read_responses(_responses(t))


_ANSWER = """CASE WHEN turn % 3 = 2 THEN text ELSE 'Quality: high' || chr(10) || 'SCORE: ' || CAST(turn * CAST(0.4 AS DOUBLE) AS VARCHAR) || chr(10) || 'NOTES: -' || chr(10)
    || 'RESULT:' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') END"""
_LAST = "list_filter(parts, lambda p: starts_with(lower(p), '{0}' || chr(2)))[-1]"
_LINE = f"trim(split_part(split_part({_LAST}, chr(2), 2), chr(10), 1))"


@query("parsed_validations", f"""SELECT conv_id, turn, CASE WHEN a IS NULL OR a = '' THEN 'MEDIUM' ELSE coalesce(upper({_LINE.format("quality")}), 'MEDIUM') END AS quality,
    CASE WHEN a IS NULL OR a = '' THEN 0.5 WHEN {_LINE.format("score")} IS NULL THEN 0.6 ELSE coalesce(greatest(0.0, least(1.0, TRY_CAST({_LINE.format("score")} AS DOUBLE))), 0.5) END::DOUBLE AS score,
    CASE WHEN a IS NULL OR a = '' THEN 'Empty validation response' ELSE coalesce({_LINE.format("notes")}, '') END AS notes,
    coalesce(list_filter(list_transform(list_filter(parts, lambda p: starts_with(lower(p), 'result' || chr(2))), lambda p: trim(split_part(p, chr(2), 2), ' ' || chr(10))), lambda v: v <> '')[-1], '') AS result
    FROM (SELECT *, string_split(regexp_replace(array_to_string(list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)),
      '(?im)^(quality|score|notes|result)\\s*:[ ]*', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations))""")
def parsed_validations(t):
    made = F.concat(F.lit("Quality: high\nSCORE: "), (F.col("turn") * 0.4).cast("string"), F.lit("\nNOTES: -\nRESULT:\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    answer = F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(made)
    return t.conversations.select("conv_id", "turn", answers.parse_validation(answer).alias("v")).select("conv_id", "turn", "v.*")


_STAGES = """SELECT extraction_id, CASE WHEN extraction_id % 7 = 0 THEN '' ELSE raw_result END AS raw_result, raw_confidence,
    CASE WHEN extraction_id % 11 = 0 THEN 'timeout' END AS extract_error, CASE WHEN extraction_id % 13 = 0 THEN 'Prompt format error: x' END AS format_error,
    validation_quality AS quality, validation_score AS score, 'ok' AS notes, validated_result AS result, CASE WHEN extraction_id % 17 = 0 THEN 'refused' END AS validate_error FROM {fx_extraction}"""


@query("extraction_outcomes", f"""SELECT extraction_id, CASE WHEN extract_error IS NULL AND raw_result <> '' THEN raw_result END AS raw_result,
    CASE WHEN extract_error IS NULL THEN raw_confidence END AS raw_confidence, CASE WHEN error IS NULL THEN result END AS validated_result,
    CASE WHEN error IS NULL THEN quality ELSE 'INSUFFICIENT' END AS validation_quality, CASE WHEN error IS NULL THEN score ELSE 0.0 END AS validation_score,
    CASE WHEN error IS NULL THEN notes WHEN error = 'Empty extraction result' THEN 'Extract phase returned empty result' ELSE error END AS validation_notes,
    CASE WHEN error IS NULL THEN least(coalesce(raw_confidence, 0.0), coalesce(score, 0.0)) ELSE 0.0 END AS final_confidence, error FROM (
    SELECT *, CASE WHEN extract_error IS NOT NULL THEN extract_error WHEN coalesce(raw_result, '') = '' THEN 'Empty extraction result' ELSE coalesce(format_error, validate_error) END AS error
    FROM ({_STAGES.replace('{fx_extraction}', 'fx_extraction')}))""")
def extraction_outcomes(t):
    return x.extraction_outcome(t.sql(_STAGES))


@query("final_confidence", "SELECT source_id, prompt_id, least(coalesce(raw_confidence, 0), coalesce(validation_score, 0)) AS final_confidence FROM fx_extraction")
def final_confidence(t):
    return t.fx_extraction.select("source_id", "prompt_id", answers.final_confidence(F.col("raw_confidence"), F.col("validation_score")).alias("final_confidence"))


@query("run_extraction")
def run_extraction(t):
    jobs = r.fan_out_extract(t.fx_source.where("status = 'crawled'"), t.fx_category_prompt, t.fx_prompt)
    jobs = x.dependency_context(jobs, t.sql(_EDGES), t.fx_extraction)
    texts = t.fx_source.select("source_id", F.col("markdown_content").alias("markdown"))
    fields = t.fx_prompt.select("prompt_id", "extract_prompt", F.replace("validate_prompt", F.lit(" ({institution})"), F.lit("")).alias("validate_prompt"))
    return x.run_extraction(jobs.drop("missing").join(fields, "prompt_id"), texts=texts)


_TO_TRANSLATE = f"""SELECT e.extraction_id, p.display_name, coalesce(c.display_name_en, c.display_name) AS category, p.translation_context, e.validated_result
    FROM fx_extraction e JOIN fx_prompt p USING (prompt_id) JOIN fx_source s ON s.source_id = e.source_id LEFT JOIN fx_category c ON c.category_id = s.category_id
    WHERE e.validated_result <> '' AND p.translatable"""
_PROMPT_SQL = x.TRANSLATION_PROMPT.replace("'", "''").replace("{source_language}", "German").replace("{target_language}", "English").replace(
    "{field_name}", "' || display_name || '").replace("{category}", "' || coalesce(category, 'AI initiative') || '").replace(
    "{field_context}", "' || CASE WHEN trim(coalesce(translation_context, '')) <> '' THEN 'The \"' || display_name || '\" field means: ' || trim(translation_context) || chr(10) ELSE '' END || '").replace(
    "{text}", "' || validated_result || '")


@query("translation_prompts", f"SELECT extraction_id, '{_PROMPT_SQL}' AS prompt, length(validated_result) * 2 AS max_tokens, NULL::VARCHAR AS error FROM ({_TO_TRANSLATE})")
def translation_prompts(t):
    rows = r.pending_translation_batch(t.fx_extraction, t.fx_prompt, force=True).join(t.fx_prompt.select("prompt_id", "display_name", "translation_context"), "prompt_id")
    rows = rows.join(t.fx_source.select("source_id", "category_id"), "source_id").join(
        t.fx_category.select("category_id", F.coalesce("display_name_en", "display_name").alias("category")), "category_id", "left")
    return x.translation_prompts(rows, "en").withColumn("max_tokens", F.col("max_tokens").cast("long"))


_ANSWERED = """SELECT extraction_id, CASE extraction_id % 5 WHEN 0 THEN ' ab ' WHEN 1 THEN NULL WHEN 2 THEN ' ' || coalesce(validated_result, '') || ' in English, and much longer than it was ' || chr(10)
    ELSE 'en ' || coalesce(validated_result, '') END AS answer FROM {fx_extraction} WHERE extraction_id % 3 <> 0"""
_APPLIED = f"""SELECT extraction_id, outcome, CASE WHEN outcome = 'translated' THEN text ELSE validated_result_en END AS validated_result_en,
    coalesce(outcome, translation_status) AS translation_status, CASE WHEN outcome = 'translated' THEN TIMESTAMP '2024-06-01 00:00:00' END AS translated_at FROM (
    SELECT *, CASE WHEN NOT (coalesce(validated_result, '') <> '' AND (translation_status = 'pending' OR translation_status IS NULL)) THEN NULL
      WHEN NOT translatable THEN 'skipped' WHEN length(text) >= 3 THEN 'translated' ELSE 'failed' END AS outcome FROM (
    SELECT e.*, p.translatable, trim(coalesce(a.answer, ''), ' ' || chr(10)) AS text FROM fx_extraction e JOIN fx_prompt p USING (prompt_id)
    LEFT JOIN ({_ANSWERED.replace('{fx_extraction}', 'fx_extraction')}) a ON a.extraction_id = e.extraction_id))"""


def _apply(t):
    rows = t.fx_extraction.withColumn("translated_at", F.lit(None).cast("timestamp_ntz"))
    return x.apply_translations(rows, t.fx_prompt, t.sql(_ANSWERED), F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))


@query("applied_translations", _APPLIED)
def applied_translations(t):
    return _apply(t).select("extraction_id", "outcome", "validated_result_en", "translation_status", "translated_at")


@query("translation_run_stats", f"""SELECT count(outcome) AS total, count(*) FILTER (outcome = 'translated') AS translated,
    count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM ({_APPLIED})""")
def translation_run_stats(t):
    return x.translation_run_stats(_apply(t))


@query("accepted_translations", f"""SELECT extraction_id, CASE WHEN n >= 3 THEN text END AS text, CASE WHEN n >= 3 THEN 'translated' ELSE 'failed' END AS state,
    n >= 3 AND (n / length(original) < 0.3 OR n / length(original) > 3.0) AS suspicious FROM (
    SELECT extraction_id, trim(coalesce(answer, ''), ' ' || chr(10)) AS text, length(trim(coalesce(answer, ''), ' ' || chr(10))) AS n, coalesce(nullif(validated_result, ''), 'x') AS original
    FROM ({_ANSWERED.replace('{fx_extraction}', 'fx_extraction')}) JOIN fx_extraction USING (extraction_id))""")
def accepted_translations(t):
    rows = t.sql(_ANSWERED).join(t.fx_extraction.selectExpr("extraction_id", "coalesce(nullif(validated_result, ''), 'x') AS original"), "extraction_id")
    return rows.select("extraction_id", answers.accept_translation(F.col("answer"), F.col("original")).alias("a")).select("extraction_id", "a.*")
