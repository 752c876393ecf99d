"""Entity linking queries."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.functions import answers
from fieldloom.functions.similarity import native_similarity
from fieldloom.operators import entities as e
from fieldloom.plans.blocks import top_k
from fieldloom.plans.order import cut_lineage

_INDEX = """idx AS (SELECT entity_type, key, arg_min(entity_id, entity_id * 2 + v) AS entity_id FROM (
    SELECT entity_type, entity_id, lower(trim(canonical_name)) AS key, 0 AS v FROM fx_entity
    UNION ALL SELECT entity_type, entity_id, lower(trim(variant_name)), 1 FROM fx_variant JOIN fx_entity USING (entity_id)) GROUP BY ALL)"""
_MENTIONS = """SELECT extraction_id, source_id, linked_entity_id, trim(coalesce(nullif(validated_result, ''), nullif(raw_result, ''))) AS text
    FROM fx_extraction WHERE prompt_id = 2"""


@query("exact_entity_match", f"""SELECT m.extraction_id, m.text, i.entity_id, x.canonical_name, CASE WHEN i.entity_id IS NOT NULL THEN 1.0::DOUBLE END AS confidence,
    CASE WHEN i.entity_id IS NOT NULL THEN 'auto_link' END AS action FROM ({_MENTIONS}) m
    LEFT JOIN idx i ON i.entity_type = 'university' AND i.key = lower(trim(m.text)) LEFT JOIN fx_entity x ON x.entity_id = i.entity_id""", _INDEX)
def exact_entity_match(t):
    rows = t.fx_extraction.where("prompt_id = 2").selectExpr(
        "extraction_id", "trim(coalesce(nullif(validated_result, ''), nullif(raw_result, ''))) AS text", "'university' AS entity_type")
    return e.exact_entity_match(rows, e.name_index(t.fx_entity, t.fx_variant)).drop("entity_type")


_OUTCOMES = f"""SELECT m.extraction_id, CASE WHEN m.linked_entity_id IS NOT NULL THEN 'already_linked' WHEN coalesce(m.text, '') = '' THEN 'empty_value'
    WHEN i.entity_id IS NOT NULL THEN 'linked' ELSE 'no_match' END AS outcome, CASE WHEN m.linked_entity_id IS NOT NULL THEN m.linked_entity_id ELSE i.entity_id END AS entity_id
    FROM ({_MENTIONS}) m LEFT JOIN idx i ON i.entity_type = 'university' AND i.key = lower(m.text)"""


@query("auto_link_batch", _OUTCOMES, _INDEX)
def auto_link_batch(t):
    return e.auto_link_batch(t.fx_extraction, t.fx_prompt, t.fx_entity, t.fx_variant, "university").select("extraction_id", "outcome", "entity_id")


@query("auto_link_stats", f"""SELECT outcome AS metric, count(*) AS value FROM ({_OUTCOMES}) GROUP BY 1
    UNION ALL SELECT 'entities_available', count(*) FROM fx_entity WHERE entity_type = 'university'
    UNION ALL SELECT 'variants_available', (SELECT count(*) FROM idx WHERE entity_type = 'university') - (SELECT count(*) FROM fx_entity WHERE entity_type = 'university')""", _INDEX)
def auto_link_stats(t):
    outcomes = e.auto_link_batch(t.fx_extraction, t.fx_prompt, t.fx_entity, t.fx_variant, "university")
    return e.auto_link_stats(outcomes, t.fx_entity, t.fx_variant, "university")


_SPELLED = """SELECT CASE c_custkey % 4 WHEN 0 THEN 'Inst. ' || n_name WHEN 1 THEN lower(n_name) || ' institut ' || CAST(c_custkey % 1000 AS STRING)
    WHEN 2 THEN n_name || ' Instiute' ELSE 'Office ' || CAST(c_custkey AS STRING) || ' ' || n_name END AS text FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
_NAMED = """SELECT s_suppkey AS entity_id, n_name || ' Institute ' || CAST(s_suppkey AS STRING) AS canonical_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


def _candidates(t):
    """Candidates of one type for the mentions that no name equals."""
    named = t.sql(_NAMED).withColumn("entity_type", F.lit("university"))
    spelled = t.sql(_SPELLED).withColumn("entity_type", F.lit("university"))
    return e.entity_candidates(e.unmatched_mentions(spelled, e.name_index(named, t.fx_variant)), named, t.fx_variant)


@query("entity_candidates")
def entity_candidates(t):
    return _candidates(t)


_UNMATCHED = """SELECT extraction_id, trim(coalesce(nullif(validated_result, ''), nullif(raw_result, ''))) AS text, 'university' AS entity_type FROM {fx_extraction} WHERE prompt_id = 2"""


@query("unmatched_mentions", f"""SELECT m.* FROM ({_UNMATCHED.replace('{fx_extraction}', 'fx_extraction')}) m
    WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.entity_type = m.entity_type AND i.key = lower(trim(m.text)))""", _INDEX)
def unmatched_mentions(t):
    return e.unmatched_mentions(t.sql(_UNMATCHED), e.name_index(t.fx_entity, t.fx_variant))


@query("top_k_candidates", """SELECT mention, entity_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity_id) AS rank
    FROM (SELECT l_partkey % 50 AS mention, l_suppkey AS entity_id, max(l_discount) AS score FROM lineitem GROUP BY ALL)) WHERE rank <= 50""")
def top_k_candidates(t):
    scores = t.lineitem.groupBy((F.col("l_partkey") % 50).alias("mention"), F.col("l_suppkey").alias("entity_id")).agg(F.max("l_discount").alias("score"))
    return top_k(scores, "mention", 50).withColumn("rank", F.col("rank").cast("long"))


_PAIRS = """SELECT p_partkey, p_name || ' ' || p_brand AS text, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_name
    WHEN 2 THEN upper(p_name || ' ' || p_brand) || ' ' ELSE p_type || ' ' || p_brand END AS name FROM {part}"""


@query("native_similarity", f"""SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN greatest(0.8, j) ELSE j END AS score FROM (
    SELECT *, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) * 0.7::DOUBLE AS j FROM (
      SELECT *, list_distinct(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+')) AS wa, list_distinct(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_]+')) AS wb
      FROM (SELECT p_partkey, lower(trim(text)) AS a, lower(trim(name)) AS b FROM ({_PAIRS.replace('{part}', 'part')}))))""")
def native_similarity_scores(t):
    return t.sql(_PAIRS).select("p_partkey", native_similarity(F.col("text"), F.col("name")).alias("score"))


_ANSWERS = """SELECT extraction_id AS mention_id, validated_result AS text, 'university' AS entity_type, CASE extraction_id % 9
    WHEN 0 THEN 'MATCH: ' || trim(validated_result) || ' (Confidence: 0.95)' WHEN 1 THEN 'match: ' || upper(trim(validated_result)) || ' (Confidence: .7)' || chr(10) || 'why'
    WHEN 2 THEN 'LIKELY: ' || validated_result || '(Confidence: 0.3)' WHEN 3 THEN 'NO_MATCH (Confidence: 0.2)' WHEN 4 THEN 'MATCH: ' || validated_result
    WHEN 5 THEN 'MATCH: ' || validated_result || ' (Confidence: high)' WHEN 6 THEN 'MATCH: A (Confidence: x) B (Confidence: 1.7)' WHEN 7 THEN '  ' || chr(10) || ' ' END AS answer
    FROM {fx_extraction} WHERE prompt_id = 2"""
_PARSED = f"""SELECT mention_id, answer, CASE WHEN line ILIKE 'match:%' THEN 'MATCH' WHEN line ILIKE 'likely:%' THEN 'LIKELY' ELSE 'NO_MATCH' END AS match_type,
    CASE WHEN line = '' OR line ILIKE 'no_match%' THEN NULL WHEN contains(rest, '(Confidence:') THEN nullif(trim(regexp_extract(rest, '^(.*)\\(Confidence:', 1)), '') ELSE nullif(rest, '') END AS name,
    CASE WHEN line = '' OR line ILIKE 'no_match%' THEN 0.0 WHEN contains(rest, '(Confidence:')
         THEN CASE WHEN figure IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, figure)) END ELSE 0.5 END AS confidence
    FROM (SELECT *, TRY_CAST(trim(replace(regexp_extract(rest, '^.*\\(Confidence:(.*)$', 1), ')', '')) AS DOUBLE) AS figure
    FROM (SELECT *, trim(regexp_replace(line, '^(MATCH|LIKELY):', '', 'i')) AS rest FROM (
      SELECT mention_id, answer, trim(split_part(trim(coalesce(answer, ''), ' ' || chr(10)), chr(10), 1)) AS line FROM ({_ANSWERS.replace('{fx_extraction}', 'fx_extraction')}))))"""


@query("parsed_normalization", f"SELECT mention_id, match_type, name, confidence FROM ({_PARSED})")
def parsed_normalization(t):
    return answers.parse_normalization(t.sql(_ANSWERS).select("mention_id", "answer")).drop("answer")


@query("normalization_decisions", f"""SELECT mention_id, confidence, action, action = 'review_queue' AS needs_review,
    CASE WHEN action <> 'ignore' THEN entity_id END AS entity_id, CASE WHEN action <> 'ignore' THEN name END AS canonical_name FROM (
    SELECT p.*, i.entity_id, CASE WHEN answer IS NULL THEN 'review_queue' WHEN match_type = 'MATCH' AND confidence >= 0.9 THEN 'auto_link'
      WHEN match_type = 'LIKELY' OR (match_type = 'MATCH' AND confidence >= 0.6) THEN 'review_queue' ELSE 'ignore' END AS action
    FROM ({_PARSED}) p LEFT JOIN idx i ON i.entity_type = 'university' AND i.key = lower(trim(p.name)))""", _INDEX)
def normalization_decisions(t):
    return e.normalization_decision(t.sql(_ANSWERS), e.name_index(t.fx_entity, t.fx_variant))


@query("new_reviews", f"""SELECT p.mention_id AS extraction_id, p.confidence, 'pending' AS status, i.entity_id AS suggestion_id, 'university' AS entity_type, m.text AS raw_text
    FROM ({_PARSED}) p JOIN ({_ANSWERS.replace('{fx_extraction}', 'fx_extraction')}) m USING (mention_id)
    LEFT JOIN idx i ON i.entity_type = 'university' AND i.key = lower(trim(p.name))
    WHERE p.answer IS NULL OR match_type = 'LIKELY' OR (match_type = 'MATCH' AND p.confidence >= 0.6 AND p.confidence < 0.9)""", _INDEX)
def new_reviews(t):
    mentions = t.sql(_ANSWERS)
    # Decisions are a stage result of their own; stored, filters on them stay cheap.
    decided = cut_lineage(e.normalization_decision(mentions, e.name_index(t.fx_entity, t.fx_variant)))
    return e.new_reviews(decided, mentions)


@query("normalization_prompts", """SELECT text, 'Text erwähnt: "' || text || '"' || chr(10) || chr(10) || 'Bekannte Hochschule/Universitäten:' || chr(10)
      || coalesce(string_agg('- ' || canonical_name || coalesce(' (auch: ' || names || ')', ''), chr(10) ORDER BY rank), 'Keine bekannten Entitäten') || chr(10) || chr(10)
      || 'Ist der Text eine dieser Entitäten?' || chr(10) || chr(10) || chr(10) || 'Kontext: ' || text || chr(10) || chr(10)
      || 'Antwortformat:' || chr(10) || 'MATCH: [Offizieller Name] (Confidence: 0.9-1.0)' || chr(10) || 'LIKELY: [Wahrscheinlicher Name] (Confidence: 0.6-0.89)' || chr(10)
      || 'NO_MATCH (Confidence: 0.0-0.59)' || chr(10) || chr(10) || 'Beispiel:' || chr(10) || 'Text: "TU Berlin"' || chr(10)
      || 'MATCH: Technische Universität Berlin (Confidence: 0.95)' || chr(10) AS prompt
    FROM (SELECT DISTINCT 'part ' || l_partkey AS text FROM lineitem UNION SELECT 'unknown ' || p_name FROM part)
    LEFT JOIN (SELECT 'part ' || l_partkey AS text, l_suppkey AS entity_id, row_number() OVER (PARTITION BY l_partkey ORDER BY max(l_discount) DESC, l_suppkey) AS rank
          FROM lineitem GROUP BY l_partkey, l_suppkey) USING (text) LEFT JOIN fx_entity USING (entity_id)
    LEFT JOIN (SELECT entity_id, string_agg(variant_name, ', ' ORDER BY variant_name) AS names FROM fx_variant GROUP BY entity_id) USING (entity_id)
    WHERE rank <= 50 OR rank IS NULL GROUP BY text""")
def normalization_prompts(t):
    scores = t.lineitem.groupBy(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), F.col("l_suppkey").alias("entity_id")).agg(F.max("l_discount").alias("score"))
    mentions = scores.select("text").unionByName(t.part.select(F.concat(F.lit("unknown "), F.col("p_name")).alias("text")))
    return e.normalization_prompts(top_k(scores, "text", 50), t.fx_entity, t.fx_variant, "university", F.col("text"), mentions)
