"""Linking extracted names to the entity inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions import answers, text as tx
from fieldloom.functions.similarity import name_key
from fieldloom.operators.statistics import n_rows
from fieldloom.plans.blocks import closest_names
from fieldloom.plans.order import attach_row

# Words that mark an institution field when no field has a type.
INSTITUTION_WORDS = ["institution", "hochschule", "university", "universitaet"]
# German name of an entity type in the prompt.
TYPE_NAMES = {"university": "Hochschule/Universität", "location": "Ort"}


def name_index(entities: DataFrame, variants: DataFrame) -> DataFrame:
    """One entity per type and key: smallest id first, canonical before variant."""
    own = entities.select("entity_type", "entity_id", F.col("canonical_name").alias("name"), F.lit(0).alias("is_variant"))
    other = variants.join(entities.select("entity_id", "entity_type"), "entity_id").select(
        "entity_type", "entity_id", F.col("variant_name").alias("name"), F.lit(1).alias("is_variant"))
    keyed = own.unionByName(other).withColumn("key", name_key(F.col("name"))).where("key <> ''")
    first = keyed.groupBy("entity_type", "key").agg(F.min(F.struct("entity_id", "is_variant")).alias("_hit"))
    hit = first.select("entity_type", "key", F.col("_hit.entity_id").alias("entity_id"), (F.col("_hit.is_variant") == 1).alias("by_variant"))
    return hit.join(entities.select("entity_id", "canonical_name"), "entity_id")


def exact_entity_match(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """``mentions`` (text, entity_type) with the equal entity, if any.

    The index has one row per key, so a plain left join keeps the row count; a small
    index is broadcast, a large one is joined with skewed keys split.
    """
    out = mentions.withColumn("key", name_key(F.col("text"))).join(index, ["entity_type", "key"], "left")
    return out.select(
        *mentions.columns, "entity_id", "canonical_name", F.when(F.col("entity_id").isNotNull(), 1.0).alias("confidence"),
        F.when(F.col("entity_id").isNotNull(), "auto_link").alias("action"),
    )


def link_prompts(prompts: DataFrame, entity_type: str) -> DataFrame:
    """Fields of the type; when there is none, fields named like an institution."""
    typed = F.coalesce(F.col("entity_type") == entity_type, F.lit(False))
    some = prompts.agg(F.coalesce(F.bool_or(typed), F.lit(False)).alias("_some"))
    named = F.lower("internal_name").rlike("|".join(INSTITUTION_WORDS))
    return attach_row(prompts, some).where(F.when(F.col("_some"), typed).otherwise(named)).select("prompt_id")


def auto_link_batch(extractions, prompts, entities, variants, entity_type: str, use_raw: bool = True) -> DataFrame:
    """Outcome of exact linking per extraction: linked, already_linked, no_match, empty_value."""
    text = tx.filled(F.col("validated_result"))
    if use_raw:
        text = F.coalesce(text, tx.filled(F.col("raw_result")))
    rows = extractions.join(link_prompts(prompts, entity_type), "prompt_id", "left_semi")
    rows = rows.select("extraction_id", "source_id", "linked_entity_id", tx.strip(text).alias("text"), F.lit(entity_type).alias("entity_type"))
    matched = exact_entity_match(rows, name_index(entities, variants))
    outcome = (
        F.when(F.col("linked_entity_id").isNotNull(), "already_linked")
        .when(~tx.not_blank(F.col("text")), "empty_value")
        .when(F.col("entity_id").isNotNull(), "linked")
        .otherwise("no_match")
    )
    return matched.withColumn("outcome", outcome).withColumn(
        "entity_id", F.when(F.col("outcome") == "linked", F.col("entity_id")).otherwise(F.col("linked_entity_id")))


def auto_link_stats(outcomes: DataFrame, entities: DataFrame, variants: DataFrame, entity_type: str) -> DataFrame:
    counts = outcomes.groupBy(F.col("outcome").alias("metric")).agg(n_rows("value"))
    typed = entities.where(F.col("entity_type") == entity_type)
    total = typed.agg(n_rows("value")).select(F.lit("entities_available").alias("metric"), "value")
    keys = name_index(typed, variants.join(typed.select("entity_id"), "entity_id", "left_semi"))
    # Both counts are single rows; subtraction by union keeps the plan free of joins.
    spare = keys.agg(n_rows("value")).unionByName(typed.agg((-F.count(F.lit(1))).alias("value")))
    spare = spare.agg(F.sum("value").alias("value")).select(F.lit("variants_available").alias("metric"), "value")
    return counts.unionByName(total).unionByName(spare)


def unmatched_mentions(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """``mentions`` (text, entity_type) that no entity of the type equals; only these need candidates."""
    return mentions.withColumn("key", name_key(F.col("text"))).join(index, ["entity_type", "key"], "left_anti").select(*mentions.columns)


def entity_candidates(mentions: DataFrame, entities: DataFrame, variants: DataFrame, k: int = 50, **blocks) -> DataFrame:
    """(text, entity_id, score, rank): the closest entities to offer for a mention.

    Mentions with an ``entity_type`` see entities of that type, others see all.  An
    inventory of at most ``k`` entities is offered whole, in id order.
    """
    typed = "entity_type" in mentions.columns and "entity_type" in entities.columns
    kind = F.coalesce(F.col("entity_type"), F.lit("")) if typed else F.lit("")
    known = entities.select(kind.alias("entity_type"), "entity_id", "canonical_name")
    names = known.select("entity_type", "entity_id", name_key(F.coalesce("canonical_name", F.lit(""))).alias("name")).unionByName(
        variants.join(known, "entity_id").select("entity_type", "entity_id", name_key(F.col("variant_name")).alias("name")))
    keyed = mentions.select("text", kind.alias("entity_type"), name_key(F.col("text")).alias("needle")).distinct()
    found = closest_names(keyed.select("entity_type", "needle").distinct(), names, k, **blocks)
    small = known.groupBy("entity_type").agg((F.count(F.lit(1)) <= k).alias("_whole"))
    offered = F.when(F.col("_whole"), F.sort_array("closest")).otherwise(F.col("closest"))
    best = found.join(small, "entity_type").select("entity_type", "needle", offered.alias("_best"))
    ranked = keyed.join(best, ["entity_type", "needle"]).select("text", F.posexplode("_best").alias("_place", "_hit"))
    return ranked.select("text", "_hit.entity_id", "_hit.score", (F.col("_place") + 1).alias("rank"))


def resolve_model_name(answers_df: DataFrame, index: DataFrame) -> DataFrame:
    """Answer rows (name, entity_type) with the entity the name stands for."""
    keyed = answers_df.withColumn("key", name_key(F.col("name")))
    return keyed.join(index, ["entity_type", "key"], "left").drop("key", "by_variant")


def normalization_decision(answers_df: DataFrame, index: DataFrame) -> DataFrame:
    """Parsed answers with entity, canonical name, confidence, action and review flag.

    ``answers_df``: mention_id, entity_type, answer.  A NULL answer stands for an
    empty inventory and goes to review with confidence 0.
    """
    parsed = answers.parse_normalization(answers_df.select("mention_id", "entity_type", "answer"))
    resolved = resolve_model_name(parsed, index)
    action = F.when(F.col("answer").isNull(), "review_queue").otherwise(
        answers.normalization_action(F.col("match_type"), F.col("confidence")))
    kept = F.col("action") != "ignore"
    return resolved.withColumn("action", action).select(
        "mention_id", F.when(kept, F.col("entity_id")).alias("entity_id"), F.when(kept, F.col("name")).alias("canonical_name"),
        "confidence", "action", (F.col("action") == "review_queue").alias("needs_review"))


def new_reviews(decisions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Review rows for decisions that need a person."""
    rows = decisions.where("needs_review").join(mentions.select("mention_id", "text", "entity_type"), "mention_id")
    return rows.select(
        F.col("mention_id").alias("extraction_id"), F.col("text").alias("raw_text"), "entity_type",
        F.col("entity_id").alias("suggestion_id"), "confidence", F.lit("pending").alias("status"))


def _type_name(entity_type: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, name in TYPE_NAMES.items():
        out = out.when(entity_type == key, F.lit(name))
    return out.otherwise(entity_type)


# Fixed value: closing lines of the matching prompt.
_PROMPT_END = """
Antwortformat:
MATCH: [Offizieller Name] (Confidence: 0.9-1.0)
LIKELY: [Wahrscheinlicher Name] (Confidence: 0.6-0.89)
NO_MATCH (Confidence: 0.0-0.59)

Beispiel:
Text: "TU Berlin"
MATCH: Technische Universität Berlin (Confidence: 0.95)
"""


# Fixed value: stands for the candidates where there are none.
_NO_CANDIDATES = "Keine bekannten Entitäten"


def normalization_prompts(
    candidates: DataFrame, entities: DataFrame, variants: DataFrame, entity_type: str, context: Column | None = None, mentions: DataFrame | None = None,
) -> DataFrame:
    """One matching prompt per mention from its ranked candidates.

    ``candidates``: text, entity_id, rank (at most k rows per mention).  ``mentions``
    (text) without candidates, or whose candidates have no name, get a prompt that says so;
    by default the mentions are those with candidates.
    """
    # Three names of an entity are shown; more are not gathered.
    first = Window.partitionBy("entity_id").orderBy("variant_name")
    some = variants.select("entity_id", "variant_name").distinct().withColumn("_n", F.row_number().over(first)).where("_n <= 3")
    short = some.groupBy("entity_id").agg(F.array_sort(F.collect_list("variant_name")).alias("_v"))
    lines = candidates.join(entities.select("entity_id", "canonical_name"), "entity_id").join(short, "entity_id", "left")
    also = F.when(F.size("_v") > 0, F.concat(F.lit(" (auch: "), F.array_join(F.slice("_v", 1, 3), ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("canonical_name"), also)
    grouped = lines.where("canonical_name <> ''").groupBy("text").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n").alias("_list"))
    asked = (candidates if mentions is None else mentions).select("text").distinct()
    grouped = asked.join(grouped, "text", "left").fillna(_NO_CANDIDATES, ["_list"])
    kind = _type_name(F.lit(entity_type))
    head = F.concat(
        F.lit('Text erwähnt: "'), F.col("text"), F.lit('"\n\nBekannte '), kind, F.lit("en:\n"), F.col("_list"),
        F.lit("\n\nIst der Text eine dieser Entitäten?\n\n"))
    ctx = F.lit("")
    if context is not None:
        preview = F.when(F.length(context) > 500, F.concat(F.substring(context, 1, 500), F.lit("..."))).otherwise(context)
        ctx = F.when(tx.not_blank(context), F.concat(F.lit("\nKontext: "), preview, F.lit("\n"))).otherwise("")
    return grouped.select("text", F.concat(head, ctx, F.lit(_PROMPT_END)).alias("prompt"))
