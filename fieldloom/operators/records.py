"""Selections and joins over sources, prompts, extractions and profiles.

No broadcast is forced: Spark broadcasts a side when its statistics stay below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where adaptive
execution splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions import text as tx

SOURCE_STATES = ["pending", "crawled", "extracting", "completed", "failed"]


def page(df: DataFrame, key: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One page of a listing in key order."""
    out = df.orderBy(key)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def list_sources(sources: DataFrame, status=None, category_id=None, offset: int = 0, limit: int | None = None) -> DataFrame:
    out = sources
    if status is not None:
        out = out.where(F.col("status") == status)
    if category_id is not None:
        out = out.where(F.col("category_id") == category_id)
    return page(out, "source_id", offset, limit)


def active_only(df: DataFrame) -> DataFrame:
    return df.where("is_active")


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key columns are asked for by ``keys``."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def entities_by_variant(entities: DataFrame, variants: DataFrame, names: DataFrame) -> DataFrame:
    wanted = names.select("variant_name").distinct()
    return variants.join(wanted, "variant_name").join(entities, "entity_id")


def has_value(column: str = "validated_result") -> Column:
    """Not NULL and not the empty string; spaces count as a value."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def record_join(extractions: DataFrame, prompts: DataFrame, sources: DataFrame, categories: DataFrame) -> DataFrame:
    """Extraction with its prompt, source and category."""
    p = prompts.select("prompt_id", F.col("internal_name").alias("field"), "field_group", "required_confidence", "translatable")
    s = sources.select("source_id", "url", "status", "category_id")
    c = categories.select("category_id", F.col("display_name").alias("category"))
    return extractions.join(p, "prompt_id").join(s, "source_id").join(c, "category_id")


def low_confidence(extractions: DataFrame, threshold: float = 0.7) -> DataFrame:
    return extractions.where(F.col("final_confidence") < threshold)


def below_required(extractions: DataFrame, prompts: DataFrame) -> DataFrame:
    need = prompts.select("prompt_id", "required_confidence")
    return extractions.join(need, "prompt_id").where("final_confidence < required_confidence")


def publishable_fields(extractions: DataFrame, prompts: DataFrame) -> DataFrame:
    need = prompts.select("prompt_id", "internal_name", "display_name", "required_confidence")
    joined = extractions.join(need, "prompt_id")
    return joined.where(tx.not_blank(F.col("validated_result")) & (F.col("final_confidence") >= F.col("required_confidence")))


def normalization_candidates(extractions: DataFrame, prompts: DataFrame, entity_type: str) -> DataFrame:
    typed = prompts.where(F.col("entity_type") == entity_type).select("prompt_id")
    return extractions.where("linked_entity_id IS NULL AND validated_result IS NOT NULL").join(typed, "prompt_id", "left_semi")


def review_items(reviews, extractions, sources, categories, prompts, entities, variants, status="pending", entity_type=None) -> DataFrame:
    """Open reviews with everything a reviewer needs to see."""
    picked = reviews.where(F.col("status") == status)
    if entity_type is not None:
        picked = picked.where(F.col("entity_type") == entity_type)
    names = variants.groupBy("entity_id").agg(F.array_sort(F.collect_list("variant_name")).alias("variants"))
    suggested = entities.select(F.col("entity_id").alias("suggestion_id"), F.col("canonical_name").alias("suggestion")).join(
        names.withColumnRenamed("entity_id", "suggestion_id"), "suggestion_id", "left"
    )
    return (
        picked.select("review_id", "extraction_id", "raw_text", "suggestion_id", "confidence")
        .join(extractions.select("extraction_id", "source_id", "prompt_id"), "extraction_id")
        .join(sources.select("source_id", "url", "category_id"), "source_id")
        .join(categories.select("category_id", F.col("display_name").alias("category")), "category_id", "left")
        .join(prompts.select("prompt_id", F.col("internal_name").alias("field")), "prompt_id")
        .join(suggested, "suggestion_id", "left")
    )


def _untranslated(with_missing_text: bool) -> Column:
    state = F.coalesce(F.col("translation_status") == "pending", F.lit(True))
    return state | F.col("validated_result_en").isNull() if with_missing_text else state


def pending_translation(extractions: DataFrame, force: bool = False) -> DataFrame:
    """Values of a source still to translate (prompt flags are looked at later)."""
    out = extractions.where(has_value())
    return out if force else out.where(_untranslated(False))


def pending_translation_batch(extractions: DataFrame, prompts: DataFrame, force: bool = False) -> DataFrame:
    out = extractions.where(has_value()).join(prompts.where("translatable").select("prompt_id"), "prompt_id", "left_semi")
    return out if force else out.where(_untranslated(True))


def sources_needing_translation(extractions: DataFrame, profiles: DataFrame, force: bool = False) -> DataFrame:
    if force:
        return profiles.select("source_id").distinct()
    missing = has_value() & (F.col("validated_result_en").isNull() | (F.col("validated_result_en") == ""))
    return extractions.where(missing).select("source_id").distinct()


def content_hash(markdown: Column) -> Column:
    return F.sha2(F.coalesce(markdown, F.lit("")), 256)


def translation_state(profiles: DataFrame, translations: DataFrame, language: str = "en") -> DataFrame:
    """pending, outdated or translated for each profile."""
    stored = translations.where(F.col("language") == language).select("profile_id", "source_hash", F.lit(True).alias("_has"))
    state = (
        F.when(F.col("_has").isNull(), "pending")
        .when(~F.col("source_hash").eqNullSafe(content_hash(F.col("markdown_content"))), "outdated")
        .otherwise("translated")
    )
    joined = profiles.join(stored, "profile_id", "left")
    return joined.select("profile_id", "source_id", "published", state.alias("translation_state"))


def profiles_needing_translation(profiles: DataFrame, translations: DataFrame, language: str = "en", force: bool = False) -> DataFrame:
    live = profiles.where("published")
    if force:
        return live.select("profile_id")
    return translation_state(live, translations, language).where("translation_state <> 'translated'").select("profile_id")


def translated_profiles(profiles: DataFrame, translations: DataFrame, language: str = "en") -> tuple[DataFrame, DataFrame]:
    """Profiles with a stored translation, and the number of skipped ones."""
    stored = translations.where(F.col("language") == language).select("profile_id", F.col("markdown_content").alias("translated_markdown"))
    kept = profiles.join(stored, "profile_id")
    skipped = profiles.join(stored, "profile_id", "left_anti").agg(F.count(F.lit(1)).alias("skipped"))
    return kept, skipped


def has_translation(extractions: DataFrame, prompts: DataFrame) -> DataFrame:
    ready = extractions.where(has_value("validated_result_en")).join(
        prompts.where("translatable").select("prompt_id"), "prompt_id", "left_semi"
    )
    return ready.select("source_id").distinct()


def stuck_extracting(sources: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """New state of sources silent in 'extracting' for too long."""
    limit = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    stuck = sources.where((F.col("status") == "extracting") & (F.col("updated_at") < limit))
    return stuck.withColumn("status", F.lit("failed")).withColumn("error_message", F.lit(f"no progress for {hours} h"))


def revalidation_candidates(extractions: DataFrame, only_missing: bool = True) -> DataFrame:
    out = extractions.where(has_value("raw_result"))
    return out.where("validated_result IS NULL OR validated_result = ''") if only_missing else out


def profiles_by_status(profiles: DataFrame, sources: DataFrame, published: bool | None = None, category_id=None) -> DataFrame:
    out = profiles if published is None else profiles.where(F.col("published") == published)
    joined = out.join(sources.select("source_id", "category_id"), "source_id")
    return joined if category_id is None else joined.where(F.col("category_id") == category_id)


def published_profile(profiles: DataFrame, sources: DataFrame) -> DataFrame:
    live = profiles.where("published")
    return live.join(sources.select("source_id", F.col("url").alias("source_url")), "source_id")


def source_markdown(sources: DataFrame) -> DataFrame:
    return sources.where(has_value("markdown_content")).select("source_id", "markdown_content")


def category_prompts_ordered(categories: DataFrame, mapping: DataFrame, prompts: DataFrame) -> DataFrame:
    named = categories.select("category_id", F.col("internal_name").alias("category"))
    fields = prompts.select("prompt_id", F.col("internal_name").alias("field"), "field_group", "is_active")
    return mapping.join(named, "category_id").join(fields, "prompt_id").orderBy("category_id", "display_order", "prompt_id")


def fan_out_extract(sources: DataFrame, mapping: DataFrame, prompts: DataFrame) -> DataFrame:
    """One extract job per source and active prompt of its category."""
    ready = sources.where(F.col("category_id").isNotNull() & has_value("markdown_content"))
    wanted = mapping.join(prompts.where("is_active").select("prompt_id"), "prompt_id", "left_semi").select("category_id", "prompt_id")
    return ready.select("source_id", "category_id").join(wanted, "category_id").select("source_id", "prompt_id")


def missing_prompts(sources, mapping, prompts, extractions) -> DataFrame:
    """Expected jobs of sources that have no extraction row yet."""
    done = extractions.select("source_id", "prompt_id")
    return fan_out_extract(sources, mapping, prompts).join(done, ["source_id", "prompt_id"], "left_anti")


def fully_extracted(sources, mapping, prompts, extractions) -> DataFrame:
    """Ready sources without a missing prompt."""
    ready = sources.where(F.col("category_id").isNotNull() & has_value("markdown_content")).select("source_id")
    open_ones = missing_prompts(sources, mapping, prompts, extractions).select("source_id").distinct()
    return ready.join(open_ones, "source_id", "left_anti")


def unassigned_prompts(mapping: DataFrame, prompts: DataFrame, category_id: int) -> DataFrame:
    taken = mapping.where(F.col("category_id") == category_id).select("prompt_id")
    return prompts.where("is_active").join(taken, "prompt_id", "left_anti")


def sources_without_profile(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    return sources.where("status = 'completed'").join(profiles.select("source_id"), "source_id", "left_anti")


def extractions_sorted(extractions: DataFrame, prompts: DataFrame, source_ids: DataFrame | None = None) -> DataFrame:
    named = extractions.join(prompts.select("prompt_id", "field_group", "internal_name"), "prompt_id")
    if source_ids is not None:
        named = named.join(source_ids, "source_id", "left_semi")
    return named.orderBy("source_id", "field_group", "internal_name")


# --- integrity ---------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    known = parent.select(F.col(parent_key).alias(key))
    return df.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def outside_enum(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def with_dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """All rows, ``name`` true where ``key`` is set and no parent has it; a condition to count while the rows are written."""
    known = parent.select(F.col(parent_key).alias("_parent")).where("_parent IS NOT NULL").distinct()
    joined = df.join(known, F.col(key) == F.col("_parent"), "left")
    return joined.withColumn(name, F.col(key).isNotNull() & F.col("_parent").isNull()).drop("_parent")
