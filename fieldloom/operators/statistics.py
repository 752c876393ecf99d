"""Counts and reports.  Child tables are pre-aggregated before any join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions import text as tx
from fieldloom.plans.order import attach_row
from fieldloom.operators.records import SOURCE_STATES, fan_out_extract, has_value, translation_state


def n_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def metrics(*frames: DataFrame) -> DataFrame:
    """One-row frames as (metric, value) rows, joined end to end."""
    parts = []
    for frame in frames:
        as_double = frame.select(*[F.col(c).cast("double").alias(c) for c in frame.columns])
        parts.append(as_double.unpivot([], as_double.columns, "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def count_by_status(sources: DataFrame) -> DataFrame:
    """Rows per state; states without a row count zero."""
    counts = sources.groupBy("status").agg(n_rows())
    states = sources.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SOURCE_STATES])).alias("status"))
    return states.join(counts, "status", "left").fillna(0, ["n"])


def count_by_category(sources: DataFrame, status: str | None = None) -> DataFrame:
    rows = sources if status is None else sources.where(F.col("status") == status)
    return rows.where("category_id IS NOT NULL").groupBy("category_id").agg(n_rows())


def count_since(sources: DataFrame, cutoff: Column, status: str | None = None) -> DataFrame:
    rows = sources if status is None else sources.where(F.col("status") == status)
    return rows.agg(F.count_if(F.col("created_at") >= cutoff).alias("n"))


def with_count(parents: DataFrame, key: str, children: DataFrame, name: str) -> DataFrame:
    """Parents with the number of their children, zero included."""
    counts = children.groupBy(key).agg(n_rows(name))
    return parents.join(counts, key, "left").fillna(0, [name])


def public_categories(categories: DataFrame, sources: DataFrame) -> DataFrame:
    return with_count(categories.where("is_active"), "category_id", sources.where("status = 'completed'"), "completed")


def public_statistics(categories: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Total and recent completed sources, and a map of counts by category name."""
    done = sources.where("status = 'completed'")
    cutoff = now - F.make_dt_interval(F.lit(30))
    totals = done.agg(n_rows("total"), F.count_if(F.col("created_at") >= cutoff).alias("recent"))
    # The category list is configuration; its map has one entry per category.
    by_name = public_categories(categories, sources).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("display_name", "completed")))).alias("by_category")
    )
    return attach_row(totals, by_name)


def admin_categories(categories: DataFrame, sources: DataFrame, mapping: DataFrame) -> DataFrame:
    return with_count(with_count(categories, "category_id", sources, "source_count"), "category_id", mapping, "prompt_count")


def category_ranking(categories: DataFrame, sources: DataFrame) -> DataFrame:
    return with_count(categories, "category_id", sources, "source_count").orderBy(F.desc("source_count"), "category_id")


def dashboard(sources, profiles, extractions, entities, variants, threshold: float = 0.7) -> DataFrame:
    state = lambda *names: F.count_if(F.col("status").isin(*names))
    return metrics(
        sources.agg(
            n_rows("total_sources"), state("completed").alias("completed_sources"), state("failed").alias("failed_sources"),
            state("pending", "crawled", "extracting").alias("open_sources"),
        ),
        profiles.agg(
            n_rows("total_profiles"), F.count_if("published").alias("published_profiles"),
            F.count_if(~F.col("published")).alias("unpublished_profiles"),
        ),
        extractions.agg(
            n_rows("total_extractions"), F.count_if(has_value()).alias("validated_extractions"),
            F.count("linked_entity_id").alias("linked_extractions"),
            F.count_if(F.col("final_confidence") < threshold).alias("low_confidence"),
            F.bround(F.coalesce(F.avg("final_confidence"), F.lit(0.0)) * 100, 1).alias("avg_confidence"),
        ),
        entities.agg(n_rows("total_entities")),
        variants.agg(n_rows("total_variants")),
    )


def translation_stats(extractions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Translation progress in one pass over the extractions."""
    flagged = extractions.join(prompts.select("prompt_id", "translatable"), "prompt_id")
    value = has_value()
    open_state = F.coalesce(F.col("translation_status") == "pending", F.lit(True)) | F.col("validated_result_en").isNull()
    counted = flagged.agg(
        F.count_if(value).alias("total"),
        F.count_if(value & F.col("translatable")).alias("translatable"),
        F.count_if(F.col("translation_status") == "translated").alias("translated"),
        F.count_if(value & F.col("translatable") & open_state).alias("pending"),
        F.count_if(F.col("translation_status") == "failed").alias("failed"),
    )
    share = F.bround(F.col("translated") / F.nullif(F.col("translatable"), F.lit(0)) * 100, 1)
    return counted.select("*", (F.col("total") - F.col("translatable")).alias("skipped"), F.coalesce(share, F.lit(0.0)).alias("progress"))


def translation_status_counts(profiles: DataFrame, translations: DataFrame, language: str = "en") -> DataFrame:
    states = translation_state(profiles, translations, language)
    return states.groupBy("translation_state").agg(F.count_if("published").alias("published"), n_rows("all_profiles"))


def link_stats(extractions, prompts, entities, variants) -> DataFrame:
    """Linking state as (metric, text) rows, with a rate such as '12.5%'."""
    typed = extractions.join(prompts.where("entity_type IS NOT NULL").select("prompt_id"), "prompt_id", "left_semi")
    total = typed.agg(n_rows("total"), F.count("linked_entity_id").alias("linked"))
    rate = F.when(F.col("total") > 0, F.format_string("%.1f%%", F.col("linked") / F.nullif(F.col("total"), F.lit(0)) * 100)).otherwise("0%")
    text = total.select(
        F.col("total").cast("string").alias("total"), F.col("linked").cast("string").alias("linked"),
        (F.col("total") - F.col("linked")).cast("string").alias("unlinked"), rate.alias("rate"),
    ).unpivot([], ["total", "linked", "unlinked", "rate"], "metric", "value")
    per_type = entities.groupBy("entity_type").agg(n_rows()).select(
        F.concat(F.lit("entities_"), "entity_type").alias("metric"), F.col("n").cast("string").alias("value")
    )
    names = variants.agg(n_rows()).select(F.lit("variants").alias("metric"), F.col("n").cast("string").alias("value"))
    return text.unionByName(per_type).unionByName(names)


def source_completion(sources, mapping, prompts, extractions) -> DataFrame:
    """Sources whose extraction count reaches the number of active prompts."""
    active = mapping.join(prompts.where("is_active").select("prompt_id"), "prompt_id", "left_semi")
    expected = active.groupBy("category_id").agg(n_rows("expected"))
    actual = extractions.groupBy("source_id").agg(n_rows("actual"))
    joined = sources.select("source_id", "category_id").join(expected, "category_id").join(actual, "source_id")
    return joined.where("actual >= expected")


def system_counts(**tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(n_rows()).select(F.lit(k).alias("table"), "n") for k, df in tables.items()])


def per_country(entities: DataFrame, top: int = 10) -> DataFrame:
    counts = entities.groupBy(F.coalesce("country", F.lit("??")).alias("country")).agg(n_rows())
    return counts.orderBy(F.desc("n"), "country").limit(top)


def prompts_by_group(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("field_group").agg(n_rows())


def homepage_counts(categories: DataFrame, sources: DataFrame, profiles: DataFrame, language: str = "de") -> DataFrame:
    """Published profiles per category; the English page leaves empty categories out and shows English names."""
    live = profiles.where("published").select("source_id").join(sources.select("source_id", "category_id"), "source_id")
    counted = with_count(categories, "category_id", live, "profiles")
    if language != "en":
        return counted
    return counted.where("profiles > 0").withColumn("display_name", F.coalesce("display_name_en", "display_name"))


def category_institutions(extractions, prompts, sources, profiles) -> DataFrame:
    """Distinct institution values of published records, one row each.

    Rows instead of one array per category: a category may hold most records.
    """
    field = prompts.where("internal_name = 'institution'").select("prompt_id")
    values = extractions.where(tx.not_blank(F.col("validated_result"))).join(field, "prompt_id", "left_semi")
    live = profiles.where("published").select("source_id").join(sources.select("source_id", "category_id"), "source_id")
    rows = values.select("source_id", F.col("validated_result").alias("institution")).join(live, "source_id")
    return rows.select("category_id", "institution").distinct().orderBy("category_id", "institution")


def profile_page_stats(profiles: DataFrame, translations: DataFrame, language: str = "en") -> DataFrame:
    stored = translations.where(F.col("language") == language).select("profile_id", F.lit(1).alias("_t"))
    return profiles.join(stored, "profile_id", "left").agg(
        n_rows("total"), F.count_if("published").alias("published"), F.count_if(~F.col("published")).alias("unpublished"),
        F.count("_t").alias("translated"), (F.count(F.lit(1)) - F.count("_t")).alias("untranslated"),
    )


def revalidation_stats(extractions: DataFrame) -> DataFrame:
    raw = has_value("raw_result")
    missing = F.col("validated_result").isNull() | (F.col("validated_result") == "")
    return extractions.agg(n_rows("total"), F.count_if(raw).alias("with_raw"), F.count_if(raw & missing).alias("missing_validation"))


def quality_distribution(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("validation_quality").agg(n_rows())


def additions_per_day(sources: DataFrame) -> DataFrame:
    return sources.groupBy(F.date_trunc("day", F.col("created_at")).cast("date").alias("day")).agg(n_rows())


def recovery_plan(sources, mapping, prompts, extractions) -> tuple[DataFrame, DataFrame]:
    """Jobs that restart every stuck source, and counts per state."""
    from fieldloom.operators.records import fully_extracted, missing_prompts

    none = F.lit(None).cast("long").alias("prompt_id")
    waiting = sources.where("status = 'pending'")
    crawled = sources.where("status = 'crawled'")
    running = sources.where("status = 'extracting'")
    crawl = waiting.select("source_id", none, F.lit("crawl").alias("job_type"), F.lit("pending").alias("from_state"))
    extract = fan_out_extract(crawled, mapping, prompts).select(
        "source_id", "prompt_id", F.lit("extract").alias("job_type"), F.lit("crawled").alias("from_state"))
    rest = missing_prompts(running, mapping, prompts, extractions).select(
        "source_id", "prompt_id", F.lit("extract").alias("job_type"), F.lit("extracting").alias("from_state"))
    jobs = crawl.unionByName(extract).unionByName(rest)
    per_state = jobs.groupBy("from_state").agg(n_rows("jobs"))
    found = sources.where(F.col("status").isin("pending", "crawled", "extracting")).groupBy(F.col("status").alias("from_state")).agg(n_rows("sources"))
    done = fully_extracted(running, mapping, prompts, extractions).agg(n_rows("auto_completed")).select(
        F.lit("extracting").alias("from_state"), "auto_completed")
    counts = found.join(per_state, "from_state", "left").join(done, "from_state", "left").fillna(0, ["jobs", "auto_completed"])
    return jobs, counts


def reset_failed(sources: DataFrame) -> DataFrame:
    """Failed sources back to pending with the error cleared."""
    return sources.where("status = 'failed'").withColumn("status", F.lit("pending")).withColumn("error_message", F.lit(None).cast("string"))
