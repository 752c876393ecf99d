"""Checks, sync and export of content-type definitions; entity import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions.text import strip
from fieldloom.operators.statistics import n_rows

# Metadata keys an institution has to carry.
KEY_FIELDS = ["type", "founded", "coordinates", "state"]


def validate_config(categories: DataFrame, prompts: DataFrame, groups: DataFrame, active: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Violations as (config, problem, detail); no row means the definitions are sound.

    ``unreadable``: config, error of definitions that could not be parsed.
    """

    def rows(df: DataFrame, problem: str, detail: Column) -> DataFrame:
        return df.select("config", F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))

    def missing(df: DataFrame, tests: dict[str, Column], problem: str, where: Column) -> DataFrame:
        names = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in tests.items()]))
        return rows(df.withColumn("_m", F.explode(names)), problem, F.concat(where, F.col("_m")))

    null = lambda c: F.col(c).isNull()
    category = missing(
        categories,
        {"internal_name": null("internal_name"), "display_name": null("display_name"), "template": null("template"),
         "field_groups": ~F.col("has_groups"), "active_groups": ~F.col("has_active")},
        "missing category field", F.lit(""))
    empty = rows(categories.join(prompts.select("config").distinct(), "config", "left_anti"), "no prompts", F.lit(""))
    place = F.concat((F.col("position") + 1).cast("string"), F.lit(": "))
    prompt = missing(prompts, {c: null(c) for c in ("internal_name", "display_name", "field_group")}, "missing prompt field", place)
    text = rows(prompts.where("prompt_template IS NULL AND extract_prompt IS NULL"), "no prompt text", (F.col("position") + 1).cast("string"))
    names = prompts.where("internal_name IS NOT NULL").groupBy("config", "internal_name").agg(n_rows())
    twice = rows(names.where("n > 1"), "duplicate prompt", F.col("internal_name"))
    fields = groups.where("field IS NOT NULL")
    known = names.select("config", F.col("internal_name").alias("field"))
    unknown = rows(fields.join(known, ["config", "field"], "left_anti"), "unknown prompt in group", F.concat_ws(".", "group_name", "field"))
    filled = fields.select("config", "group_name").distinct()
    hollow = rows(active.join(filled, ["config", "group_name"], "left_anti"), "active group without fields", F.col("group_name"))
    broken = [] if unreadable is None else [rows(unreadable, "unreadable definition", F.col("error"))]
    return reduce(DataFrame.unionByName, [category, empty, prompt, text, twice, unknown, hollow, *broken])


def sync_prompts(current: DataFrame, declared: DataFrame, force: bool = False) -> DataFrame:
    """Prompts after a sync with the ``action`` per row: created, updated, skipped or kept.

    Without ``force`` an existing prompt still takes translatable, display_name_en and
    entity_type, so that a corrected flag always arrives.
    """
    return _synced(current, declared, force, {"translatable", "display_name_en", "entity_type"})


def sync_categories(current: DataFrame, declared: DataFrame, force: bool = False) -> DataFrame:
    """Categories after a sync with the ``action`` per row; an existing one changes with ``force`` only."""
    return _synced(current, declared, force, set())


def _synced(current: DataFrame, declared: DataFrame, force: bool, always: set[str]) -> DataFrame:
    new = declared.select("internal_name", *[F.col(c).alias("_n_" + c) for c in declared.columns if c != "internal_name"], F.lit(True).alias("_new"))
    joined = current.withColumn("_old", F.lit(True)).join(new, "internal_name", "full")
    action = (
        F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept")
        .when(F.lit(force), "updated").otherwise("skipped")
    )
    out = [F.col("internal_name")]
    for name in current.columns:
        if name == "internal_name":
            continue
        if name not in declared.columns:
            fresh = F.coalesce(F.col(name), F.lit(True)) if name == "is_active" else F.col(name)
            if name == "is_active" and force:
                fresh = F.col("_new").isNotNull() | F.coalesce(F.col(name), F.lit(False))
            out.append(fresh.alias(name))
            continue
        take = F.col("_new").isNotNull() & (F.lit(force or name in always) | F.col("_old").isNull())
        out.append(F.when(take, F.col("_n_" + name)).otherwise(F.col(name)).alias(name))
    return joined.select(*out, action.alias("action"))


def sync_mapping(mapping: DataFrame, declared: DataFrame, force: bool = False) -> DataFrame:
    """Mapping after a sync; ``force`` rebuilds the mapping of declared categories."""
    keys = ["category_id", "prompt_id"]
    names = declared.select("category_id").distinct()
    if force:
        kept = mapping.join(names, "category_id", "left_anti")
        return kept.withColumn("action", F.lit("kept")).unionByName(declared.select(*mapping.columns).withColumn("action", F.lit("created")))
    fresh = declared.select(*mapping.columns).join(mapping.select(*keys), keys, "left_anti")
    return mapping.withColumn("action", F.lit("kept")).unionByName(fresh.withColumn("action", F.lit("created")))


def sync_stats(**synced: DataFrame) -> DataFrame:
    """Rows per table and action."""
    parts = [df.where("action <> 'kept'").groupBy("action").agg(n_rows()).select(F.lit(k).alias("table"), "action", "n") for k, df in synced.items()]
    return reduce(DataFrame.unionByName, parts)


def export_category(categories: DataFrame, mapping: DataFrame, prompts: DataFrame) -> DataFrame:
    """One JSON document per category with its prompts in display order."""
    field = F.struct(
        "internal_name", "display_name", "field_group", F.col("field_type").alias("output_format"), F.col("extract_prompt").alias("prompt_template"))
    listed = mapping.join(prompts, "prompt_id").groupBy("category_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("display_order", "prompt_id", field.alias("f")))), lambda s: s["f"]).alias("prompts"))
    rows = categories.join(listed, "category_id", "left")
    body = F.struct(F.struct("internal_name", "display_name").alias("category"), F.coalesce("prompts", F.array().cast(listed.schema["prompts"].dataType)).alias("prompts"))
    return rows.select("category_id", F.to_json(body).alias("json"))


def import_entities(records: DataFrame, extras: DataFrame, countries: list[str]) -> DataFrame:
    """Inventory rows of the wanted countries, extras merged by lower-case name.

    ``records``: position, name, country, code, domains.  ``extras``: canonical_name,
    country, code, domains, variants.  When a name repeats, the last record takes the
    extra's variants and domains.
    """
    wanted = [c.strip().upper() for c in countries]
    name = strip(F.coalesce("name", F.lit("")))
    none = F.array().cast("array<string>")
    base = records.where(F.col("code").isin(wanted)).withColumn("canonical_name", name).where("canonical_name <> ''")
    base = base.select("position", "canonical_name", "country", "code", F.coalesce("domains", none).alias("domains"), F.lower("canonical_name").alias("_key"))
    last = base.groupBy("_key").agg(F.max("position").alias("position"))
    more = extras.where(F.col("code").isin(wanted)).withColumn("_key", F.lower("canonical_name"))
    joined_extra = last.join(more.select("_key", F.col("domains").alias("_d"), F.col("variants").alias("_v")), "_key")
    rows = base.join(joined_extra.drop("_key"), "position", "left")
    merged = rows.select(
        "canonical_name", "country", "code",
        F.when(F.col("_d").isNotNull(), F.array_sort(F.array_union("domains", "_d"))).otherwise(F.col("domains")).alias("domains"),
        F.coalesce(F.array_sort(F.array_distinct("_v")), none).alias("variants"))
    added = more.join(base.select("_key"), "_key", "left_anti").select("canonical_name", "country", "code", "domains", "variants")
    return merged.unionByName(added).withColumn("domain", F.try_element_at("domains", F.lit(1)))


def metadata_needs_update(entities: DataFrame, known: DataFrame) -> DataFrame:
    """entity_id, action (update or skip): stored metadata against fresh metadata by name.

    Metadata are maps of text.  Unknown names are skipped.
    """
    now, new = F.col("metadata"), F.col("_new")
    lacking = F.exists(
        F.array(*[F.lit(k) for k in KEY_FIELDS]), lambda k: F.map_contains_key(new, k) & ~F.map_contains_key(now, k))
    moved = F.map_contains_key(new, F.lit("coordinates")) & ~F.try_element_at(now, F.lit("coordinates")).eqNullSafe(F.try_element_at(new, F.lit("coordinates")))
    due = now.isNull() | (F.size(now) < 5) | lacking | moved
    joined = entities.join(known.select("canonical_name", F.col("metadata").alias("_new")), "canonical_name", "left")
    return joined.select("entity_id", F.when(new.isNotNull() & due, "update").otherwise("skip").alias("action"))
