"""State changes: the current table and a change set give the new table.

Nothing is updated in place; a job writes the result as a new version (see
``sources.sinks``).  Keys of a table are unique; a change set may name a key several
times, and its last change counts, so the joins add no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions import answers, web
from fieldloom.operators.records import content_hash, fan_out_extract
from fieldloom.operators.statistics import n_rows


def last_change(changes: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the last by ``order``, ties and the default by all other columns."""
    rest = [c for c in changes.columns if c not in keys]
    if not rest:
        return changes.distinct()
    by = [*order, *[c for c in rest if c not in order and changes.schema[c].dataType.typeName() != "map"]]
    last = F.max_by(F.struct(*rest), F.struct(*by)).alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*changes.columns)


def new_key(*parts: Column | str) -> Column:
    """A 60-bit key of a natural key, the same on every run."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _renamed(df: DataFrame, keys: list[str], prefix: str = "_n_", order: tuple[str, ...] = ()) -> DataFrame:
    df = last_change(df, keys, order)
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys], F.lit(True).alias("_new"))


def upsert(
    current: DataFrame, new: DataFrame, keys: list[str], keep: Column | None = None, fixed: tuple[str, ...] = (), order: tuple[str, ...] = (),
    primary: str | None = None,
) -> DataFrame:
    """Insert or replace rows by key.

    ``keep`` marks current rows that must stay; ``fixed`` columns keep their current
    value on replacement.  ``primary`` names the primary key, which inserted rows get
    from ``keys``; other columns absent from ``new`` become NULL on insert.
    """
    joined = current.withColumn("_old", F.lit(True)).join(_renamed(new, keys, order=order), keys, "full")
    stays = F.col("_new").isNull() | (F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False))
    out = []
    for name in current.columns:
        if name == primary:
            out.append(F.when(F.col("_old"), F.col(name)).otherwise(new_key(F.lit(primary), *keys)).alias(name))
        elif name in keys or name not in new.columns:
            out.append(F.col(name))
        elif name in fixed:
            out.append(F.when(F.col("_old"), F.col(name)).otherwise(F.col("_n_" + name)).alias(name))
        else:
            out.append(F.when(stays, F.col(name)).otherwise(F.col("_n_" + name)).alias(name))
    return joined.select(*out)


def upsert_extractions(current: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Edited rows win over new results unless ``force``."""
    out = upsert(current, new, ["source_id", "prompt_id"], keep=None if force else F.col("is_manual_edit"), primary="extraction_id")
    return out.withColumn("is_manual_edit", F.coalesce("is_manual_edit", F.lit(False)))


def patch(
    current: DataFrame, changes: DataFrame, key: str, columns: dict[str, Column], order: tuple[str, ...] = (), keep: Column | None = None
) -> DataFrame:
    """Set ``columns`` on rows whose key appears in ``changes`` (columns as '_n_<name>'), but for rows that ``keep`` marks."""
    joined = current.join(_renamed(changes, [key], order=order), key, "left")
    hit = F.col("_new").isNotNull() & (F.lit(True) if keep is None else ~F.coalesce(keep, F.lit(False)))
    return joined.select(*[F.when(hit, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def apply_manual_edits(extractions: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits``: extraction_id, value, editor, edited_at."""
    return patch(extractions, edits, "extraction_id", {
        "validated_result": F.col("_n_value"), "is_manual_edit": F.lit(True), "edited_by": F.col("_n_editor"), "updated_at": F.col("_n_edited_at")}, order=("edited_at",))


def review_errors(reviews: DataFrame, actions: DataFrame) -> DataFrame:
    """Action rows that cannot be applied, with the reason."""
    known = reviews.select("review_id", F.lit(True).alias("_known"))
    problem = (
        F.when(F.col("_known").isNull(), "unknown review")
        .when(~F.coalesce(F.col("action").isin("confirm", "reject"), F.lit(False)), "unknown action")
        .when((F.col("action") == "confirm") & F.col("entity_id").isNull(), "entity required")
    )
    return actions.join(known, "review_id", "left").withColumn("error", problem).where("error IS NOT NULL").select("review_id", "action", "error")


def apply_reviews(reviews: DataFrame, extractions: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New reviews and extractions.  ``actions``: review_id, action, entity_id, reviewer, at."""
    valid = actions.where((F.col("action") == "reject") | ((F.col("action") == "confirm") & F.col("entity_id").isNotNull()))
    status = F.when(F.col("_n_action") == "confirm", "reviewed").otherwise("ignored")
    new_reviews = patch(reviews, valid, "review_id", {"status": status, "reviewed_by": F.col("_n_reviewer"), "reviewed_at": F.col("_n_at")}, order=("at",))
    links = last_change(valid, ["review_id"], ("at",)).where("action = 'confirm'").join(reviews.select("review_id", "extraction_id", "confidence"), "review_id")
    links = links.select("extraction_id", "entity_id", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"), "at", "review_id")
    linked = patch(
        extractions, links, "extraction_id", {"linked_entity_id": F.col("_n_entity_id"), "entity_confidence": F.col("_n_confidence")}, order=("at", "review_id"))
    return new_reviews, linked


def publish(profiles: DataFrame, ids: DataFrame | None, published: bool, now: Column) -> DataFrame:
    """Set or clear the published flag and time; ``ids`` None means every profile not yet there."""
    moment = now if published else F.lit(None).cast("timestamp_ntz")
    if ids is None:
        due = F.col("published") != F.lit(published)
        return profiles.withColumn("published_at", F.when(due, moment).otherwise(F.col("published_at"))).withColumn("published", F.lit(published))
    return patch(profiles, ids.select("profile_id").distinct(), "profile_id", {"published": F.lit(published), "published_at": moment})


def delete_cascade(ids: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the deleted keys."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def not_found(ids: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """The asked-for keys that ``table`` does not hold, each once."""
    return ids.select(key).distinct().join(table, key, "left_anti")


def delete_counts(ids: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Rows each table loses, and asked-for keys that do not exist ('not_found')."""
    gone = ids.select(key).distinct()
    out = None
    for name, df in tables.items():
        part = df.join(gone, key, "left_semi").agg(n_rows()).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    first = next(iter(tables.values()))
    lost = not_found(ids, key, first).agg(n_rows()).select(F.lit("not_found").alias("table"), "n")
    return out.unionByName(lost)


def delete_entities(ids: DataFrame, entities, variants, extractions, reviews) -> dict[str, DataFrame]:
    """Entities and variants go; links and suggestions that named them become NULL."""
    gone = ids.select("entity_id").distinct()
    marked = gone.withColumn("_gone", F.lit(True))

    def cleared(df: DataFrame, column: str, also: str) -> DataFrame:
        joined = df.join(marked.withColumnRenamed("entity_id", column), column, "left")
        null = lambda c: F.when(F.col("_gone").isNull(), F.col(c)).alias(c)
        return joined.select(*[null(c) if c in (column, also) else F.col(c) for c in df.columns])

    return {
        "entities": entities.join(gone, "entity_id", "left_anti"),
        "variants": variants.join(gone, "entity_id", "left_anti"),
        "extractions": cleared(extractions, "linked_entity_id", "linked_entity_id"),
        "reviews": cleared(reviews, "suggestion_id", "confidence"),
    }


def upsert_profiles(profiles: DataFrame, rendered: DataFrame, now: Column) -> DataFrame:
    """One profile per source; new ones start unpublished, old ones keep their flags."""
    new = rendered.select("source_id", "markdown_content", F.lit(False).alias("published"), now.alias("generated_at"))
    return upsert(profiles, new, ["source_id"], fixed=("published",), primary="profile_id")


def upsert_translations(translations: DataFrame, profiles: DataFrame, rendered: DataFrame, language: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """New translations with the hash of their base, and rows without a base profile."""
    base = profiles.select("source_id", "profile_id", content_hash(F.col("markdown_content")).alias("source_hash"))
    new = rendered.join(base, "source_id").select("profile_id", F.lit(language).alias("language"), "markdown_content", "source_hash", now.alias("translated_at"))
    orphans = rendered.join(base.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("no base profile").alias("error"))
    return upsert(translations, new, ["profile_id", "language"]), orphans


def restart_sources(sources, picked, mapping, prompts, message: str = "no prompts for this category") -> tuple[DataFrame, DataFrame]:
    """Picked sources back to 'crawled' (or failed without prompts), and their new jobs."""
    active = mapping.join(prompts.where("is_active").select("prompt_id"), "prompt_id", "left_semi").select("category_id").distinct()
    chosen = sources.join(picked.select("source_id"), "source_id", "left_semi")
    runnable = chosen.join(active, "category_id", "left_semi").select("source_id", F.lit(True).alias("_run"))
    flags = chosen.select("source_id").join(runnable, "source_id", "left")
    out = patch(sources, flags, "source_id", {
        "status": F.when(F.col("_n__run"), "crawled").otherwise("failed"),
        "error_message": F.when(F.col("_n__run"), F.lit(None).cast("string")).otherwise(message)})
    return out, fan_out_extract(chosen, mapping, prompts)


def _without_results(picked, extractions, profiles, force: bool) -> dict[str, DataFrame]:
    """Tables without the results of the picked sources; edited extractions stay unless ``force``."""
    edited = F.lit(False) if force else F.coalesce("is_manual_edit", F.lit(False))
    gone = picked.select("source_id", F.lit(True).alias("_gone")).distinct()
    kept = extractions.join(gone, "source_id", "left").where(F.col("_gone").isNull() | edited).select(*extractions.columns)
    return {"extractions": kept, "profiles": delete_cascade(picked, "source_id", profiles=profiles)["profiles"]}


def reextract_all(sources, extractions, profiles, mapping, prompts, force: bool = False) -> dict[str, DataFrame]:
    """Drop results of completed and running sources and start them again."""
    picked = sources.where(F.col("status").isin("completed", "extracting"))
    new_sources, jobs = restart_sources(sources, picked, mapping, prompts)
    return {"sources": new_sources, "jobs": jobs, **_without_results(picked, extractions, profiles, force)}


def change_category(sources, changes, extractions, profiles, mapping, prompts, re_extract: bool = True, force: bool = False) -> dict[str, DataFrame]:
    """``changes``: source_id, category_id.  Optionally extract again under the new category."""
    moved = patch(sources, changes, "source_id", {"category_id": F.col("_n_category_id")})
    if not re_extract:
        return {"sources": moved, "extractions": extractions, "profiles": profiles, "jobs": fan_out_extract(moved.limit(0), mapping, prompts)}
    picked = moved.where(F.col("status").isin("completed", "crawled", "extracting")).join(changes.select("source_id"), "source_id", "left_semi")
    active = mapping.join(prompts.where("is_active").select("prompt_id"), "prompt_id", "left_semi").select("category_id").distinct()
    runnable = picked.join(active, "category_id", "left_semi").select("source_id")
    restarted = patch(moved, runnable, "source_id", {"status": F.lit("crawled"), "error_message": F.lit(None).cast("string")})
    kept = _without_results(picked, extractions, profiles, force)
    jobs = fan_out_extract(picked.join(runnable, "source_id", "left_semi"), mapping, prompts)
    return {"sources": restarted, "jobs": jobs, **kept}


def revalidate(extractions: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Replace validation columns by new answers and recompute the confidence; edited rows stay unless ``force``.

    ``results``: extraction_id, result, quality, score, notes, error.
    """
    good = results.where("error IS NULL").drop("error")
    return patch(extractions, good, "extraction_id", {
        "validated_result": F.col("_n_result"), "validation_quality": F.col("_n_quality"), "validation_score": F.col("_n_score"),
        "final_confidence": answers.final_confidence(F.col("raw_confidence"), F.col("_n_score"))}, keep=None if force else F.col("is_manual_edit"))


def revalidation_counts(results: DataFrame) -> DataFrame:
    return results.agg(n_rows("total"), F.count_if(F.col("error").isNull()).alias("validated"), F.count("error").alias("failed"))


def register_sources(sources: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New sources, their crawl jobs and refused requests.

    ``requests``: request_id, url, category_id, rate_limit.  Within one run the first
    request of an address wins.
    """
    clean = requests.withColumn("_url", web.normalize_url(F.col("url")))
    valid = clean.where("_url IS NOT NULL")
    first = valid.groupBy("_url").agg(F.min("request_id").alias("request_id"))
    fresh = first.join(sources.select(F.col("url").alias("_url")), "_url", "left_anti").select("request_id")
    accepted = valid.join(fresh, "request_id", "left_semi")
    # Invalid ones have no key here and so are refused by the same join.
    marked = clean.withColumn("_id", F.when(F.col("_url").isNotNull(), F.col("request_id")))
    reason = F.when(F.col("_url").isNull(), "invalid url").otherwise("url already registered")
    refused = marked.join(fresh.withColumnRenamed("request_id", "_id"), "_id", "left_anti").select("request_id", "url", reason.alias("error"))
    key = new_key(F.lit("source_id"), F.col("_url")).alias("source_id")
    new = accepted.select("request_id", key, F.col("_url").alias("url"), "category_id", F.lit("pending").alias("status"))
    jobs = accepted.select("request_id", key, F.col("_url").alias("url"), F.lit("crawl").alias("job_type"), F.coalesce("rate_limit", F.lit(1.0)).alias("rate_limit"))
    return new, jobs, refused


def apply_updates(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: ``changes`` holds key and ``values``, a map of column name to text value.

    With a column ``at`` the changes of a row follow each other: for every column the last value counts.
    """
    at = F.col("at") if "at" in changes.columns else F.lit(0)
    each = changes.select(key, at.alias("_at"), F.explode("values").alias("_name", "_value"))
    each = each.groupBy(key, "_name").agg(F.max_by(F.struct("_value"), F.struct("_at", "_value")).alias("_last"))
    values = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_last._value"))).alias("_v"))  # at most one entry per column
    joined = table.join(values, key, "left")
    out = []
    for field in table.schema.fields:
        name = field.name
        if name == key:
            out.append(F.col(name))
            continue
        given = F.coalesce(F.map_contains_key("_v", F.lit(name)), F.lit(False))
        value = F.try_element_at("_v", F.lit(name)).try_cast(field.dataType)
        out.append(F.when(given, value).otherwise(F.col(name)).alias(name))
    return joined.select(*out)


def insert_unique(table: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and conflicts with a taken value of ``key``."""
    taken = table.select(key).distinct()
    return new.join(taken, key, "left_anti"), new.join(taken, key, "left_semi").withColumn("error", F.lit("already exists"))


def set_flag(table: DataFrame, names: DataFrame, key: str, column: str, value: bool) -> DataFrame:
    """Set a flag on all rows named in a list."""
    return patch(table, names.select(key).distinct(), key, {column: F.lit(value)})


def edit_links(links: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Add and remove mapping or dependency rows; existing rows stay once."""
    keys = add.columns
    # Rows of few bytes: tasks of a size in bytes would hold too many of them to sort.
    tasks = 4 * int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links, remove, add = (df.repartition(tasks, *keys) for df in (links, remove.select(*keys), add))
    kept = links.join(remove, keys, "left_anti")
    fresh = add.distinct().join(kept.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def retire_categories(categories: DataFrame, ids: DataFrame, sources: DataFrame, force: bool = False) -> DataFrame:
    """Asked-for categories with the action taken: deactivated or deleted."""
    used = sources.where("category_id IS NOT NULL").groupBy("category_id").agg(n_rows("sources"))
    rows = categories.join(ids.select("category_id").distinct(), "category_id", "left_semi").join(used, "category_id", "left").fillna(0, ["sources"])
    action = F.lit("deleted") if force else F.when(F.col("sources") > 0, "deactivated").otherwise("deleted")
    return rows.select("category_id", "sources", action.alias("action"))


def delete_prompts(prompts: DataFrame, ids: DataFrame, extractions: DataFrame) -> DataFrame:
    """Asked-for prompts: deleted, or refused while extractions use them."""
    used = extractions.groupBy("prompt_id").agg(n_rows("extractions"))
    rows = prompts.join(ids.select("prompt_id").distinct(), "prompt_id", "left_semi").join(used, "prompt_id", "left").fillna(0, ["extractions"])
    return rows.select("prompt_id", "extractions", F.when(F.col("extractions") > 0, "refused").otherwise("deleted").alias("action"))


def add_variants(variants: DataFrame, entities: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted variant rows, and conflicts naming the entity that owns the name.

    ``new``: request_id, entity_id, variant_name; the first request of a name wins.
    """
    owner = variants.groupBy("variant_name").agg(F.min("entity_id").alias("_owner"))
    first = new.groupBy("variant_name").agg(F.min(F.struct("request_id", "entity_id")).alias("_first"))
    rows = new.join(owner, "variant_name", "left").join(first, "variant_name")
    free = F.col("_owner").isNull() & (F.col("_first.request_id") == F.col("request_id"))
    names = entities.select(F.col("entity_id").alias("_owner_id"), F.col("canonical_name").alias("owner"))
    clash = rows.where(~free).withColumn("_owner_id", F.coalesce("_owner", "_first.entity_id")).join(names, "_owner_id", "left")
    return rows.where(free).select("request_id", "entity_id", "variant_name"), clash.select("request_id", "variant_name", F.col("_owner_id").alias("owner_id"), "owner")


def regenerate_profiles(sources: DataFrame, rendered: DataFrame, now: Column) -> DataFrame:
    """All profiles anew: one unpublished profile per completed source."""
    done = sources.where("status = 'completed'").select("source_id")
    key = new_key(F.lit("profile_id"), F.col("source_id")).alias("profile_id")
    return rendered.join(done, "source_id", "left_semi").select(key, "source_id", "markdown_content", F.lit(False).alias("published"), now.alias("generated_at"))
