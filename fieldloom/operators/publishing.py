"""Records to profiles, index items and site tables.

Grouping by source is bounded by the number of fields of a category: (source,
prompt) is unique.  Site-wide tables stay row-wise and are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions import markdown as md, text as tx
from fieldloom.plans.order import attach_row

# Fields that carry the title and the description of a record.
TITLE_FIELDS = ["project_name", "service_name"]
INDEX_TITLE_FIELDS = ["project_name", "service_name", "course_name", "title"]
DESCRIPTION_FIELDS = ["description", "short_description"]
INDEX_DESCRIPTION_FIELDS = ["description", "short_description", "public_description"]


def _with_field(extractions: DataFrame, prompts: DataFrame) -> DataFrame:
    return extractions.join(prompts.select("prompt_id", "internal_name", "display_name", "field_group", "required_confidence"), "prompt_id")


def _last(value: Column, test: Column) -> Column:
    return F.max_by(value, F.when(test, F.col("prompt_id")))


def _first(value: Column, test: Column) -> Column:
    return F.min_by(value, F.when(test, F.col("prompt_id")))


def record_pivot(extractions: DataFrame, prompts: DataFrame) -> DataFrame:
    """source_id, title, institution, description, parts (values in field order)."""
    name, value = F.col("internal_name"), tx.strip(F.col("validated_result"))
    rows = _with_field(extractions, prompts).where(tx.not_blank(F.col("validated_result"))).withColumn("_v", value)
    return rows.groupBy("source_id").agg(
        _last(F.col("_v"), name.isin(INDEX_TITLE_FIELDS)).alias("title"),
        _last(F.col("_v"), name == "institution").alias("institution"),
        F.substring(_first(F.col("_v"), name.isin(INDEX_DESCRIPTION_FIELDS)), 1, 300).alias("description"),
        F.transform(F.array_sort(F.collect_list(F.struct("prompt_id", "_v"))), lambda s: s["_v"]).alias("parts"),
    )


def index_variants(extractions: DataFrame, entities: DataFrame, variants: DataFrame) -> DataFrame:
    """source_id and names of its linked entities: variants first, then canonical names."""
    linked = extractions.where(F.col("linked_entity_id").isNotNull() & tx.not_blank(F.col("validated_result"))).select(
        "source_id", F.col("linked_entity_id").alias("entity_id")).distinct()
    names = variants.select("entity_id", F.lit(0).alias("kind"), F.col("variant_name").alias("name")).unionByName(
        entities.select("entity_id", F.lit(1).alias("kind"), F.col("canonical_name").alias("name")))
    rows = linked.join(names, "entity_id").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("kind", "entity_id", "name"))).alias("_n"))
    return rows.select("source_id", F.transform("_n", lambda s: s["name"]).alias("entity_variants"))


def _public_institution(col: Column) -> Column:
    return F.when(col.isNull() | col.isin(md.PLACEHOLDERS), "").otherwise(col)


def index_items(profiles, extractions, prompts, sources, categories, entities, variants, prefix: str = "") -> DataFrame:
    """Search index items of published profiles (original language)."""
    none = F.array().cast("array<string>")
    live = profiles.where("published").select("source_id", "markdown_content")
    place = sources.select("source_id", "category_id").join(
        categories.select("category_id", F.col("display_name").alias("category"), F.col("internal_name").alias("category_key")), "category_id")
    rows = live.join(place, "source_id").join(record_pivot(extractions, prompts), "source_id", "left").join(
        index_variants(extractions, entities, variants), "source_id", "left")
    plain = F.when(F.coalesce("markdown_content", F.lit("")) != "", F.array(md.clean_markdown(F.col("markdown_content")))).otherwise(none)
    names = F.coalesce("entity_variants", none)
    full = F.array_join(F.array_distinct(F.concat(F.coalesce("parts", none), plain, names)), " ")
    out = rows.select(
        F.col("source_id").cast("string").alias("id"),
        F.coalesce("title", md.profile_title(F.col("markdown_content"), first_line=True)).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        _public_institution(F.col("institution")).alias("institution"),
        "category", F.col("category_key").alias("category_id"),
        F.concat(F.lit(f"{prefix}/details/"), F.col("source_id").cast("string"), F.lit(".html")).alias("url"),
        F.substring(full, 1, md.INDEX_TEXT_LIMIT).alias("fulltext"), names.alias("entity_variants"),
    )
    return out.where("title <> ''")


def english_index_items(profiles, translations, sources, categories) -> DataFrame:
    """Search index items of translated profiles, read from the translated text only."""
    text = F.col("_text")
    rows = profiles.where("published").select("profile_id", "source_id", "generated_at").join(
        translations.where("language = 'en'").select("profile_id", F.col("markdown_content").alias("_text")), "profile_id")
    rows = rows.join(sources.select("source_id", "category_id"), "source_id").join(
        categories.select("category_id", F.coalesce("display_name_en", "display_name").alias("category"), F.col("internal_name").alias("category_key")), "category_id")
    return rows.select(
        F.col("source_id").cast("string").alias("id"), md.profile_title(text).alias("title"),
        md.profile_institution(text, lines=20, unlink=True).alias("institution"), md.section_description(text).alias("description"),
        "category", F.col("category_key").alias("category_id"),
        F.concat(F.lit("details/"), F.col("source_id").cast("string"), F.lit(".html")).alias("url"),
        F.coalesce(F.date_format("generated_at", "yyyy-MM-dd"), F.lit("")).alias("date"),
        F.coalesce(F.substring(md.clean_markdown(text), 1, md.INDEX_TEXT_LIMIT), F.lit("")).alias("fulltext"),
        F.array().cast("array<string>").alias("entity_variants"),
    )


def profile_summary(profiles, extractions, prompts, sources, categories) -> DataFrame:
    """List view of published profiles; no confidence rule applies here."""
    name, value = F.col("internal_name"), F.col("validated_result")
    rows = _with_field(extractions, prompts)
    fields = rows.groupBy("source_id").agg(
        _last(value, name.isin(TITLE_FIELDS) & (value != "")).alias("title"),
        _last(value, name == "institution").alias("institution"),
        _last(value, name.isin(DESCRIPTION_FIELDS)).alias("_d"))
    live = profiles.where("published").select("profile_id", "source_id", "published_at")
    place = sources.select("source_id", F.col("url").alias("source_url"), "category_id")
    joined = live.join(place, "source_id").join(categories.select("category_id", F.col("display_name").alias("category")), "category_id", "left")
    return joined.join(fields, "source_id", "left").select(
        "profile_id", "source_id", "source_url", F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("category", F.lit("Unknown")).alias("category"), "institution",
        F.substring(F.nullif("_d", F.lit("")), 1, 200).alias("short_description"), "published_at")


def api_index_items(profiles, extractions, prompts, sources, categories) -> DataFrame:
    """Index of the read API: only values at or above their field's confidence."""
    name, value = F.col("internal_name"), F.col("validated_result")
    rows = _with_field(extractions, prompts).where((value != "") & (F.col("final_confidence") > 0) & (F.col("final_confidence") >= F.col("required_confidence")))
    fields = rows.groupBy("source_id").agg(
        _last(value, name.isin(TITLE_FIELDS)).alias("_t"), _last(value, name == "institution").alias("_i"), _last(value, name.isin(DESCRIPTION_FIELDS)).alias("_d"))
    joined = profiles.where("published").select("source_id").join(sources.select("source_id", "url", "category_id"), "source_id").join(
        categories.select("category_id", F.col("display_name").alias("_c")), "category_id", "left").join(fields, "source_id", "left")
    title, inst, desc, cat = F.coalesce("_t", F.lit("Untitled")), F.coalesce("_i", F.lit("")), F.coalesce("_d", F.lit("")), F.coalesce("_c", F.lit(""))
    return joined.select(
        F.col("source_id").alias("id"), title.alias("title"), F.substring(desc, 1, 300).alias("description"),
        F.coalesce("_c", F.lit("Unknown")).alias("category"), inst.alias("institution"), "url",
        F.concat_ws(" ", title, inst, desc, cat).alias("relevance_text"))


def field_values(extractions, prompts, sources, categories, language: str = "de") -> DataFrame:
    """source_id, values: fields of active groups, sure enough and not blank."""
    groups = sources.select("source_id", "category_id").join(categories.select("category_id", "active_groups"), "category_id")
    rows = _with_field(extractions, prompts).where("final_confidence >= required_confidence").join(groups, "source_id")
    rows = rows.where(F.array_contains("active_groups", F.col("field_group"))).withColumn("_v", md.value_for_language(language)).where("_v IS NOT NULL")
    return rows.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("internal_name", "_v")))).alias("values"))


def detail_context(extractions: DataFrame, prompts: DataFrame) -> DataFrame:
    """source_id, fields: name to value, confidence and label of publishable fields."""
    rows = _with_field(extractions, prompts).where(tx.not_blank(F.col("validated_result")) & (F.col("final_confidence") >= F.col("required_confidence")))
    entry = F.struct(F.col("validated_result").alias("value"), F.col("final_confidence").alias("confidence"), "display_name")
    return rows.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("internal_name", entry.alias("field"))))).alias("fields"))


def render_profiles(extractions, prompts, sources, categories, today: Column, language: str = "de") -> DataFrame:
    """source_id, markdown_content rendered from the category template."""
    values = field_values(extractions, prompts, sources, categories, language)
    shaped = categories.select("category_id", md.template_tokens(F.col("template")).alias("_tokens"))
    rows = sources.select("source_id", "url", "crawled_at", "category_id").join(shaped, "category_id").join(values, "source_id", "left")
    have = F.coalesce("values", F.create_map().cast("map<string,string>"))
    extra = F.create_map(F.lit("source_url"), F.col("url"), F.lit("crawled_at"), F.date_format(F.coalesce("crawled_at", today), "yyyy-MM-dd"))
    extra_names = ["source_url", "crawled_at"]
    rows = rows.withColumn("_all", F.map_concat(F.map_filter(have, lambda k, v: ~k.isin(extra_names)), extra))
    text = F.when(F.size("_tokens") > 0, md.render_tokens(F.col("_tokens"), F.col("_all"))).otherwise(md.fallback_markdown(F.col("_all"), F.col("url")))
    return rows.select("source_id", text.alias("markdown_content"))


#: Collation of title lists; the root order of Unicode, which German shares.
TITLE_ORDER = "UNICODE"


def latest_profiles(profiles: DataFrame, n: int = 6) -> DataFrame:
    return profiles.where("published").orderBy(F.desc("generated_at"), "profile_id").limit(n)


def category_listing(profiles: DataFrame, sources: DataFrame, order: str = "newest") -> DataFrame:
    """Published profiles per category in reading order.

    Titles are in the order of a locale, as readers see them: letters before case and
    accents ("Ähre" beside "Ahre", not after "Zoo"); equal titles by id.
    """
    rows = profiles.where("published").join(sources.select("source_id", "category_id"), "source_id").withColumn(
        "title", md.profile_title(F.col("markdown_content")))
    keys = {"newest": F.desc("generated_at"), "oldest": F.asc("generated_at"), "title": F.collate(F.lower("title"), TITLE_ORDER)}
    return rows.orderBy("category_id", keys[order], "profile_id")


def institution_filter(items: DataFrame, wanted: str) -> DataFrame:
    """Items of the wanted institution, else of the first one that contains it or is contained."""
    name = F.col("institution")
    near = (name != "") & (name.contains(wanted) | F.lit(wanted).contains(name))
    choice = items.where((name == wanted) | near).agg(
        F.coalesce(F.min(F.when(name == wanted, name)), F.min(F.when(near, name))).alias("_choice"))
    joined = attach_row(items, choice)
    return joined.where(F.col("_choice").isNull() | (name == F.col("_choice"))).drop("_choice")


# --- site tables -------------------------------------------------------------


def entity_index(entities: DataFrame, variants: DataFrame) -> DataFrame:
    """Autocomplete entries; ``section`` splits universities from the rest.

    The file holds one JSON object per line, so no task gathers the inventory.
    """
    names = variants.groupBy("entity_id").agg(F.array_sort(F.collect_list("variant_name")).alias("variants"))
    own = F.coalesce("variants", F.array().cast("array<string>"))
    return entities.join(names, "entity_id", "left").select(
        F.when(F.col("entity_type") == "university", "institutions").otherwise("other").alias("section"),
        F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"),
        own.alias("variants"), F.concat(F.array("canonical_name"), own).alias("search_terms"))


def _one(df: DataFrame, **values: str) -> DataFrame:
    return df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def sitemap(categories: DataFrame, profiles: DataFrame, base: str, today: str) -> DataFrame:
    """loc, lastmod, changefreq, priority and the XML element of every public page."""
    cats = categories.where("is_active").select(
        F.concat(F.lit(base + "/"), "internal_name", F.lit("/")).alias("loc"), F.lit(today).alias("lastmod"), F.lit("daily").alias("changefreq"), F.lit("0.8").alias("priority"))
    pages = profiles.where("published").select(
        F.concat(F.lit(base + "/details/"), F.col("source_id").cast("string"), F.lit(".html")).alias("loc"),
        F.date_format("generated_at", "yyyy-MM-dd").alias("lastmod"), F.lit("weekly").alias("changefreq"), F.lit("0.6").alias("priority"))
    home = _one(categories, loc=base + "/", lastmod=today, changefreq="daily", priority="1.0")
    find = _one(categories, loc=base + "/suche.html", lastmod=today, changefreq="weekly", priority="0.7")
    rows = reduce(DataFrame.unionByName, [home, cats, pages, find])
    parts = [F.lit("  <url>\n")]
    for tag in ("loc", "lastmod", "changefreq", "priority"):
        parts += [F.lit(f"    <{tag}>"), F.col(tag), F.lit(f"</{tag}>\n")]
    return rows.withColumn("xml", F.concat(*parts, F.lit("  </url>")))


def site_manifest(categories, profiles, sources, translations, language: str = "de") -> DataFrame:
    """path, kind and title of every page the site consists of."""
    live = profiles.where("published").join(sources.select("source_id", "category_id"), "source_id")
    named = categories.where("is_active")
    fixed = [("index.html", "home"), ("suche.html", "search"), ("impressum.html", "imprint"), ("api.html", "api")]
    root, text = "", F.col("markdown_content")
    label = F.col("display_name")
    if language == "en":
        root = "en/"
        fixed = [("index.html", "home"), ("search.html", "search"), ("imprint.html", "imprint"), ("api.html", "api")]
        live = live.join(translations.where("language = 'en'").select("profile_id", F.col("markdown_content").alias("_t")), "profile_id")
        text, label = F.col("_t"), F.coalesce("display_name_en", "display_name")
        named = named.join(live.select("category_id").distinct(), "category_id", "left_semi")
    cats = named.select(F.concat(F.lit(root), "internal_name", F.lit("/index.html")).alias("path"), F.lit("category").alias("kind"), label.alias("title"))
    pages = live.select(
        F.concat(F.lit(root + "details/"), F.col("source_id").cast("string"), F.lit(".html")).alias("path"), F.lit("detail").alias("kind"),
        md.profile_title(text).alias("title"))
    return reduce(DataFrame.unionByName, [_one(categories, path=root + p, kind=k, title=k) for p, k in fixed] + [cats, pages])


def generation_stats(manifest: DataFrame, profiles: DataFrame) -> DataFrame:
    """pages, categories, profiles, published profiles left out, and pages in error: those without a title."""
    pages = manifest.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("kind") == "category").alias("categories"), F.count_if(F.col("kind") == "detail").alias("profiles"),
        F.count_if(F.coalesce(F.col("title"), F.lit("")) == "").alias("errors"))
    live = profiles.where("published").agg(F.count(F.lit(1)).alias("_live"))
    joined = attach_row(pages, live)
    return joined.select("pages", "categories", "profiles", (F.col("_live") - F.col("profiles")).alias("skipped"), "errors")


def structured_data(profiles: DataFrame, base: str) -> DataFrame:
    """schema.org Article record of each published profile.

    ``profiles`` carries html_content next to the Markdown.
    """
    published = F.date_format(F.coalesce("published_at", "generated_at"), "yyyy-MM-dd'T'HH:mm:ss")
    maker = F.coalesce(F.nullif(md.profile_institution(F.col("markdown_content")), F.lit("")), F.lit("Hochschule"))
    record = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Article").alias("@type"),
        md.profile_title(F.col("markdown_content")).alias("headline"),
        F.substring(tx.strip_tags(F.col("html_content")), 1, 200).alias("description"),
        F.concat(F.lit(base + "/details/"), F.col("source_id").cast("string"), F.lit(".html")).alias("url"),
        published.alias("datePublished"), F.struct(F.lit("Organization").alias("@type"), maker.alias("name")).alias("author"))
    return profiles.where("published").select("source_id", F.to_json(record).alias("json"))


def record_json(extractions, prompts, sources, categories) -> DataFrame:
    """Extraction rows as JSON with nested source, category and prompt."""
    c = categories.select("category_id", F.struct("category_id", "internal_name", "display_name").alias("_category"))
    s = sources.join(c, "category_id", "left").select(
        "source_id", F.struct("source_id", "url", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.col("_category").alias("category")).alias("source"))
    p = prompts.select("prompt_id", F.struct("prompt_id", "internal_name", "field_group").alias("prompt"))
    rows = extractions.join(s, "source_id").join(p, "prompt_id")
    body = F.struct("extraction_id", "validated_result", "final_confidence", F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"), "source", "prompt")
    return rows.select("extraction_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
