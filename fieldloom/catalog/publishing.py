"""Profile, index and site queries."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.functions import filters, markdown as md, render, text as tx, web
from fieldloom.operators import publishing as p, records as r
from fieldloom.plans.order import places

_INST = """coalesce(list_filter(list_transform(list_filter(string_split({md}, chr(10))[1:{n}], lambda x: contains(x, 'Institution') AND contains(x, ':')),
    lambda x: {unlink}trim(regexp_replace(trim(regexp_replace(x, '^[^:]*:', '')), '\\*+', '', 'g')){close}), lambda v: v <> '' AND v <> '-' AND v <> 'Nicht angegeben')[1], '')"""


def _inst(text: str, n: int, unlink: bool = False) -> str:
    close = ", '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')" if unlink else ""
    return _INST.replace("{md}", text).replace("{n}", str(n)).replace("{unlink}", "regexp_replace(" if unlink else "").replace("{close}", close)


def _title(text: str) -> str:
    line = f"split_part({text}, chr(10), 1)"
    return f"CASE WHEN {line} LIKE '#%' THEN trim(ltrim({line}, '#')) ELSE 'Untitled' END"


def _description(text: str) -> str:
    return f"""(SELECT CASE WHEN length(d) > 300 THEN substr(d, 1, 297) || '...' ELSE d END FROM (SELECT array_to_string(list_filter(list_transform(body, lambda x: trim(x)), lambda x: x <> ''), ' ') AS d
      FROM (SELECT CASE WHEN stop > 0 THEN tail[1:stop - 1] ELSE tail END AS body FROM (SELECT tail, coalesce(list_position(list_transform(tail, lambda x: starts_with(x, '##')), true), 0) AS stop
      FROM (SELECT CASE WHEN place > 0 THEN lines[place + 1:] ELSE []::VARCHAR[] END AS tail FROM (SELECT lines, coalesce(list_position(list_transform(lines, lambda x: lower(trim(x)) IN ('## beschreibung', '## description')), true), 0) AS place
      FROM (SELECT string_split({text}, chr(10)) AS lines)))))))"""


def _clean(text: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace({text}, '#', ''), '*', ''), '`', ''), '[\\s]+', ' ', 'g'))"


def _categories(t):
    return t.fx_category.withColumn("active_groups", F.split("group_list", ","))


def _map_text(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query("profile_titles", f"""SELECT profile_id, {_title('markdown_content')} AS title,
    CASE WHEN markdown_content LIKE '#%' THEN trim(ltrim(split_part(markdown_content, chr(10), 1), '#')) ELSE coalesce(nullif(trim(split_part(markdown_content, chr(10), 1)), ''), 'Untitled') END AS index_title FROM fx_profile""")
def profile_titles(t):
    text = F.col("markdown_content")
    return t.fx_profile.select("profile_id", md.profile_title(text).alias("title"), md.profile_title(text, first_line=True).alias("index_title"))


@query("profile_institutions", f"""SELECT profile_id, {_inst('markdown_content', 15)} AS listed, {_inst('markdown_content', 20, True)} AS english,
    CASE WHEN raw IN ('-', 'Nicht angegeben') THEN '' ELSE raw END AS admin FROM (SELECT *, coalesce(list_transform(list_filter(string_split(markdown_content, chr(10))[1:15],
        lambda x: contains(x, 'Institution') AND contains(x, ':')), lambda x: trim(regexp_replace(trim(regexp_replace(x, '^[^:]*:', '')), '\\*+', '', 'g')))[1], '') AS raw FROM fx_profile)""")
def profile_institutions(t):
    text = F.col("markdown_content")
    return t.fx_profile.select(
        "profile_id", md.profile_institution(text).alias("listed"), md.profile_institution(text, lines=20, unlink=True).alias("english"),
        md.profile_institution(text, stop=True).alias("admin"))


@query("section_descriptions", f"SELECT profile_id, {_description('markdown_content')} AS description FROM fx_profile")
def section_descriptions(t):
    return t.fx_profile.select("profile_id", md.section_description(F.col("markdown_content")).alias("description"))


_BARE = "regexp_replace(regexp_replace(trim(x), '\\*+', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
_IS_HEAD = "regexp_matches(x, '(?i)^##\\s*(Beschreibung|Description|Kurzbeschreibung)')"
_IS_FACT = "(contains(x, ':') AND regexp_matches(x, 'Institution|URL|Datum|Status|Kategorie'))"


_TEASERS = f"""SELECT profile_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substring(t, 1, 197), ' [^ ]*$', '') || '...' END AS teaser FROM (
    SELECT profile_id, array_to_string(list_filter(list_transform(CASE WHEN len(s) > 0 THEN s ELSE f END, lambda x: {_BARE}), lambda x: x <> ''), ' ') AS t FROM (
    SELECT *, list_filter(list_concat(list_filter(lines[:gap - 1], lambda x: NOT starts_with(x, '#')), rest[:coalesce(nullif(list_position(list_transform(rest, lambda x: starts_with(x, '##') AND NOT {_IS_FACT}), true), 0) - 1, len(rest))]),
        lambda x: NOT {_IS_FACT}) AS f,
      list_filter(tail[:coalesce(nullif(list_position(list_transform(tail, lambda x: starts_with(x, '##') AND NOT {_IS_HEAD}), true), 0) - 1, len(tail))], lambda x: NOT {_IS_HEAD} AND {_BARE} <> '') AS s FROM (
    SELECT *, lines[gap + 1:] AS rest, CASE WHEN start > 0 THEN lines[start + 1:] ELSE [] END AS tail FROM (
    SELECT *, coalesce(nullif(list_position(list_transform(lines, lambda x: trim(x) = ''), true), 0), len(lines) + 1) AS gap, coalesce(list_position(list_transform(lines, lambda x: {_IS_HEAD}), true), 0) AS start
    FROM (SELECT profile_id, string_split(coalesce(markdown_content, ''), chr(10)) AS lines FROM fx_profile)))))"""


@query("profile_teasers", _TEASERS)
def profile_teasers(t):
    return t.fx_profile.select("profile_id", md.teaser("markdown_content").alias("teaser"))


@query("cleaned_markdown", f"SELECT profile_id, {_clean('markdown_content')} AS text FROM fx_profile")
def cleaned_markdown(t):
    return t.fx_profile.select("profile_id", md.clean_markdown(F.col("markdown_content")).alias("text"))


_LINKED = """SELECT profile_id, array_to_string(list_transform(string_split(markdown_content, chr(10)), lambda x:
    CASE WHEN regexp_matches(x, '^(\\*\\*Institution:\\*\\*|\\*\\*Institution\\*\\*:|Institution:)\\s*.', 'i') AND trim(regexp_replace(x, '^[^ ]* *', '')) NOT IN ('-', '')
    THEN regexp_extract(x, '^([^ ]* *)', 1) || '[' || trim(regexp_replace(x, '^[^ ]* *', '')) || '](/kb/suche.html?q=' || replace(url_encode(trim(regexp_replace(x, '^[^ ]* *', ''))), '%2F', '/') || ')' ELSE x END), chr(10)) AS markdown_content FROM fx_profile"""


@query("linked_institutions", _LINKED)
def linked_institutions(t):
    return t.fx_profile.select("profile_id", md.linkify_institutions(F.col("markdown_content"), "/kb").alias("markdown_content"))


@query("template_filters", f"""SELECT profile_id, {_title('markdown_content')} AS title, {_inst('markdown_content', 15)} AS institution, regexp_replace(markdown_content, '<[^>]+>', '', 'g') AS plain FROM fx_profile""")
def template_filters(t):
    filters.register_filters(t.spark)
    return t.fx_profile.selectExpr("profile_id", "get_title(markdown_content) AS title", "get_institution(markdown_content) AS institution", "striptags(markdown_content) AS plain")


@query("more_template_filters", f"""SELECT profile_id, {_title('p.markdown_content')} AS title, l.markdown_content AS linked, teaser, strftime(generated_at, '%d.%m.%Y') AS day
    FROM fx_profile p JOIN ({_LINKED}) l USING (profile_id) JOIN ({_TEASERS}) USING (profile_id)""")
def more_template_filters(t):
    filters.register_filters(t.spark)
    stamp = "date_format(generated_at, \"yyyy-MM-dd'T'HH:mm:ss\")"
    return t.fx_profile.selectExpr(
        "profile_id", "title_with_institution(markdown_content) AS title", "linkify_institutions(markdown_content, '/kb') AS linked",
        "get_description(markdown_content) AS teaser", f"date_text({stamp}, 'dd.MM.yyyy') AS day")


@query("profile_html")
def profile_html(t):
    return t.fx_profile.select("profile_id", render.markdown_to_html("markdown_content").alias("html_content"))


@query("stripped_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def stripped_tags(t):
    return t.pages.select("page_id", tx.strip_tags(F.col("html")).alias("text"))


_DATES = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2024-03-05T10:11:12Z' WHEN 2 THEN '2024-02-30' WHEN 3 THEN 'soon' WHEN 4 THEN NULL
    ELSE 'Now' END AS raw, user_id FROM {events}"""


@query("formatted_dates", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '05.03.2024' WHEN 1 THEN '05.03.2024' WHEN 2 THEN '2024-02-30' WHEN 3 THEN 'soon' WHEN 4 THEN '' ELSE '09.07.2024' END AS shown,
    CASE event_id % 6 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2024-03-05 10:11:12' WHEN 2 THEN '2024-02-30' WHEN 3 THEN 'soon' WHEN 4 THEN 'N/A' ELSE 'Now' END AS admin FROM events""")
def formatted_dates(t):
    now = F.expr("TIMESTAMP_NTZ '2024-07-09 08:00:00'")
    return t.sql(_DATES).select("event_id", md.format_date(F.col("raw"), now).alias("shown"), md.admin_date(F.col("raw")).alias("admin"))


_V = "trim(coalesce(nullif(validated_result, ''), nullif(raw_result, '')))"
_VEN = "trim(coalesce(nullif(validated_result_en, ''), nullif(validated_result, ''), nullif(raw_result, '')))"


@query("language_values", f"SELECT extraction_id, nullif({_V}, '') AS german, nullif({_VEN}, '') AS english FROM fx_extraction")
def language_values(t):
    return t.fx_extraction.select("extraction_id", md.value_for_language("de").alias("german"), md.value_for_language("en").alias("english"))


def _field_rows(value: str) -> str:
    return f"""SELECT e.source_id, f.internal_name, {value} AS v FROM fx_extraction e JOIN fx_prompt f USING (prompt_id) JOIN fx_source s ON s.source_id = e.source_id
      JOIN fx_category c ON c.category_id = s.category_id WHERE e.final_confidence >= f.required_confidence AND list_contains(string_split(c.group_list, ','), f.field_group) AND {value} <> ''"""


@query("field_values", f"SELECT source_id, string_agg(internal_name || '=' || v, ';' ORDER BY internal_name) AS fields FROM ({_field_rows(_VEN)}) GROUP BY source_id")
def field_values(t):
    out = p.field_values(t.fx_extraction, t.fx_prompt, t.fx_source, _categories(t), "en")
    return out.select("source_id", _map_text("values").alias("fields"))


@query("detail_context", """SELECT source_id, string_agg(internal_name || '=' || validated_result || '|' || CAST(final_confidence AS VARCHAR) || '|' || display_name, ';' ORDER BY internal_name) AS fields
    FROM fx_extraction JOIN fx_prompt USING (prompt_id) WHERE trim(coalesce(validated_result, '')) <> '' AND final_confidence >= required_confidence GROUP BY source_id""")
def detail_context(t):
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.lit("|"), e["value"]["confidence"].cast("string"), F.lit("|"), e["value"]["display_name"])
    out = p.detail_context(t.fx_extraction, t.fx_prompt)
    return out.select("source_id", F.array_join(F.transform(F.map_entries("fields"), entry), ";").alias("fields"))


@query("rendered_profiles", f"""SELECT s.source_id, '# ' || coalesce(a, '-') || chr(10) || chr(10) || '**Institution:** ' || coalesce(b, '-') || chr(10) || chr(10) || '## Beschreibung' || chr(10)
    || coalesce(d, '-') || ' costs $5, -' || chr(10) || s.url || ' (' || strftime(coalesce(s.crawled_at, TIMESTAMP '2024-06-01 00:00:00'), '%Y-%m-%d') || ')' AS markdown_content
    FROM fx_source s JOIN fx_category c ON c.category_id = s.category_id LEFT JOIN (SELECT source_id, max(v) FILTER (internal_name = 'project_name') AS a,
      max(v) FILTER (internal_name = 'institution') AS b, max(v) FILTER (internal_name = 'short_description') AS d FROM ({_field_rows(_V)}) GROUP BY source_id) x ON x.source_id = s.source_id""")
def rendered_profiles(t):
    return p.render_profiles(t.fx_extraction, t.fx_prompt, t.fx_source, _categories(t), F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))


@query("fallback_profiles", f"""SELECT s.source_id, '# ' || coalesce(max(v) FILTER (internal_name = 'project_name'), 'Unbenanntes Projekt') || chr(10) || chr(10) || '**URL:** ' || any_value(s.url) || chr(10)
    || coalesce(string_agg(chr(10) || '**' || CASE internal_name WHEN 'institution' THEN 'Institution' WHEN 'short_description' THEN 'Short Description' WHEN 'keywords' THEN 'Keywords'
         WHEN 'funding_body' THEN 'Funding Body' WHEN 'goals' THEN 'Goals' ELSE 'Contact Email' END || ':** ' || v || chr(10), '' ORDER BY internal_name) FILTER (internal_name <> 'project_name'), '') AS markdown_content
    FROM fx_source s LEFT JOIN ({_field_rows(_V)}) x ON x.source_id = s.source_id WHERE s.category_id IS NOT NULL GROUP BY s.source_id""")
def fallback_profiles(t):
    bare = _categories(t).withColumn("template", F.lit(""))
    return p.render_profiles(t.fx_extraction, t.fx_prompt, t.fx_source, bare, F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'"))


_VALUES = """SELECT source_id, prompt_id, internal_name, trim(validated_result) AS v FROM fx_extraction JOIN fx_prompt USING (prompt_id) WHERE trim(coalesce(validated_result, '')) <> ''"""
_PIVOT = f"""SELECT source_id, max(v) FILTER (internal_name = 'project_name') AS title, max(v) FILTER (internal_name = 'institution') AS institution,
    substr(max(v) FILTER (internal_name = 'short_description'), 1, 300) AS description, list(v ORDER BY prompt_id) AS parts FROM ({_VALUES}) GROUP BY source_id"""


@query("record_pivot", f"SELECT source_id, title, institution, description, array_to_string(parts, '|') AS parts FROM ({_PIVOT})")
def record_pivot(t):
    return p.record_pivot(t.fx_extraction, t.fx_prompt).withColumn("parts", F.array_join("parts", "|"))


_NAMES = """SELECT source_id, list(name ORDER BY kind, entity_id, name) AS names FROM (SELECT DISTINCT source_id, linked_entity_id AS entity_id FROM fx_extraction
    WHERE linked_entity_id IS NOT NULL AND trim(coalesce(validated_result, '')) <> '') JOIN (SELECT entity_id, 0 AS kind, variant_name AS name FROM fx_variant
    UNION ALL SELECT entity_id, 1, canonical_name FROM fx_entity) USING (entity_id) GROUP BY source_id"""


@query("index_variants", f"SELECT source_id, array_to_string(names, '|') AS entity_variants FROM ({_NAMES})")
def index_variants(t):
    return p.index_variants(t.fx_extraction, t.fx_entity, t.fx_variant).withColumn("entity_variants", F.array_join("entity_variants", "|"))


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query("index_items", f"""SELECT CAST(source_id AS VARCHAR) AS id, title, coalesce(description, '') AS description, CASE WHEN institution IN ('-', 'Nicht angegeben') THEN '' ELSE coalesce(institution, '') END AS institution,
    category, category_key AS category_id, '/kb/details/' || source_id || '.html' AS url, substr(array_to_string({_DISTINCT.format('pieces')}, ' '), 1, 5000) AS fulltext, array_to_string(names, '|') AS entity_variants
    FROM (SELECT d.source_id, c.display_name AS category, c.internal_name AS category_key, x.institution, x.description, n.names,
      coalesce(x.title, CASE WHEN d.markdown_content LIKE '#%' THEN trim(ltrim(split_part(d.markdown_content, chr(10), 1), '#')) ELSE coalesce(nullif(trim(split_part(d.markdown_content, chr(10), 1)), ''), 'Untitled') END) AS title,
      list_concat(coalesce(x.parts, []), CASE WHEN d.markdown_content <> '' THEN [{_clean('d.markdown_content')}] ELSE [] END, coalesce(n.names, [])) AS pieces
      FROM fx_profile d JOIN fx_source s USING (source_id) JOIN fx_category c USING (category_id) LEFT JOIN ({_PIVOT}) x ON x.source_id = d.source_id LEFT JOIN ({_NAMES}) n ON n.source_id = d.source_id WHERE d.published)
    WHERE title <> ''""".replace("array_to_string(names, '|')", "coalesce(array_to_string(names, '|'), '')"))
def index_items(t):
    out = p.index_items(t.fx_profile, t.fx_extraction, t.fx_prompt, t.fx_source, t.fx_category, t.fx_entity, t.fx_variant, "/kb")
    return out.withColumn("entity_variants", F.array_join("entity_variants", "|"))


@query("english_index_items", f"""SELECT CAST(d.source_id AS VARCHAR) AS id, {_title('m')} AS title, {_inst('m', 20, True)} AS institution, {_description('m')} AS description, coalesce(c.display_name_en, c.display_name) AS category,
    c.internal_name AS category_id, 'details/' || d.source_id || '.html' AS url, strftime(d.generated_at, '%Y-%m-%d') AS date, substr({_clean('m')}, 1, 5000) AS fulltext
    FROM fx_profile d JOIN (SELECT profile_id, markdown_content AS m FROM fx_translation) x USING (profile_id) JOIN fx_source s USING (source_id) JOIN fx_category c USING (category_id) WHERE d.published""")
def english_index_items(t):
    return p.english_index_items(t.fx_profile, t.fx_translation, t.fx_source, t.fx_category).drop("entity_variants")


@query("profile_summary", """SELECT d.profile_id, d.source_id, s.url AS source_url, coalesce(x.title, 'Untitled') AS title, coalesce(c.display_name, 'Unknown') AS category, x.institution,
    substr(nullif(x.d, ''), 1, 200) AS short_description, d.published_at FROM fx_profile d JOIN fx_source s USING (source_id) LEFT JOIN fx_category c ON c.category_id = s.category_id
    LEFT JOIN (SELECT source_id, max(validated_result) FILTER (internal_name = 'project_name' AND validated_result <> '') AS title, max(validated_result) FILTER (internal_name = 'institution') AS institution,
      max(validated_result) FILTER (internal_name = 'short_description') AS d FROM fx_extraction JOIN fx_prompt USING (prompt_id) GROUP BY source_id) x ON x.source_id = d.source_id WHERE d.published""")
def profile_summary(t):
    return p.profile_summary(t.fx_profile, t.fx_extraction, t.fx_prompt, t.fx_source, t.fx_category)


@query("api_index_items", """SELECT d.source_id AS id, coalesce(a, 'Untitled') AS title, substr(coalesce(e, ''), 1, 300) AS description, coalesce(c.display_name, 'Unknown') AS category, coalesce(b, '') AS institution, s.url,
    coalesce(a, 'Untitled') || ' ' || coalesce(b, '') || ' ' || coalesce(e, '') || ' ' || coalesce(c.display_name, '') AS relevance_text
    FROM fx_profile d JOIN fx_source s USING (source_id) LEFT JOIN fx_category c ON c.category_id = s.category_id LEFT JOIN (SELECT source_id, max(validated_result) FILTER (internal_name = 'project_name') AS a,
      max(validated_result) FILTER (internal_name = 'institution') AS b, max(validated_result) FILTER (internal_name = 'short_description') AS e FROM fx_extraction JOIN fx_prompt USING (prompt_id)
      WHERE validated_result <> '' AND final_confidence > 0 AND final_confidence >= required_confidence GROUP BY source_id) x ON x.source_id = d.source_id WHERE d.published""")
def api_index_items(t):
    return p.api_index_items(t.fx_profile, t.fx_extraction, t.fx_prompt, t.fx_source, t.fx_category)


@query("content_hashes", "SELECT profile_id, sha256(CASE WHEN profile_id % 5 = 0 THEN '' ELSE markdown_content END) AS hash FROM fx_profile")
def content_hashes(t):
    return t.fx_profile.select("profile_id", r.content_hash(F.when(F.col("profile_id") % 5 != 0, F.col("markdown_content"))).alias("hash"))


@query("latest_profiles", "SELECT profile_id, source_id, generated_at FROM fx_profile WHERE published ORDER BY generated_at DESC, profile_id LIMIT 6")
def latest_profiles(t):
    return p.latest_profiles(t.fx_profile).select("profile_id", "source_id", "generated_at")


@query("category_listing", f"SELECT category_id, profile_id, {_title('d.markdown_content')} AS title, generated_at FROM fx_profile d JOIN (SELECT source_id, category_id FROM fx_source) USING (source_id) WHERE published")
def category_listing(t):
    return p.category_listing(t.fx_profile, t.fx_source, "title").select("category_id", "profile_id", "title", "generated_at")


def _placed(order: str) -> str:
    return f"""SELECT category_id, profile_id, row_number() OVER (PARTITION BY category_id ORDER BY generated_at {order}, profile_id) AS place
        FROM fx_profile JOIN (SELECT source_id, category_id FROM fx_source) USING (source_id) WHERE published"""


def _listed(t, order: str):
    """Place of each profile in its category's list, read from the order of the listing."""
    return places(p.category_listing(t.fx_profile, t.fx_source, order).select("category_id", "profile_id"), "category_id")


@query("newest_listing", _placed("DESC"))
def newest_listing(t):
    return _listed(t, "newest")


@query("oldest_listing", _placed("ASC"))
def oldest_listing(t):
    return _listed(t, "oldest")


# Titles of their own: whole first lines, some with umlauts, accents and signs in front.
_LOCAL = "substr('ÄäZzéeÖo-1 aßsüU', CAST(doc_id % 17 AS INT) + 1, 1) || substr('bcÄd', CAST(doc_id % 4 AS INT) + 1, 1) || ' ' || text"
_LOCAL_SQL = f"SELECT doc_id AS profile_id, doc_id % 5 AS category_id, trim(split_part({_LOCAL}, chr(10), 1)) AS title FROM documents WHERE text IS NOT NULL"


@query("title_listing", f"""SELECT category_id, profile_id, title, row_number() OVER (PARTITION BY category_id ORDER BY lower(title) COLLATE de, profile_id) AS place FROM ({_LOCAL_SQL})""")
def title_listing(t):
    """Place of each title in the reading order of its category."""
    docs = t.documents.where("text IS NOT NULL")
    profiles = docs.select(F.col("doc_id").alias("profile_id"), F.col("doc_id").alias("source_id"), F.lit(True).alias("published"),
                           F.concat(F.lit("# "), F.expr(_LOCAL)).alias("markdown_content"))
    sources = docs.select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 5).alias("category_id"))
    return places(p.category_listing(profiles, sources, "title").select("category_id", "profile_id", "title"), "category_id")


@query("institution_filter", f"""SELECT profile_id, institution FROM (SELECT profile_id, {_inst('markdown_content', 20, True)} AS institution FROM fx_profile)
    WHERE institution = (SELECT min(institution) FROM (SELECT {_inst('markdown_content', 20, True)} AS institution FROM fx_profile) WHERE institution <> '' AND contains('Inst 1 of somewhere', institution))""")
def institution_filter(t):
    items = t.fx_profile.select("profile_id", md.profile_institution(F.col("markdown_content"), lines=20, unlink=True).alias("institution"))
    return p.institution_filter(items, "Inst 1 of somewhere")


@query("entity_index", """SELECT CASE WHEN entity_type = 'university' THEN 'institutions' ELSE 'other' END AS section, entity_id AS id, canonical_name AS name, entity_type AS type,
    coalesce(names, '') AS variants, canonical_name || coalesce('|' || names, '') AS search_terms FROM fx_entity
    LEFT JOIN (SELECT entity_id, string_agg(variant_name, '|' ORDER BY variant_name) AS names FROM fx_variant GROUP BY entity_id) USING (entity_id)""")
def entity_index(t):
    out = p.entity_index(t.fx_entity, t.fx_variant)
    return out.withColumn("variants", F.array_join("variants", "|")).withColumn("search_terms", F.array_join("search_terms", "|"))


@query("sitemap", """SELECT loc, lastmod, changefreq, priority, '  <url>' || chr(10) || '    <loc>' || loc || '</loc>' || chr(10) || '    <lastmod>' || lastmod || '</lastmod>' || chr(10)
    || '    <changefreq>' || changefreq || '</changefreq>' || chr(10) || '    <priority>' || priority || '</priority>' || chr(10) || '  </url>' AS xml FROM (
    SELECT 'https://kb.example.org/' AS loc, '2024-06-01' AS lastmod, 'daily' AS changefreq, '1.0' AS priority UNION ALL SELECT 'https://kb.example.org/suche.html', '2024-06-01', 'weekly', '0.7'
    UNION ALL SELECT 'https://kb.example.org/' || internal_name || '/', '2024-06-01', 'daily', '0.8' FROM fx_category WHERE is_active
    UNION ALL SELECT 'https://kb.example.org/details/' || source_id || '.html', strftime(generated_at, '%Y-%m-%d'), 'weekly', '0.6' FROM fx_profile WHERE published)""")
def sitemap(t):
    return p.sitemap(t.fx_category, t.fx_profile, "https://kb.example.org", "2024-06-01")


_MANIFEST = f"""SELECT 'en/index.html' AS path, 'home' AS kind, 'home' AS title UNION ALL SELECT 'en/search.html', 'search', 'search' UNION ALL SELECT 'en/imprint.html', 'imprint', 'imprint'
    UNION ALL SELECT 'en/api.html', 'api', 'api' UNION ALL SELECT 'en/details/' || d.source_id || '.html', 'detail', {_title('x.markdown_content')} FROM fx_profile d JOIN fx_translation x USING (profile_id)
      JOIN fx_source s USING (source_id) WHERE d.published
    UNION ALL SELECT 'en/' || internal_name || '/index.html', 'category', coalesce(display_name_en, display_name) FROM fx_category WHERE is_active AND category_id IN (
      SELECT category_id FROM fx_source JOIN fx_profile USING (source_id) JOIN fx_translation USING (profile_id) WHERE published)"""


def _manifest(t):
    return p.site_manifest(t.fx_category, t.fx_profile, t.fx_source, t.fx_translation, "en")


@query("site_manifest", _MANIFEST)
def site_manifest(t):
    return _manifest(t)


@query("original_manifest", f"""SELECT * FROM (VALUES ('index.html', 'home', 'home'), ('suche.html', 'search', 'search'), ('impressum.html', 'imprint', 'imprint'), ('api.html', 'api', 'api')) m(path, kind, title)
    UNION ALL SELECT internal_name || '/index.html', 'category', display_name FROM fx_category WHERE is_active
    UNION ALL SELECT 'details/' || source_id || '.html', 'detail', {_title('markdown_content')} FROM fx_profile JOIN (SELECT source_id FROM fx_source) USING (source_id) WHERE published""")
def original_manifest(t):
    return p.site_manifest(t.fx_category, t.fx_profile, t.fx_source, t.fx_translation)


@query("generation_stats", f"""SELECT count(*) AS pages, count(*) FILTER (kind = 'category') AS categories, count(*) FILTER (kind = 'detail') AS profiles,
    (SELECT count(*) FROM fx_profile WHERE published) - count(*) FILTER (kind = 'detail') AS skipped, count(*) FILTER (coalesce(title, '') = '') AS errors FROM ({_MANIFEST})""")
def generation_stats(t):
    return p.generation_stats(_manifest(t), t.fx_profile)


@query("structured_data", f"""SELECT source_id, CAST(to_json({{'@context': 'https://schema.org', '@type': 'Article', 'headline': {_title('markdown_content')}, 'description': substr(regexp_replace(html, '<[^>]+>', '', 'g'), 1, 200),
    'url': 'https://kb.example.org/details/' || source_id || '.html', 'datePublished': strftime(coalesce(published_at, generated_at), '%Y-%m-%dT%H:%M:%S'),
    'author': {{'@type': 'Organization', 'name': coalesce(nullif({_inst('markdown_content', 15)}, ''), 'Hochschule')}}}}) AS VARCHAR) AS json
    FROM (SELECT *, '<p class="x">' || replace(markdown_content, chr(10), '<br>') || '</p>' AS html FROM fx_profile) WHERE published""")
def structured_data(t):
    rows = t.fx_profile.withColumn("html_content", F.expr("""'<p class="x">' || replace(markdown_content, chr(10), '<br>') || '</p>'"""))
    return p.structured_data(rows, "https://kb.example.org")


@query("record_json", """SELECT extraction_id, CAST(to_json({'extraction_id': extraction_id, 'validated_result': validated_result, 'final_confidence': final_confidence, 'extracted_at': strftime(extracted_at, '%Y-%m-%dT%H:%M:%S'),
    'source': {'source_id': s.source_id, 'url': s.url, 'status': s.status, 'created_at': strftime(s.created_at, '%Y-%m-%dT%H:%M:%S'),
      'category': CASE WHEN c.category_id IS NOT NULL THEN {'category_id': c.category_id, 'internal_name': c.internal_name, 'display_name': c.display_name} END},
    'prompt': {'prompt_id': f.prompt_id, 'internal_name': f.internal_name, 'field_group': f.field_group}}) AS VARCHAR) AS json
    FROM fx_extraction e JOIN fx_source s USING (source_id) JOIN fx_prompt f ON f.prompt_id = e.prompt_id LEFT JOIN fx_category c ON c.category_id = s.category_id""")
def record_json(t):
    return p.record_json(t.fx_extraction, t.fx_prompt, t.fx_source, t.fx_category)


@query("site_urls", """SELECT page_id, CASE WHEN prefix = '' OR starts_with(path, prefix) THEN path WHEN path LIKE '/%' THEN prefix || path ELSE prefix || '/' || path END AS url,
    CASE WHEN page_id % 2 = 0 THEN 'search.html' ELSE 'suche.html' END AS search FROM (
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/kb' ELSE '/kb/en' END AS prefix, CASE page_id % 4 WHEN 0 THEN '/kb' || href WHEN 1 THEN substr(href, 2) ELSE href END AS path FROM fx_link)""")
def site_urls(t):
    prefix = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "/kb").otherwise("/kb/en")
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/kb"), "href")).when(F.col("page_id") % 4 == 1, F.expr("substr(href, 2)")).otherwise(F.col("href"))
    language = F.when(F.col("page_id") % 2 == 0, "en").otherwise("de")
    return t.fx_link.select("page_id", web.site_url(prefix, path).alias("url"), web.search_page(language).alias("search"))
