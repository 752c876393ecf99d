"""Search queries over whole documents."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.functions import text as tx
from fieldloom.operators import search as s
from fieldloom.operators.grams import GramIndex
from fieldloom.streaming.sinks import work_folder

_ITEMS = """SELECT CAST(doc_id AS STRING) AS id, 'Profile ' || lang || CAST(doc_id AS STRING) AS title, lang || ' from ' || source AS description,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Inst ' || CAST(doc_id % 20 AS STRING) END AS institution, 'Group ' || CAST(doc_id % 5 AS STRING) AS category,
    'g' || CAST(doc_id % 5 AS STRING) AS category_id, text AS fulltext, split('SUP-' || CAST(doc_id % 100 AS STRING) || '|S' || CAST(doc_id % 3 AS STRING), '[|]') AS entity_variants FROM {documents}"""
_ITEMS_SQL = _ITEMS.replace("{documents}", "documents").replace("'[|]'", "'|'").replace("split(", "string_split(")
_LOW = f"""low AS (SELECT *, lower(title) AS t, lower(description) AS d, lower(institution) AS i, lower(category) AS c, lower(fulltext) AS f, lower(array_to_string(entity_variants, ' ')) AS v FROM ({_ITEMS_SQL}))"""
_TERM_POINTS = """(CASE WHEN contains(t, x) THEN 10 ELSE 0 END + CASE WHEN t = x THEN 20 ELSE 0 END + CASE WHEN starts_with(t, x) THEN 5 ELSE 0 END + CASE WHEN contains(i, x) THEN 8 ELSE 0 END
    + CASE WHEN contains(v, x) THEN 7 ELSE 0 END + CASE WHEN contains(d, x) THEN 3 ELSE 0 END + CASE WHEN contains(f, x) THEN 1 ELSE 0 END)"""
_ALL_TEXT = "t || ' ' || d || ' ' || i || ' ' || c || ' ' || f || ' ' || v"


def _found(terms: list[str], where: str = "true") -> str:
    points = " + ".join(_TERM_POINTS.replace(" x)", f" '{w}')").replace("= x ", f"= '{w}' ") for w in terms)
    tests = " AND ".join(f"contains({_ALL_TEXT}, '{w}')" for w in terms)
    return f"SELECT id, title, {points} AS relevance FROM low WHERE {where} AND {tests}"


def _items(t):
    return t.sql(_ITEMS)


@query("search", _found(["profile", "inst", "1"], "category_id IN ('g1', 'g3')"), _LOW)
def search(t):
    return s.search(_items(t), "Profile  inst 1", ["g1", "g3"]).select("id", "title", "relevance")


@query("search_variants", _found(["sup-7", "s1"]), _LOW)
def search_variants(t):
    return s.ordered(s.search(_items(t), "SUP-7 s1"), "SUP-7 s1").select("id", "title", "relevance")


@query("search_everything", "SELECT id, title, 50 AS relevance FROM low", _LOW)
def search_everything(t):
    return s.ordered(s.search(_items(t), "  "), "  ").select("id", "title", "relevance")


@query("search_percent", f"SELECT id, relevance, CAST(floor(relevance * 100 / (SELECT max(relevance) FROM ({_found(['inst', 'the'])})) + 0.5) AS INTEGER) AS percent FROM ({_found(['inst', 'the'])})", _LOW)
def search_percent(t):
    return s.relevance_percent(s.search(_items(t), "Inst the")).select("id", "relevance", "percent")


# Whole benchmark texts, and shorter queries as extra rows.
_QUERIES = """SELECT item_id AS query_id, text AS query FROM {benchmark}
    UNION ALL SELECT 1000000 + item_id, split_part(text, ' ', 3) || '  ' || split_part(text, ' ', 5) FROM {benchmark}
    UNION ALL SELECT 2000000, '  ' UNION ALL SELECT 2000001, 'inst Inst profile' UNION ALL SELECT 2000002, 'sup-7 no-such-word'"""
_BATCH = f"""WITH_Q SELECT query_id, id, CAST(list_sum(list_transform(w, lambda x: {_TERM_POINTS})) AS BIGINT) AS relevance FROM (SELECT query_id, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') AS w FROM ({_QUERIES.replace('{benchmark}', 'benchmark')})) q JOIN low
    ON len(w) > 0 AND len(list_filter(w, lambda x: NOT contains({_ALL_TEXT}, x))) = 0
    UNION ALL SELECT 2000000, NULL, 50""".replace("WITH_Q ", "")


@query("batch_search", _BATCH, _LOW)
def batch_search(t):
    return s.batch_search(_items(t), t.sql(_QUERIES))


@query("indexed_search", _BATCH, _LOW)
def indexed_search(t):
    """The same queries on a stored index whose second update replaces texts and takes items out."""
    items = t.sql(_ITEMS).join(t.documents.select(F.col("doc_id").cast("string").alias("id"), "lang"), "id")
    later = F.col("lang") == "de"
    state = lambda rows, version, live: rows.select("*", F.lit(version).alias("version"), F.lit(live).alias("live"))
    before = items.withColumn("fulltext", F.when(later, F.reverse("fulltext")).otherwise(F.col("fulltext")))
    extra = items.where(F.col("lang") == "en").withColumn("id", F.concat(F.lit("x"), "id"))
    index = GramIndex(t.spark, f"{work_folder(t.spark)}/grams")
    index.update(0, state(before, 1, True).unionByName(state(extra, 1, True)))
    index.update(1, state(items.where(later), 2, True).unionByName(state(extra, 2, False)))
    return index.search(t.sql(_QUERIES))


@query("autocomplete", """SELECT rank, type, name FROM (
    SELECT DISTINCT 1 AS rank, 'institution' AS type, institution AS name FROM low WHERE contains(i, 'up')
    UNION ALL SELECT 2, entity_type, canonical_name FROM fx_entity WHERE (contains(lower(canonical_name), 'up') OR entity_id IN (SELECT entity_id FROM fx_variant WHERE contains(lower(variant_name), 'up')))
      AND canonical_name NOT IN (SELECT institution FROM low WHERE contains(i, 'up'))
    UNION ALL SELECT DISTINCT 3, 'category', category FROM low WHERE contains(c, 'up')) ORDER BY rank, name LIMIT 8""", _LOW)
def autocomplete(t):
    return s.autocomplete(_items(t), t.fx_entity, t.fx_variant, "uP")


# Every first letter pair and triple of the benchmark's words, keys of suppliers, parts of names.
_PREFIX_SQL = """pre AS (SELECT DISTINCT substr(w, 1, k) AS prefix FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark), (VALUES (1), (2), (3)) n(k) WHERE w <> ''
    UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier UNION SELECT 'iNST ' || CAST(s_suppkey % 20 AS VARCHAR) FROM supplier UNION SELECT substr(s_name, 1, 12) FROM supplier)"""


@query("autocomplete_batch", f"""SELECT prefix, CAST(place AS INTEGER) AS place, rank, type, name FROM (
    SELECT prefix, rank, type, name, row_number() OVER (PARTITION BY prefix ORDER BY rank, name, type, key) AS place FROM (
      SELECT DISTINCT prefix, 1 AS rank, 'institution' AS type, institution AS name, '' AS key FROM pre JOIN (SELECT DISTINCT institution, i FROM low WHERE i <> '') ON contains(i, lower(prefix))
      UNION ALL SELECT DISTINCT prefix, 2, entity_type, canonical_name, CAST(entity_id AS VARCHAR) FROM pre
        JOIN (SELECT *, lower(canonical_name) AS n FROM fx_entity UNION ALL SELECT e.*, lower(variant_name) FROM fx_entity e JOIN fx_variant USING (entity_id)) ON contains(n, lower(prefix))
        WHERE NOT (contains(lower(canonical_name), lower(prefix)) AND canonical_name IN (SELECT institution FROM low))
      UNION ALL SELECT DISTINCT prefix, 3, 'category', category, '' FROM pre JOIN (SELECT DISTINCT category, c FROM low) ON contains(c, lower(prefix)))
    WHERE length(prefix) >= 2) WHERE place <= 8""", _LOW + ", " + _PREFIX_SQL)
def autocomplete_batch(t):
    """Suggestions for a table of prefixes."""
    words = t.benchmark.select(F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''")
    keys = t.supplier.select(F.explode(F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit("iNST "), (F.col("s_suppkey") % 20).cast("string")), F.substring("s_name", 1, 12))).alias("prefix"))
    prefixes = words.select(F.explode(F.array(*[F.substring("w", 1, k) for k in (1, 2, 3)])).alias("prefix")).unionByName(keys)
    return s.autocomplete_batch(_items(t), t.fx_entity, t.fx_variant, prefixes)


@query("highlighted", """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(the)', '<mark>\\1</mark>', 'gi'),
    '(a\\.)', '<mark>\\1</mark>', 'gi'), '(é)', '<mark>\\1</mark>', 'gi') AS text FROM documents""")
def highlighted(t):
    terms = F.array(F.lit("a."), F.lit("the"), F.lit("é"))
    return t.documents.select("doc_id", s.highlight(F.col("text"), terms).alias("text"))


@query("query_terms", """SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), '|') AS terms FROM documents""")
def query_terms(t):
    return t.documents.select("doc_id", F.array_join(tx.words(F.col("text")), "|").alias("terms"))
