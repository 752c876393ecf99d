"""Queries over content-type definitions and the entity import."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.operators import configuration as g
from fieldloom.sources import config
from fieldloom.streaming.sinks import work_folder

_CATS = """SELECT category_id AS config, CASE WHEN category_id % 11 = 0 THEN NULL ELSE internal_name END AS internal_name, display_name,
    CASE WHEN category_id % 7 = 0 THEN NULL ELSE 'x' END AS template, category_id % 13 <> 0 AS has_groups, true AS has_active FROM {cfg_category}
    UNION ALL SELECT -1, 'lonely', 'Without prompts', 'x', true, true UNION ALL SELECT -2, NULL, 'Broken', NULL, false, true"""
_PROMPTS = """SELECT m.category_id AS config, m.prompt_id AS position, CASE WHEN p.prompt_id % 50 = 7 THEN NULL WHEN p.prompt_id % 40 = 3 THEN 'same' ELSE p.internal_name END AS internal_name, p.display_name,
    CASE WHEN p.prompt_id % 60 = 11 THEN NULL ELSE p.field_group END AS field_group, CASE WHEN p.prompt_id % 30 = 1 THEN NULL ELSE p.extract_prompt END AS prompt_template,
    CASE WHEN p.prompt_id % 60 = 1 THEN 'text' END AS extract_prompt FROM {cfg_mapping} m JOIN {cfg_prompt} p ON p.prompt_id = m.prompt_id"""
_GROUPS = """SELECT m.category_id AS config, p.field_group AS group_name, CASE WHEN p.prompt_id % 25 = 2 THEN 'ghost' ELSE p.internal_name END AS field FROM {cfg_mapping} m JOIN {cfg_prompt} p ON p.prompt_id = m.prompt_id"""
_ACTIVE = "SELECT DISTINCT category_id AS config, CASE WHEN prompt_id % 70 = 5 THEN 'extra' ELSE 'standard' END AS group_name FROM {cfg_mapping}"


def _d(text: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text)


@query("config_violations", f"""WITH_C SELECT config, 'missing category field' AS problem, 'internal_name' AS detail FROM c WHERE internal_name IS NULL
    UNION ALL SELECT config, 'missing category field', 'template' FROM c WHERE template IS NULL UNION ALL SELECT config, 'missing category field', 'field_groups' FROM c WHERE NOT has_groups
    UNION ALL SELECT config, 'no prompts', '' FROM c WHERE config NOT IN (SELECT config FROM p)
    UNION ALL SELECT config, 'missing prompt field', position + 1 || ': internal_name' FROM p WHERE internal_name IS NULL UNION ALL SELECT config, 'missing prompt field', position + 1 || ': field_group' FROM p WHERE field_group IS NULL
    UNION ALL SELECT config, 'no prompt text', CAST(position + 1 AS VARCHAR) FROM p WHERE prompt_template IS NULL AND extract_prompt IS NULL
    UNION ALL SELECT config, 'duplicate prompt', internal_name FROM p WHERE internal_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT config, 'unknown prompt in group', group_name || '.' || field FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.config = g.config AND p.internal_name = g.field)
    UNION ALL SELECT config, 'active group without fields', group_name FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.config = a.config AND g.group_name = a.group_name)""".replace("WITH_C ", ""),
    f"c AS ({_d(_CATS)}), p AS ({_d(_PROMPTS)}), g AS ({_d(_GROUPS)}), a AS ({_d(_ACTIVE)})")
def config_violations(t):
    return g.validate_config(t.sql(_CATS), t.sql(_PROMPTS), t.sql(_GROUPS), t.sql(_ACTIVE))


_SIZES = """SELECT config, b, s, row_number() OVER (PARTITION BY config ORDER BY s) AS place, CASE WHEN s % 10 = 3 THEN 'same' WHEN s % 10 <> 7 THEN 'size_' || CAST(s AS VARCHAR) END AS internal_name
    FROM (SELECT DISTINCT p_brand AS config, CAST(substring(p_brand, 7) AS INTEGER) AS b, p_size AS s FROM part) WHERE b % 4 <> 3 AND b % 9 <> 4"""


@query("definition_violations", """SELECT config, 'unreadable definition' AS problem, CASE WHEN b % 4 = 3 THEN 'while parsing a flow node' ELSE 'missing category section' END AS detail FROM c WHERE b % 4 = 3 OR b % 9 = 4
    UNION ALL SELECT config, 'missing category field', 'internal_name' FROM good WHERE b % 11 = 0 UNION ALL SELECT config, 'missing category field', 'template' FROM good WHERE b % 7 = 0
    UNION ALL SELECT config, 'missing category field', 'field_groups' FROM good WHERE b % 6 = 0 UNION ALL SELECT config, 'missing prompt field', place || ': internal_name' FROM p WHERE internal_name IS NULL
    UNION ALL SELECT config, 'missing prompt field', place || ': field_group' FROM p WHERE s % 11 = 0 UNION ALL SELECT config, 'no prompt text', CAST(place AS VARCHAR) FROM p WHERE s % 8 = 5
    UNION ALL SELECT config, 'duplicate prompt', internal_name FROM p WHERE internal_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT config, 'unknown prompt in group', 'standard.' || field FROM f WHERE field LIKE 'ghost%'
    UNION ALL SELECT config, 'active group without fields', 'standard' FROM good WHERE config NOT IN (SELECT config FROM f WHERE field IS NOT NULL)
    UNION ALL SELECT config, 'active group without fields', 'hollow' FROM good WHERE b % 5 = 0""",
    f"""c AS (SELECT DISTINCT p_brand AS config, CAST(substring(p_brand, 7) AS INTEGER) AS b FROM part), good AS (SELECT * FROM c WHERE b % 4 <> 3 AND b % 9 <> 4), p AS ({_SIZES}),
    f AS (SELECT config, CASE WHEN s % 9 = 2 THEN 'ghost_' || CAST(s AS VARCHAR) ELSE internal_name END AS field FROM p WHERE b % 6 <> 0)""")
def definition_violations(t):
    """Definitions made of the brands and sizes of ``part``, some broken, are written as files, read back and checked."""
    b, s = F.substring("p_brand", 7, 9).cast("int"), F.col("p_size")
    name = F.when(s % 10 == 3, "same").when(s % 10 != 7, F.concat(F.lit("size_"), s))
    prompt = F.struct(
        name.alias("internal_name"), F.concat(F.lit("Size "), s).alias("display_name"), F.when(s % 11 != 0, "standard").alias("field_group"),
        F.when(s % 4 != 1, F.concat(F.lit("Find "), s)).alias("prompt_template"), F.when(s % 8 == 1, F.concat(F.lit("Old "), s)).alias("extract_prompt"))
    sizes = t.part.select(F.col("p_brand").alias("config"), b.alias("b"), "p_size", prompt.alias("prompt"), F.when(s % 9 == 2, F.concat(F.lit("ghost_"), s)).otherwise(name).alias("field")).distinct()
    # A brand has one prompt per size.
    brands = sizes.groupBy("config", "b").agg(F.array_sort(F.collect_list(F.struct("p_size", "prompt", "field"))).alias("rows"))
    b = F.col("b")
    groups = F.struct(F.col("rows.field").alias("standard"), F.array().cast("array<string>").alias("hollow"))
    category = F.struct(
        F.when(b % 11 != 0, F.lower("config")).alias("internal_name"), F.col("config").alias("display_name"), F.when(b % 7 != 0, "# $title").alias("steckbrief_template"),
        F.when(b % 6 != 0, groups).alias("field_groups"), F.when(b % 5 == 0, F.array(F.lit("standard"), F.lit("hollow"))).otherwise(F.array(F.lit("standard"))).alias("active_groups"))
    whole = F.to_json(F.struct(category.alias("category"), F.col("rows.prompt").alias("prompts")))
    text = F.when(b % 4 == 3, '{"category": [').when(b % 9 == 4, '{"prompts": []}').otherwise(whole)
    folder = f"{work_folder(t.spark)}/definitions"
    config.write_category_configs(brands.select("config", text.alias("text")), folder)
    return g.validate_config(**config.config_tables(config.read_category_configs(t.spark, folder, written=True)))


_DECLARED = """SELECT 'field_' || CAST(p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1000000 ELSE 0 END AS STRING) AS internal_name, 'New ' || p_name AS display_name, 'fresh' AS field_group,
    p_size % 2 = 0 AS translatable, CASE WHEN p_size % 4 = 0 THEN 'location' END AS entity_type FROM {part} WHERE p_partkey % 3 <> 1"""


def _synced(t, force):
    current = t.cfg_prompt.select("internal_name", "display_name", "field_group", "translatable", "entity_type", "is_active")
    return g.sync_prompts(current, t.sql(_DECLARED), force)


def _sync_sql(force: bool) -> str:
    take = "n.internal_name IS NOT NULL" if force else "n.internal_name IS NOT NULL AND o.internal_name IS NULL"
    active = "n.internal_name IS NOT NULL OR o.is_active" if force else "coalesce(o.is_active, true)"
    return f"""SELECT coalesce(o.internal_name, n.internal_name) AS internal_name, CASE WHEN {take} THEN n.display_name ELSE o.display_name END AS display_name,
        CASE WHEN {take} THEN n.field_group ELSE o.field_group END AS field_group, CASE WHEN n.internal_name IS NOT NULL THEN n.translatable ELSE o.translatable END AS translatable,
        CASE WHEN n.internal_name IS NOT NULL THEN n.entity_type ELSE o.entity_type END AS entity_type, {active} AS is_active,
        CASE WHEN o.internal_name IS NULL THEN 'created' WHEN n.internal_name IS NULL THEN 'kept' ELSE '{"updated" if force else "skipped"}' END AS action
        FROM cfg_prompt o FULL JOIN ({_d(_DECLARED)}) n ON n.internal_name = o.internal_name"""


@query("synced_prompts", _sync_sql(False))
def synced_prompts(t):
    return _synced(t, False)


@query("forced_sync", _sync_sql(True))
def forced_sync(t):
    return _synced(t, True)


_DECLARED_MAP = "SELECT s_suppkey AS category_id, s_suppkey * 2 + 1 AS prompt_id, CAST(10 AS BIGINT) AS display_order FROM {supplier} WHERE s_suppkey % 2 = 0"


@query("synced_mapping", f"SELECT category_id, prompt_id, display_order, 'kept' AS action FROM cfg_mapping WHERE category_id % 2 <> 0 UNION ALL SELECT category_id, prompt_id, display_order, 'created' FROM ({_d(_DECLARED_MAP)})")
def synced_mapping(t):
    return g.sync_mapping(t.cfg_mapping, t.sql(_DECLARED_MAP), force=True)


_DECLARED_CATEGORIES = """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'new_' || CAST(s_suppkey AS STRING) ELSE lower(s_name) END AS internal_name, 'Declared ' || CAST(s_suppkey AS STRING) AS display_name
    FROM {supplier} WHERE s_suppkey % 2 = 0"""


def _category_sql(force: bool) -> str:
    take = "n.internal_name IS NOT NULL" if force else "n.internal_name IS NOT NULL AND o.internal_name IS NULL"
    return f"""SELECT coalesce(o.internal_name, n.internal_name) AS internal_name, CASE WHEN {take} THEN n.display_name ELSE o.display_name END AS display_name,
        CASE WHEN o.internal_name IS NULL THEN 'created' WHEN n.internal_name IS NULL THEN 'kept' ELSE '{"updated" if force else "skipped"}' END AS action
        FROM (SELECT lower(s_name) AS internal_name, 'Category ' || s_suppkey AS display_name FROM supplier) o FULL JOIN ({_d(_DECLARED_CATEGORIES)}) n ON n.internal_name = o.internal_name"""


def _synced_categories(t, force):
    current = t.supplier.select(F.lower("s_name").alias("internal_name"), F.concat(F.lit("Category "), F.col("s_suppkey").cast("string")).alias("display_name"))
    return g.sync_categories(current, t.sql(_DECLARED_CATEGORIES), force)


@query("synced_categories", _category_sql(False))
def synced_categories(t):
    return _synced_categories(t, False)


@query("forced_category_sync", _category_sql(True))
def forced_category_sync(t):
    return _synced_categories(t, True)


@query("sync_stats", f"""SELECT 'categories' AS "table", action, count(*) AS n FROM ({_category_sql(False)}) WHERE action <> 'kept' GROUP BY ALL UNION ALL SELECT 'prompts' AS "table", action, count(*) AS n FROM ({_sync_sql(False)}) WHERE action <> 'kept' GROUP BY ALL
    UNION ALL SELECT 'mappings', 'created', count(*) FROM ({_d(_DECLARED_MAP)}) d WHERE NOT EXISTS (SELECT 1 FROM cfg_mapping m WHERE m.category_id = d.category_id AND m.prompt_id = d.prompt_id)""")
def sync_stats(t):
    return g.sync_stats(categories=_synced_categories(t, False), prompts=_synced(t, False), mappings=g.sync_mapping(t.cfg_mapping, t.sql(_DECLARED_MAP)))


@query("exported_categories", """SELECT c.category_id, CAST(to_json({'category': {'internal_name': any_value(c.internal_name), 'display_name': any_value(c.display_name)}, 'prompts': list({'internal_name': p.internal_name,
    'display_name': p.display_name, 'field_group': p.field_group, 'output_format': p.field_type, 'prompt_template': p.extract_prompt} ORDER BY m.display_order, m.prompt_id)}) AS VARCHAR) AS json
    FROM cfg_category c JOIN cfg_mapping m USING (category_id) JOIN cfg_prompt p ON p.prompt_id = m.prompt_id GROUP BY c.category_id""")
def exported_categories(t):
    return g.export_category(t.cfg_category, t.cfg_mapping, t.cfg_prompt)


_RECORDS = """SELECT c_custkey AS position, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE ' Inst ' || CAST(c_custkey % 900 AS STRING) || ' ' END AS name, n_name AS country, substr(n_name, 1, 2) AS code,
    CASE WHEN c_custkey % 10 <> 0 THEN split('b' || CAST(c_custkey AS STRING) || '.org,a' || CAST(c_custkey AS STRING) || '.org', ',') END AS domains FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
_EXTRAS = """SELECT 'INST ' || CAST(s_suppkey * 7 AS STRING) AS canonical_name, n_name AS country, substr(n_name, 1, 2) AS code,
    split('z.org,a.org', ',') AS domains, split('V' || CAST(s_suppkey AS STRING) || ',I' || CAST(s_suppkey AS STRING), ',') AS variants FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@query("imported_entities", f"""SELECT canonical_name, country, code, array_to_string(CASE WHEN xd IS NULL THEN domains ELSE list_sort(list_distinct(list_concat(domains, xd))) END, ',') AS domains,
      coalesce(array_to_string(list_sort(xv), ','), '') AS variants, coalesce(CASE WHEN xd IS NULL THEN domains ELSE list_sort(list_distinct(list_concat(domains, xd))) END, [])[1] AS domain FROM (
    SELECT b.*, CASE WHEN b.position = l.last THEN x.domains END AS xd, CASE WHEN b.position = l.last THEN x.variants END AS xv FROM base b JOIN (SELECT lower(canonical_name) AS k, max(position) AS last FROM base GROUP BY 1) l ON l.k = lower(b.canonical_name)
      LEFT JOIN x ON lower(x.canonical_name) = l.k)
    UNION ALL SELECT canonical_name, country, code, array_to_string(domains, ','), array_to_string(variants, ','), domains[1] FROM x WHERE lower(canonical_name) NOT IN (SELECT lower(canonical_name) FROM base)""",
    f"""base AS (SELECT position, trim(name) AS canonical_name, country, code, coalesce(domains, []) AS domains FROM ({_d(_RECORDS)}) WHERE code IN ('NA', 'FR', 'GE', 'UN') AND trim(name) <> ''),
    x AS (SELECT * FROM ({_d(_EXTRAS)}) WHERE code IN ('NA', 'FR', 'GE', 'UN'))""")
def imported_entities(t):
    out = g.import_entities(t.sql(_RECORDS), t.sql(_EXTRAS), ["na ", "FR", "ge", "UN"])
    return out.withColumn("domains", F.array_join("domains", ",")).withColumn("variants", F.array_join("variants", ","))


@query("metadata_updates", """SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 7 = 0 THEN 'skip' WHEN s_suppkey % 5 IN (0, 1, 2, 3) THEN 'update' ELSE 'skip' END AS action FROM supplier""")
def metadata_updates(t):
    k = F.col("s_suppkey")
    pairs = lambda *p: F.create_map(*[F.lit(x) for x in p])
    full = ("type", "u", "founded", "1900", "coordinates", "1,2", "state", "x", "city", "y")
    now = (
        F.when(k % 5 == 0, F.lit(None).cast("map<string,string>")).when(k % 5 == 1, pairs("type", "u", "city", "y"))
        .when(k % 5 == 2, pairs("type", "u", "founded", "1900", "coordinates", "1,2", "city", "y", "a", "b"))
        .when(k % 5 == 3, pairs(*full[:5], "9,9", *full[6:])).otherwise(pairs(*full))
    )
    entities = t.supplier.select(k.alias("entity_id"), F.col("s_name").alias("canonical_name"), now.alias("metadata"))
    known = t.supplier.where(k % 7 != 0).select(F.col("s_name").alias("canonical_name"), pairs(*full).alias("metadata"))
    return g.metadata_needs_update(entities, known)
