"""Three change sets over a versioned table of extractions, and counts kept beside it."""

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.operators import changes as c
from fieldloom.operators.kept import KeptCounts, KeptStatistics, average
from fieldloom.operators.statistics import metrics
from fieldloom.sources.versions import VersionedTable
from fieldloom.streaming.sinks import work_folder

_COLUMNS = "source_id, prompt_id, extraction_id, validated_result, raw_confidence, translation_status, is_manual_edit"
_LINES = "SELECT l_orderkey AS source_id, CAST(l_linenumber AS BIGINT) AS prompt_id, max(l_partkey) AS part, max(l_quantity) AS quantity"
#: New results (edited rows stay) with prompts not asked before, edits, and sources that go, each chosen by dates and kinds of the orders.
_NEW = f"""SELECT source_id, prompt_id + CASE WHEN part % 5 = 0 THEN 10 ELSE 0 END AS prompt_id, 'again ' || CAST(part AS STRING) AS validated_result, quantity / 100 AS raw_confidence,
    'pending' AS translation_status, false AS is_manual_edit FROM ({_LINES} FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey
    WHERE o_orderdate >= TIMESTAMP '1998-06-01 00:00:00' GROUP BY l_orderkey, l_linenumber)"""
_EDITS = f"""SELECT source_id, prompt_id, 'edited ' || CAST(part AS STRING) AS value FROM ({_LINES} FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey
    WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1998-05-01 00:00:00' GROUP BY l_orderkey, l_linenumber)"""
_GONE = "SELECT o_orderkey AS source_id FROM {orders} WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1992-04-01 00:00:00'"


def _d(text: str) -> str:
    return text.replace("{lineitem}", "lineitem").replace("{orders}", "orders")


_FINAL = f"""u AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.prompt_id, n.prompt_id) AS prompt_id,
      CASE WHEN n.source_id IS NULL OR o.is_manual_edit THEN o.validated_result ELSE n.validated_result END AS validated_result,
      CASE WHEN n.source_id IS NULL OR o.is_manual_edit THEN o.raw_confidence ELSE n.raw_confidence END AS raw_confidence,
      CASE WHEN n.source_id IS NULL OR o.is_manual_edit THEN o.translation_status ELSE n.translation_status END AS translation_status, coalesce(o.is_manual_edit, false) AS is_manual_edit
      FROM fx_extraction o FULL JOIN ({_d(_NEW)}) n ON n.source_id = o.source_id AND n.prompt_id = o.prompt_id),
    final AS (SELECT u.source_id, u.prompt_id, coalesce(e.value, u.validated_result) AS validated_result, u.raw_confidence, u.translation_status, u.is_manual_edit OR e.value IS NOT NULL AS is_manual_edit
      FROM u LEFT JOIN ({_d(_EDITS)}) e ON e.source_id = u.source_id AND e.prompt_id = u.prompt_id WHERE u.source_id NOT IN ({_d(_GONE)}))"""


def _edited(rows, edits):
    values = edits.select("source_id", "prompt_id", F.col("value").alias("_value"))
    joined = rows.join(values, ["source_id", "prompt_id"], "left")
    hit = F.col("_value").isNotNull()
    return joined.withColumn("validated_result", F.coalesce("_value", "validated_result")).withColumn("is_manual_edit", hit | F.col("is_manual_edit")).drop("_value")


def _table(t, after_each=lambda table: None):
    rows = t.fx_extraction.select(*_COLUMNS.split(", "))
    table = VersionedTable(t.spark, f"{work_folder(t.spark)}/extractions", rows.schema, ["source_id"], buckets=16)
    steps = [
        lambda: table.replace(rows),
        lambda: table.apply(t.sql(_NEW), c.upsert_extractions),
        lambda: table.apply(t.sql(_EDITS), _edited),
        lambda: table.apply(t.sql(_GONE), lambda old, gone: c.delete_cascade(gone, "source_id", rows=old)["rows"]),
    ]
    for step in steps:
        step()
        after_each(table)
    return table


@query("versioned_extractions", "SELECT * FROM final", _FINAL)
def versioned_extractions(t):
    return _table(t).read().drop("extraction_id")


@query("kept_counts", """SELECT prompt_id, translation_status, count(*) AS n, count(*) FILTER (is_manual_edit) AS edited FROM final GROUP BY ALL""", _FINAL)
def kept_counts(t):
    made = {}

    def count(table):
        view = made.setdefault("view", KeptCounts(table, "status", ["prompt_id", "translation_status"], {"edited": F.col("is_manual_edit").cast("int")}))
        made["counts"] = view.refresh()

    _table(t, count)
    return made["counts"].select("prompt_id", "translation_status", "n", F.col("edited").cast("long").alias("edited"))


@query("kept_averages", """SELECT prompt_id, count(*) AS n, count(raw_confidence) AS scored, CAST(sum(CAST(raw_confidence AS DECIMAL(18,4))) AS DOUBLE) / count(raw_confidence) AS average FROM final GROUP BY prompt_id""", _FINAL)
def kept_averages(t):
    score = F.col("raw_confidence").cast("decimal(18,4)")
    view = {}

    def count(table):
        kept = view.setdefault("kept", KeptCounts(table, "scores", ["prompt_id"], {"total": score, "scored": score.isNotNull().cast("int")}))
        view["counts"] = kept.refresh()

    _table(t, count)
    return view["counts"].select("prompt_id", "n", F.col("scored").cast("long").alias("scored"), average("total", "scored").alias("average"))


_FIELDS = "source_id, prompt_id, validated_result, validated_result_en, final_confidence, linked_entity_id, translation_status"
_URGENT = "SELECT o_orderkey AS source_id FROM {orders} WHERE o_orderpriority = '1-URGENT'"
_REPORTED = f"""s AS (SELECT source_id, category_id, CASE WHEN status = 'failed' AND source_id IN ({_d(_URGENT)}) THEN 'pending' ELSE status END AS status
      FROM fx_source WHERE source_id NOT IN ({_d(_GONE)})),
    e AS (SELECT prompt_id, validated_result, final_confidence, linked_entity_id, CASE WHEN u THEN 'translated' ELSE translation_status END AS translation_status,
      CASE WHEN u THEN coalesce(validated_result_en, 'english') ELSE validated_result_en END AS validated_result_en
      FROM (SELECT *, source_id IN ({_d(_URGENT)}) AS u FROM fx_extraction) WHERE source_id NOT IN ({_d(_GONE)})),
    d AS (SELECT published AND lang IS DISTINCT FROM 'de' AS published FROM fx_profile JOIN documents ON doc_id = profile_id)"""
_FILLED = "validated_result IS NOT NULL AND validated_result <> ''"


def _values(report: str, table: str, **columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{report}' AS report, '{k}' AS name, CAST({v} AS DOUBLE) AS value FROM {table}" for k, v in columns.items())


_TRANSLATED = f"""(SELECT *, total - translatable AS skipped, round(translated / translatable * 100, 1) AS progress FROM (SELECT count(*) FILTER ({_FILLED}) AS total,
    count(*) FILTER ({_FILLED} AND translatable) AS translatable, count(*) FILTER (translation_status = 'translated') AS translated,
    count(*) FILTER ({_FILLED} AND translatable AND (translation_status = 'pending' OR translation_status IS NULL OR validated_result_en IS NULL)) AS pending,
    count(*) FILTER (translation_status = 'failed') AS failed FROM e JOIN fx_prompt USING (prompt_id)))"""


@query("kept_statistics", " UNION ALL ".join([
    "SELECT 'status' AS report, v.status AS name, CAST((SELECT count(*) FROM s WHERE s.status = v.status) AS DOUBLE) AS value FROM (VALUES ('pending'), ('crawled'), ('extracting'), ('completed'), ('failed')) v(status)",
    "SELECT 'category', c.internal_name, CAST((SELECT count(*) FROM s WHERE s.category_id = c.category_id AND s.status = 'completed') AS DOUBLE) FROM fx_category c",
    _values("dashboard", "s", total_sources="count(*)", completed_sources="count(*) FILTER (status = 'completed')", failed_sources="count(*) FILTER (status = 'failed')",
            open_sources="count(*) FILTER (status IN ('pending', 'crawled', 'extracting'))"),
    _values("dashboard", "d", total_profiles="count(*)", published_profiles="count(*) FILTER (published)", unpublished_profiles="count(*) FILTER (NOT published)"),
    _values("dashboard", "e", total_extractions="count(*)", validated_extractions=f"count(*) FILTER ({_FILLED})", linked_extractions="count(linked_entity_id)",
            low_confidence="count(*) FILTER (final_confidence < 0.7)",
            avg_confidence="round(CAST(sum(CAST(final_confidence AS DECIMAL(18,6))) AS DOUBLE) / count(final_confidence) * 100, 1)"),
    _values("translation", _TRANSLATED, **{c: c for c in ("total", "translatable", "translated", "pending", "failed", "skipped", "progress")}),
]), _REPORTED)
def kept_statistics(t):
    """The reports after three commits on sources and extractions and two on profiles, folded in after each."""
    folder = work_folder(t.spark)
    table = lambda rows, name, key: VersionedTable(t.spark, f"{folder}/{name}", rows.schema, [key], buckets=8)
    rows = t.fx_source.select("source_id", "category_id", "status"), t.fx_extraction.select(*_FIELDS.split(", ")), t.fx_profile.select("profile_id", "published")
    sources, extractions, profiles = (table(r, n, k) for r, n, k in zip(rows, ("sources", "extractions", "profiles"), ("source_id", "source_id", "profile_id"), strict=True))
    kept = KeptStatistics(sources, extractions, profiles)

    def marked(old, hit, **new):
        joined = old.join(hit.withColumn("_hit", F.lit(True)), hit.columns[0], "left")
        return joined.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()})

    for one, all_rows in zip((sources, extractions, profiles), rows, strict=True):
        one.replace(all_rows)
    kept.refresh()
    urgent, gone = t.sql(_URGENT), t.sql(_GONE)
    again = F.when(F.col("status") == "failed", "pending").otherwise(F.col("status"))
    sources.apply(urgent, lambda old, hit: marked(old, hit, status=again))
    extractions.apply(urgent, lambda old, hit: marked(old, hit, translation_status=F.lit("translated"), validated_result_en=F.coalesce("validated_result_en", F.lit("english"))))
    german = t.documents.where("lang = 'de'").select(F.col("doc_id").alias("profile_id")).distinct()
    profiles.apply(german, lambda old, hit: marked(old, hit, published=F.lit(False)))
    kept.refresh()
    for one in (sources, extractions):
        one.apply(gone, lambda old, hit: old.join(hit, "source_id", "left_anti"))
    kept.refresh()
    named = lambda report, frame, name, value: frame.select(F.lit(report).alias("report"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    progress = kept.translation_stats(t.fx_prompt)
    return (
        named("status", kept.count_by_status(), "status", "n")
        .unionByName(named("category", kept.with_sources(t.fx_category, "n", "completed"), "internal_name", "n"))
        .unionByName(named("dashboard", kept.dashboard(), "metric", "value"))
        .unionByName(named("translation", metrics(progress), "metric", "value")))
