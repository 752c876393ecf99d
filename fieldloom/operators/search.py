"""Search over index items.

Items: id, title, description, institution, category, category_id, fulltext,
entity_variants.  One query is a set of literals, so the scan stays native.  Many
queries at once are found together by an automaton of their longest terms, and meet the
items of their rarest one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions import text as tx
from fieldloom.plans.order import attach_row, cut_lineage

# Points per field that contains a term, and for an empty query.
FIELD_POINTS = [("title", 10), ("institution", 8), ("_variants", 7), ("description", 3), ("fulltext", 1)]
TITLE_EQUAL, TITLE_PREFIX, EMPTY_QUERY = 20, 5, 50


def split_terms(query: str) -> list[str]:
    return query.lower().split()


def _lowered(items: DataFrame) -> DataFrame:
    """Lower-case copies of the searched fields, prefixed by '_l_'."""
    joined = F.array_join(F.coalesce("entity_variants", F.array().cast("array<string>")), " ")
    out = items.withColumn("_variants", joined)
    names = ["title", "description", "institution", "category", "fulltext", "_variants"]
    return out.select(*items.columns, *[F.lower(F.coalesce(F.col(n), F.lit(""))).alias("_l_" + n) for n in names])


def _points(term: Column) -> Column:
    has = lambda n: F.col("_l_" + n).contains(term)
    score = F.lit(0)
    for name, points in FIELD_POINTS:
        score = score + F.when(has(name), points).otherwise(0)
    score = score + F.when(F.col("_l_title") == term, TITLE_EQUAL).otherwise(0)
    return score + F.when(F.col("_l_title").startswith(term), TITLE_PREFIX).otherwise(0)


def _any_field(term: Column) -> Column:
    names = ["title", "description", "institution", "category", "fulltext", "_variants"]
    out = F.col("_l_" + names[0]).contains(term)
    for name in names[1:]:
        out = out | F.col("_l_" + name).contains(term)
    return out


def search(items: DataFrame, query: str, categories: list[str] | None = None) -> DataFrame:
    """Items holding every term, with ``relevance``; an empty query keeps all."""
    rows = items if categories is None else items.where(F.col("category_id").isin(categories))
    terms = split_terms(query)
    if not terms:
        return rows.withColumn("relevance", F.lit(EMPTY_QUERY))
    low = _lowered(rows)
    for term in dict.fromkeys(terms):
        low = low.where(_any_field(F.lit(term)))
    score = F.lit(0)
    for term in terms:
        score = score + _points(F.lit(term))
    return low.select(*items.columns, score.alias("relevance"))


def ordered(results: DataFrame, query: str) -> DataFrame:
    key = F.desc("relevance") if split_terms(query) else F.lower("title")
    return results.orderBy(key, "id")


def relevance_percent(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of the best relevance in percent, rounded half up.

    The maximum is aggregated and joined back, which spreads over tasks where a
    window over all rows would not.
    """
    best = F.max("relevance").alias("_max")
    rows = results.join(results.groupBy(*by).agg(best), by) if by else attach_row(results, results.agg(best))
    share = F.when(F.col("_max") > 0, F.floor(F.col("relevance") * 100 / F.col("_max") + 0.5)).otherwise(0)
    return rows.withColumn("percent", share.cast("int")).drop("_max")


def _blocks_of_terms(texts: DataFrame, terms: DataFrame, slice_texts: int, block_terms: int):
    """Slices of ``texts`` (id, text, more) beside bounded blocks of ``terms`` (term), each pair a group of its own.

    The numbers of blocks and slices are columns of the plan.
    """
    count = lambda df, size, name: df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int").alias(name))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = attach_row(count(texts.select("id"), slice_texts, "_slices"), count(terms, block_terms, "_blocks"))
    sizes = sizes.withColumn("_slices", F.greatest("_slices", F.lit(2 * tasks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = attach_row(texts, sizes).withColumn("s", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int")).withColumn("b", every("_blocks"))
    right = attach_row(terms.select("term"), sizes).withColumn("b", F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int")).withColumn("s", every("_slices"))
    # Partitions of few bytes but much work must not be merged by size.
    left, right = (side.select(*columns).repartition(4 * tasks, "s", "b") for side, columns in ((left, [*texts.columns, "s", "b"]), (right, ["term", "s", "b"])))
    return left.groupBy("s", "b").cogroup(right.groupBy("s", "b"))


def _automaton(terms: pa.Table):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term in terms.column("term").to_pylist():
        automaton.add_word(term, term)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def term_hits(texts: DataFrame, terms: DataFrame, slice_texts: int = 2_000, block_terms: int = 20_000) -> DataFrame:
    """(term, id): every distinct ``terms`` (term) that the text of an item (id, text) contains.

    Terms are cut into bounded blocks, and each block's automaton reads each text once,
    whatever the number of its terms.
    """

    def read(some: pa.Table, wanted: pa.Table) -> pa.Table:
        found_terms, found_ids = [], []
        automaton = _automaton(wanted)
        if len(automaton):
            for item, text in zip(some.column("id").to_pylist(), some.column("text").to_pylist(), strict=True):
                hits = {term for _, term in automaton.iter(text)}
                found_terms.extend(hits)
                found_ids.extend([item] * len(hits))
        return pa.table({"term": pa.array(found_terms, pa.string()), "id": pa.array(found_ids, some.schema.field("id").type)})

    kind = texts.schema["id"].dataType.simpleString()
    return _blocks_of_terms(texts.select("id", "text"), terms, slice_texts, block_terms).applyInArrow(read, f"term string, id {kind}")


def batch_search(items: DataFrame, queries: DataFrame, pivots: int = 3) -> DataFrame:
    """(query_id, id, relevance) for many queries in one pass over the items.

    ``queries``: query_id, query.  Repeated terms of a query count repeatedly.  A query
    without terms stands for every item: it gets one row with a NULL id.

    The ``pivots`` longest terms of all queries are found in one pass and counted.  A query
    meets the items of the rarest of its own; its other terms are tested on these items
    only, so a short and frequent term never meets all its items and queries.
    """
    low = cut_lineage(_lowered(items).select("id", *(f"_l_{n}" for n in ("title", "description", "institution", "category", "fulltext", "_variants"))))
    names = [n for n in low.columns if n.startswith("_l_")]
    words = cut_lineage(queries.select("query_id", tx.words(F.col("query")).alias("_w")))
    wanted = pivot_terms(words, pivots)
    # Terms hold no white space, so none is found across two fields.
    texts = low.select("id", F.concat_ws("\n", *names).alias("text"))
    hits = cut_lineage(term_hits(texts, wanted.select("term").distinct()))
    found = rarest_terms(wanted, hits).join(hits, "term").select("query_id", "id")
    # Texts meet their queries last, so that no text is shuffled once for each of its queries.
    rows = found.join(words, "query_id").join(low, "id")
    return scored(rows).unionByName(blank_queries(words, items.schema["id"].dataType))


def pivot_terms(words: DataFrame, pivots: int) -> DataFrame:
    """(query_id, _needed, term): the longest terms of each query, and how many they are."""
    longest = F.slice(F.array_sort(F.array_distinct("_w"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1, pivots)
    return words.select("query_id", F.size(longest).alias("_needed"), F.explode(longest).alias("term"))


def rarest_terms(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, term): the term with the fewest items of each query of which all wanted terms have some."""
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("_items"))
    known = wanted.join(counts, "term").groupBy("query_id", "_needed")
    rarest = known.agg(F.count(F.lit(1)).alias("_known"), F.min_by("term", F.struct("_items", "term")).alias("term"))
    return rarest.where("_known = _needed").select("query_id", "term")


def scored(rows: DataFrame) -> DataFrame:
    """(query_id, id, relevance) of pairs that hold every term in ``_w``."""
    total = F.aggregate("_w", F.lit(0).cast("long"), lambda acc, term: acc + _points(term))
    return rows.where(F.forall("_w", _any_field)).select("query_id", "id", total.alias("relevance"))


def blank_queries(words: DataFrame, id_type) -> DataFrame:
    return words.where(F.size("_w") == 0).select("query_id", F.lit(None).cast(id_type).alias("id"), F.lit(EMPTY_QUERY).cast("long").alias("relevance"))


def autocomplete(items: DataFrame, entities: DataFrame, variants: DataFrame, prefix: str, size: int = 8) -> DataFrame:
    """Up to ``size`` suggestions: institutions, then entities, then categories."""
    wanted = prefix.lower()
    holds = lambda c: F.lower(F.col(c)).contains(wanted)
    kinds = lambda df, rank, kind, name: df.select(F.lit(rank).alias("rank"), kind.alias("type"), F.col(name).alias("name"))
    inst = items.where((F.col("institution") != "") & holds("institution")).select("institution").distinct()
    by_variant = variants.where(holds("variant_name")).select("entity_id").distinct().withColumn("_v", F.lit(True))
    known = entities.join(by_variant, "entity_id", "left").where(holds("canonical_name") | F.col("_v"))
    known = known.join(inst.select(F.col("institution").alias("canonical_name")), "canonical_name", "left_anti")
    cats = items.where(holds("category")).select("category").distinct()
    rows = kinds(inst, 1, F.lit("institution"), "institution").unionByName(
        kinds(known, 2, F.coalesce("entity_type", F.lit("entity")), "canonical_name")).unionByName(kinds(cats, 3, F.lit("category"), "category"))
    if len(wanted) < 2:
        rows = rows.where(F.lit(False))
    return rows.orderBy("rank", "name").limit(size)


def autocomplete_batch(items: DataFrame, entities: DataFrame, variants: DataFrame, prefixes: DataFrame, size: int = 8) -> DataFrame:
    """(prefix, place, rank, type, name): what ``autocomplete`` suggests for each distinct ``prefixes`` (prefix).

    A name is cut into its pieces of the lengths that the prefixes have, and pieces meet
    equal prefixes, so the work grows with the names and their lengths, whatever the number
    of prefixes.  Of the names of a frequent prefix, each task sends on ``size`` only.
    """
    wanted = prefixes.select("prefix", F.lower("prefix").alias("term")).distinct().where(F.length("term") >= 2)
    kind = F.coalesce("entity_type", F.lit("entity"))
    own = entities.select(F.lower("canonical_name").alias("text"), F.lit(2).alias("rank"), kind.alias("type"), F.col("canonical_name").alias("name"), F.col("entity_id").cast("string").alias("key"))
    known = entities.select("entity_id", kind.alias("type"), F.col("canonical_name").alias("name"))
    other = variants.join(known, "entity_id").select(F.lower("variant_name").alias("text"), F.lit(2).alias("rank"), "type", "name", F.col("entity_id").cast("string").alias("key"))
    listed = lambda column, rank, name: items.select(F.lower(column).alias("text"), F.lit(rank).alias("rank"), F.lit(name).alias("type"), F.col(column).alias("name"), F.lit("").alias("key"))
    names = own.unionByName(other).unionByName(listed("institution", 1, "institution")).unionByName(listed("category", 3, "category"))
    names = names.where("text <> '' AND name IS NOT NULL").distinct()
    terms = wanted.select("term").distinct()
    lengths = terms.agg(F.collect_set(F.length("term")).alias("_lengths"))  # one row, of as many numbers as there are lengths
    starts = lambda n: F.sequence(F.lit(1), F.length("text") - n + 1)
    pieces = F.transform(F.filter("_lengths", lambda n: n <= F.length("text")), lambda n: F.transform(starts(n), lambda i: F.col("text").substr(i, n)))
    cut = attach_row(names, lengths).select(F.explode(F.array_distinct(F.flatten(pieces))).alias("term"), "rank", "type", "name", "key")
    # Rows of few bytes: tasks of a size in bytes would hold too many of them to sort.
    tasks = 4 * int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut.repartition(tasks, "term").join(terms.repartition(tasks, "term"), "term", "left_semi")
    hits = cut_lineage(found.distinct())
    institutions = hits.where("rank = 1").select("term", "name", F.lit(2).alias("rank"))
    best = Window.partitionBy("term").orderBy("rank", "name", "type", "key")
    placed = hits.join(institutions, ["term", "rank", "name"], "left_anti").withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    return wanted.join(placed, "term").select("prefix", "place", "rank", "type", "name")


def highlight(text: Column, terms: Column) -> Column:
    """Escaped text with every term marked, longest term first."""
    longest = F.array_sort(terms, lambda a, b: F.length(b) - F.length(a))

    def mark(acc: Column, term: Column) -> Column:
        quoted = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
        return F.regexp_replace(acc, F.concat(F.lit("(?iu)("), quoted, F.lit(")")), F.lit("<mark>$1</mark>"))

    return F.aggregate(longest, tx.escape_html(text), mark)
