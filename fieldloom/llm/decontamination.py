"""Benchmark passages in training documents, by winnowing, with DataFrame functions only.

Texts are hashed by runs of ``GRAM`` words; of every ``WINDOW - GRAM + 1`` consecutive
hashes the smallest is kept as a fingerprint.  Any span of ``WINDOW`` words that a document
shares with an item therefore has a fingerprint of either in common.

1. One scan keeps each document's fingerprints only long enough to meet those of the
   benchmark, and leaves one row per document with its word count and whether any met.
2. Documents with a met fingerprint are read again.  Each place of such a fingerprint is
   extended to all windows around it, and those windows' words are compared with the items'.
3. Covered words are counted from the hit windows as intervals.

Items of fewer than ``WINDOW`` words are one window of their own length; the few lengths
that occur are hashed at all places of the documents, so those hits are exact too.

Fingerprints use words in upper case, whose equality follows from that of words with A-Z
lower-cased; the comparison itself uses the latter.

Defined cases: a null text, or one without words, has no words and no hits, and as an
item it matches nothing; items that repeat an id count once; rows that repeat an id each
get their own result; a row without an id is treated as any other; an empty table on
either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.plans.order import cut_lineage

WINDOW = 10
GRAM = 5
#: Benchmark fingerprints are sent to all tasks up to this number (8 bytes each); beyond it both sides are shuffled.
BROADCAST_FINGERPRINTS = 500_000

#: Separators, given that letters of the text have one case.
_NOT_UPPER = r"[\x00-/:-@\[-\x7F]+"
_NOT_LOWER = r"[\x00-/:-`{-\x7F]+"


def _words(text: Column, separators: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def _exact_words(text: Column) -> Column:
    return _words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _NOT_LOWER)


def _hashes(text: Column) -> Column:
    return F.transform(_words(F.upper(text), _NOT_UPPER), lambda w: F.xxhash64(w))


def _places(n: Column, size: int) -> Column:
    """1 .. n - size + 1, or nothing."""
    return F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))


def _gram(hashes: Column, at: Column, gram: int) -> Column:
    return F.xxhash64(*(F.element_at(hashes, at + i) for i in range(gram)))


def _fingerprints(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Replace ``hashes`` by ``grams`` and ``prints``, the smallest gram of every ``window - gram + 1``.

    Each step is a column of its own, so no array is computed again inside a lambda.
    """
    width = window - gram + 1
    grams = rows.withColumn("grams", F.transform(_places(F.size("hashes"), gram), lambda i: _gram(F.col("hashes"), i, gram)))
    return grams.withColumn(
        "prints", F.array_distinct(F.transform(_places(F.size("grams"), width), lambda i: F.array_min(F.slice("grams", i, width))))
    )


def _short_print(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), F.slice(hashes, at, size))


def _short_prints(hashes: Column, size: int) -> Column:
    return F.array_distinct(F.transform(_places(F.size(hashes), size), lambda i: _short_print(hashes, i, size)))


def _short_windows(words: Column, size: int) -> Column:
    return F.transform(
        _places(F.size(words), size),
        lambda i: F.struct(i.alias("spot"), F.lit(size).alias("size"), F.array_join(F.slice(words, i, size), " ").alias("part")),
    )


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, size, spot, part): every window of every item, its place and words."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _exact_words(F.col("text")).alias("words"))
    words = words.withColumn("size", F.least(F.size("words"), F.lit(window))).where("size > 0")
    spots = words.select("item_id", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("spot"))
    return spots.select("item_id", "size", F.array_join(F.slice("words", F.col("spot"), F.col("size")), " ").alias("part")).distinct()


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs`` (doc_id, text).

    ``benchmark`` has item_id and text.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram must fit in the window")
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("key"), F.xxhash64("text", F.col("doc_id").isNull()).alias("sum"),
    )
    items = _items(benchmark, window)
    # The distinct lengths of short items: at most window - 1 numbers.
    short = sorted(r[0] for r in items.where(F.col("size") < window).select("size").distinct().collect())
    hashed = _fingerprints(benchmark.select(_hashes(F.col("text")).alias("hashes")), window, gram)
    # The outer form: the plain one would put the whole chain of arrays into a filter at the scan.
    wanted = hashed.select(F.explode_outer("prints").alias("print")).where("print IS NOT NULL")
    for size in short:
        whole = hashed.where(F.size("hashes") == size).select(_short_print(F.col("hashes"), F.lit(1), size).alias("print"))
        wanted = wanted.unionByName(whole)
    wanted = wanted.distinct()
    few = wanted.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS
    wanted = F.broadcast(wanted) if few else wanted

    # 1. Which documents meet a fingerprint of the benchmark.
    hashed = _fingerprints(docs.select("doc_id", "key", "sum", _hashes(F.col("text")).alias("hashes")), window, gram)
    prints = F.concat("prints", *(_short_prints(F.col("hashes"), size) for size in short))
    spread = hashed.select("doc_id", "key", "sum", F.size("hashes").alias("n_words"), F.explode_outer(prints).alias("print"))
    met = spread.join(wanted.withColumn("met", F.lit(1)), "print", "left")
    rows = cut_lineage(met.groupBy("doc_id", "key", "sum", "n_words").agg(F.coalesce(F.max("met"), F.lit(0)).alias("met")))

    # 2. The windows around the places of met fingerprints.
    suspects = rows.where("met = 1").select(F.col("key").alias("k"), F.col("sum").alias("s")).distinct()
    texts = docs.join(suspects, (F.col("key") == F.col("k")) & (F.col("sum") == F.col("s")), "left_semi")
    texts = texts.select("key", "sum", _hashes(F.col("text")).alias("hashes"), _exact_words(F.col("text")).alias("words"))
    grams = texts.withColumn("grams", F.transform(_places(F.size("hashes"), gram), lambda i: _gram(F.col("hashes"), i, gram)))
    reach = window - gram
    around = F.transform(
        _places(F.size("grams"), 1),
        lambda i: F.struct(
            F.element_at("grams", i).alias("print"), i.alias("at"), F.greatest(i - reach, F.lit(1)).alias("first"),
            F.least(i, F.size("words") - (window - 1)).alias("last"),
            F.slice("words", F.greatest(i - reach, F.lit(1)), F.lit(window + reach)).alias("near"),
        ),
    )
    places = grams.select("key", "sum", F.inline(around)).join(wanted, "print").where("first <= last")
    windows = places.select("key", "sum", "first", "near", F.explode(F.sequence("first", "last")).alias("spot"))
    windows = windows.select(
        "key", "sum", "spot", F.lit(window).alias("size"),
        F.array_join(F.slice("near", F.col("spot") - F.col("first") + 1, F.lit(window)), " ").alias("part"),
    )
    for size in short:
        windows = windows.unionByName(texts.select("key", "sum", F.inline(_short_windows(F.col("words"), size))))
    hits = cut_lineage(windows.distinct().join(items, ["size", "part"]).select("key", "sum", "spot", "size", "item_id"))

    # 3. Words covered by hit windows, and the items they belong to.
    order = Window.partitionBy("key", "sum").orderBy("spot", "size")
    before = F.coalesce(F.max(F.col("spot") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("spot") + F.col("size") - F.greatest(F.col("spot"), before))
    covered = hits.select("key", "sum", "spot", "size").distinct().withColumn("new", new)
    covered = covered.groupBy("key", "sum").agg(F.sum("new").alias("n_hit"))
    found = hits.select("key", "sum", "item_id").distinct().groupBy("key", "sum").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    counts = covered.join(found, ["key", "sum"])
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    # ``rows`` holds rows that are wholly equal once, so their number is brought back from the table.
    return (
        docs.select("doc_id", "key", "sum").join(rows.drop("doc_id", "met").distinct(), ["key", "sum"]).join(counts, ["key", "sum"], "left")
        .select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        )
    )
