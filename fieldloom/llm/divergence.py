"""How far the sources of a language differ in their words, by bitsets of terms for each count.

1. One pass over the texts counts the terms of each (lang, source) group and the documents
   that hold them, in tables of bounded size inside a task, before anything is shuffled.
2. Kept terms get a place in a block of their language: blocks are dealt by a hash, so
   none is large, and inside a block terms stand by falling frequency, so that terms of
   like counts are neighbours.
3. A group's terms of equal count are a bitset, held as its 64-bit words that are not empty.
   The terms with counts c in one group and d in another are the AND of two bitsets; its
   population count, times the value that belongs to (c, d), adds up to the value of the
   pair.  A group's terms of count zero are never stored: they are the complement of its
   bitsets, so their cells follow from the others by subtraction.

All arithmetic is on integers.

Defined cases: a null text, language or source is an empty string; a text without terms
still makes its group occur; a language that keeps no term gives each pair of its
sources the value 0; rows that repeat an id are documents of their own; ties are ordered
by the item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.llm.tables import stored

#: Documents of a language that must hold a term, and ranks of part ``term``.
LEAST_DOCS, RANKS = 3, 200
#: Probabilities are multiples of one part in so many.
SCALE = 1_000_000_000
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: (group, term) counts that meet in one block, about.
BLOCK = 1 << 14
#: Pairs of bitset words that are compared at a time.
CELLS = 1 << 21

#: A-Z become a-z; letters and all bytes of characters beyond ASCII stay; the rest separates terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

_COUNTS = "lang string, source string, term string, count long, docs long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term and document counts of the groups."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in counts.items():
            n = len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                    pa.array(list(words), pa.binary()).cast(pa.string()),
                    pa.array(list(words.values()), pa.int64()), pa.array([docs[w] for w in words], pa.int64()),
                ],
                ["lang", "source", "term", "count", "docs"],
            )
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = text.translate(_TERM_BYTES).split()
            words, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(words)
            words.update(terms)
            docs.update(set(terms))
            held += len(words) - before
            if held > HELD:
                yield from rows()
                held = 0
    yield from rows()


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(source: np.ndarray, p: np.ndarray, word: np.ndarray, bits: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Summed divergence of each pair of sources over the terms of a block.

    An entry is one 64-bit ``word`` of the ``bits`` of terms that have probability ``p`` in
    a ``source`` (a number); ``zero`` has each source's probability of a term it lacks.
    Every term of the block has an entry in some source.
    """
    n = len(zero)
    sums = np.zeros((n, n), np.int64)
    zeros = _divergence(zero[:, None], zero[None, :])
    order = np.lexsort((source, word))
    source, p, word, bits = source[order], p[order], word[order], bits[order]
    cuts = np.flatnonzero(np.diff(word, prepend=-1)).tolist() + [len(word)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s, prob, b64 = source[a:b], p[a:b], bits[a:b]
        terms = int(np.bitwise_count(np.bitwise_or.reduce(b64)))
        size = np.bitwise_count(b64).astype(np.int64)
        starts = np.flatnonzero(np.diff(s, prepend=-1))
        support = np.zeros(n, np.int64)
        support[s[starts]] = np.add.reduceat(size, starts)
        both = np.zeros((n, n), np.int64)
        step = max(1, CELLS // len(s))
        for first in range(0, len(s), step):
            part = slice(first, first + step)
            joint = np.bitwise_count(b64[part, None] & b64[None, :]).astype(np.int64)
            value = np.add.reduceat(joint * _divergence(prob[part, None], prob[None, :]), starts, axis=1)
            shared = np.zeros((len(joint), n), np.int64)
            shared[:, s[starts]] = np.add.reduceat(joint, starts, axis=1)
            # Terms of this entry that the other source lacks.
            lone = size[part, None] - shared
            np.add.at(sums, (s[part, None], s[starts][None, :]), value)
            np.add.at(sums, s[part], lone * _divergence(prob[part, None], zero[None, :]))
            np.add.at(sums.T, s[part], lone * _divergence(zero[None, :], prob[part, None]))
            np.add.at(both, s[part], shared)
        sums += (terms - support[:, None] - support[None, :] + both) * zeros
    return sums


def _block_sums(table: pa.Table) -> pa.Table:
    names = table.column("source").combine_chunks().dictionary_encode()
    code = names.indices.to_numpy().astype(np.int64)
    p, word, bits = (table.column(c).to_numpy() for c in ("p", "word", "bits"))
    empty = word < 0
    zero = np.ones(len(names.dictionary), np.int64)
    zero[code[empty]] = p[empty]
    full = ~empty
    sums = pair_sums(code[full], p[full], word[full].astype(np.int64), np.ascontiguousarray(bits[full]).view(np.uint64), zero)
    a, b = np.nonzero(~np.eye(len(zero), dtype=bool))
    lang = table.column("lang")[0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "source": names.dictionary.take(pa.array(a)).cast(pa.string()),
        "item": names.dictionary.take(pa.array(b)).cast(pa.string()), "value": pa.array(sums[a, b]),
    })


def _probability(count: Column, total: Column, terms: Column) -> Column:
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(18,0)") + F.lit(1).cast("decimal(1,0)"))
    return F.call_function("div", scaled, (total + terms).cast("decimal(18,0)")) + 1


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs)."""
    read = _texts(docs, "lang", "source", "text").withColumn("text", F.col("text").cast("binary"))
    counts = read.mapInArrow(_count_terms, _COUNTS)
    return counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair`` ranks the other sources of the language by how far the source's term
    probabilities lie from theirs; part ``term`` ranks, up to ``ranks``, the terms that are
    likelier in the source than in the whole language.
    """
    # A window holds the counts of one term: a row for each source of the language.
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({
        "lang_count": F.sum("count").over(term), "lang_docs": F.sum("docs").over(term),
        "once": F.row_number().over(term.orderBy("source")) == 1,
    })
    entries = stored(counts.where(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs"), "divergence-terms")
    langs = stored(
        entries.groupBy("lang").agg(
            F.count_if("once").alias("terms"), F.sum(F.when(F.col("once"), F.col("lang_count"))).alias("lang_total"),
            F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
        ),
        "divergence-languages",
    )
    totals = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = _texts(docs, "lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0, ["total"]).fillna(1, ["blocks"]), "divergence-groups")

    total, terms = F.col("total"), F.col("terms")
    known = entries.join(groups, ["lang", "source"]).withColumn("p", _probability(F.col("count"), total, terms))
    q = _probability(F.col("lang_count"), F.col("lang_total"), terms)
    typical = known.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    # A block holds a bounded number of terms, whatever the language's share of the table.
    dealt = known.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    dealt = dealt.select("lang", "source", "term", "count", "lang_count", "p", "block").repartition("lang", "block")
    place = F.dense_rank().over(Window.partitionBy("lang", "block").orderBy(F.desc("lang_count"), "term")) - 1
    bit = F.expr("shiftleft(1L, place & 63)")
    words = dealt.withColumn("place", place).groupBy("lang", "block", "source", "count", F.shiftright("place", 6).alias("word"))
    words = words.agg(F.first("p").alias("p"), F.bit_or(bit).alias("bits"))
    # The complement of a group's bitsets: one row for each block, with the probability of a term it lacks.
    lacking = groups.select(
        "lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(-1).alias("word"),
        F.coalesce(_probability(F.lit(0), total, terms), F.lit(1)).alias("p"), F.lit(0).cast("long").alias("bits"),
    )
    levels = words.select(*lacking.columns).unionByName(lacking)
    sums = levels.groupBy("lang", "block").applyInArrow(_block_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.withColumns({"part": F.lit("pair"), "rank": rank}).select(*columns)
    best = typical.withColumn("rank", rank).where(F.col("rank") <= ranks).withColumn("part", F.lit("term")).select(*columns)
    return ranked.unionByName(best)
