"""Toxicity of a text by a weighted lexicon.

Texts are folded first: lower case, look-alike characters and digits written for letters
become the letters, all else becomes single spaces.  The lexicon's terms, whole words
and stems, are found by one Aho-Corasick automaton; a hit inside an exception phrase does
not count.  The sum of the weights and its ratio to the root of the number of words
enter a logistic curve.

Terms, weights, exceptions and the curve are learned from a bounded sample of labelled
rows, in which near copies count once: a weight is the log ratio of the shares of toxic and clean documents that hold the
term, less one standard error; a term must be more frequent in toxic documents than
chance explains; an exception is a word pair around a term that occurs in clean documents
almost alone.  The curve is fitted on one half of the sample with a lexicon of the other.

Defined cases: a null or empty text has no words and gets the score of a text without
hits; labels that are null are not learned from; an id with several labels is toxic if one
says so; repeated rows are scored each; without toxic or without clean labels the lexicon
is empty; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm.grams import SPACE, disguised, letters
from fieldloom.llm.hashing import text_chunks
from fieldloom.llm.language_id import remainder
from fieldloom.llm.near_dedup import shingle_sets
from fieldloom.plans.order import cut_lineage

#: Expected rows of each label in the sample, by a hash of the id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
#: Letters of a stem; the documents a term needs; its least weight; terms and exceptions at most.
STEM = range(4, 9)
LEAST_DOCS, LEAST_WEIGHT, MOST_TERMS, MOST_EXCEPTIONS = 3, 1.0, 5_000, 5_000
#: Log likelihood ratio that a term needs against chance, about the logarithm of the number of terms.
LEAST_EVIDENCE = 10.0
THRESHOLD = 0.3


@dataclass
class Lexicon:
    """Terms begin with a space; a whole word ends with one, a stem does not."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)


def automaton(lexicon: Lexicon):
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        out.add_word(phrase, (len(phrase), None))
    for term, weight in lexicon.terms.items():
        out.add_word(term, (len(term), weight))
    out.make_automaton()
    return out


def folded_chunks(column: pa.Array):
    """(folded text of all rows, row starts, words of each row) by chunks."""
    for _, _, data, offsets in text_chunks(column):
        codes, starts = letters(data, offsets, disguised)
        begins = np.zeros(len(codes), np.int64)
        begins[1:] = (codes[1:] != SPACE) & (codes[:-1] == SPACE)
        yield codes.astype("<u4").tobytes().decode("utf-32-le"), starts, np.add.reduceat(begins, starts)


def features(column: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(sum of weights of the hits, number of words) of each row."""
    sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
    matcher = automaton(lexicon) if lexicon.terms else None
    for text, starts, words in folded_chunks(column):
        total = np.zeros(len(starts))
        hits, excused = [], []
        for end, (size, weight) in matcher.iter(text) if matcher else ():
            (excused if weight is None else hits).append((end - size + 1, end, weight))
        if excused:
            begins = np.array([a for a, _, _ in excused])
            order = np.argsort(begins, kind="stable")
            begins, reach = begins[order], np.maximum.accumulate(np.array([e for _, e, _ in excused])[order])
            hits = [h for h in hits if (i := np.searchsorted(begins, h[0], side="right") - 1) < 0 or reach[i] < h[1]]
        if hits:
            np.add.at(total, np.searchsorted(starts, [a for a, _, _ in hits], side="right") - 1, [w for _, _, w in hits])
        sums.append(total)
        sizes.append(words)
    return np.concatenate(sums), np.concatenate(sizes)


def design(sums: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The curve's inputs: a constant, the sum of weights, and the same by length."""
    return np.stack([np.ones(len(sums)), np.log1p(sums), sums / np.sqrt(np.maximum(words, 1))], axis=1)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of a sample; its ids, bounded by the sample sizes, go to all tasks."""
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    place, wanted = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), F.lit(False)
    for toxic, size in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        if counts.get(toxic):
            wanted = wanted | ((F.col("toxic") == toxic) & (place < min(1 << 32, -(-size * (1 << 32) // counts[toxic]))))
    found = docs.join(F.broadcast(labels.where(wanted)), "doc_id").select("text", "toxic")

    def marked(batches):
        for batch in batches:
            sets = [v if len(v) else np.zeros(1, np.uint64) for v in shingle_sets(batch.column("text"))]
            yield pa.record_batch({
                "text": batch.column("text"), "toxic": batch.column("toxic").cast(pa.int32()),
                **{f"m{i}": pa.array(np.array([v[min(i, len(v) - 1)] if i < 2 else v[-i + 1] if len(v) >= i else v[0] for v in sets]).view(np.int64)) for i in range(4)},
            })

    # Near copies would make all their words look toxic: of texts that share the smallest, second,
    # largest or second largest shingle hash one stays.
    found = found.mapInArrow(marked, "text string, toxic int, m0 long, m1 long, m2 long, m3 long")
    for i in range(4):
        found = found.groupBy(f"m{i}").agg(F.max(F.struct("toxic", "text", "m0", "m1", "m2", "m3")).alias("one")).select("one.*")
    return cut_lineage(found.select("text", "toxic"))


def _counted(sample: DataFrame, terms_of) -> DataFrame:
    """(term, toxic_docs, clean_docs): texts of either label that hold each term given by ``terms_of``."""

    def count(batches):
        counts = Counter(), Counter()
        for batch in batches:
            toxic = iter(batch.column("toxic").to_pylist())
            for text, starts, _ in folded_chunks(batch.column("text")):
                for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
                    counts[next(toxic)].update(terms_of(text[a:b]))
        names = sorted(set(counts[0]) | set(counts[1]))
        yield pa.record_batch({
            "term": pa.array(names, pa.string()), "toxic_docs": pa.array([counts[1][t] for t in names], pa.int64()),
            "clean_docs": pa.array([counts[0][t] for t in names], pa.int64()),
        })

    found = sample.mapInArrow(count, "term string, toxic_docs long, clean_docs long")
    return found.groupBy("term").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def _words_and_stems(text: str) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM if len(w) >= n}


def _choose(found: list, weigh) -> dict[str, float]:
    """Of nested terms, the longest that keeps nearly all documents, and nothing that it covers."""
    docs = {r["term"]: r["toxic_docs"] for r in found}
    weights = {r["term"]: weigh(r["toxic_docs"], r["clean_docs"]) for r in found}
    longer: dict[str, int] = {}
    for term, n in docs.items():
        for cut in range(STEM.start + 1, len(term)):
            stem = term[:cut]
            if stem in docs:
                longer[stem] = max(longer.get(stem, 0), n)
    kept: dict[str, float] = {}
    for term in sorted(docs, key=lambda t: (len(t), t)):
        if longer.get(term, 0) >= 0.95 * docs[term]:
            continue
        if any(term[:cut] in kept for cut in range(STEM.start + 1, len(term))):
            continue
        kept[term] = weights[term]
    return kept


def _lexicon(sample: DataFrame) -> Lexicon:
    """Terms, weights and exceptions from (text, toxic)."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()

    def weigh(toxic, clean, maths=np):
        return (
            maths.log((toxic + 0.5) / (n_toxic + 1)) - maths.log((clean + 0.5) / (n_clean + 1))
            - maths.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        )

    terms = _counted(sample, _words_and_stems).where(F.col("toxic_docs") >= LEAST_DOCS)
    toxic, clean, rate = F.col("toxic_docs"), F.col("clean_docs"), n_toxic / (n_toxic + n_clean)
    evidence = toxic * F.log(toxic / ((toxic + clean) * rate)) + F.when(
        clean > 0, clean * F.log(clean / ((toxic + clean) * (1 - rate)))
    ).otherwise(0.0)
    terms = terms.withColumn("weight", weigh(toxic, clean, F)).where((F.col("weight") >= LEAST_WEIGHT) & (evidence >= LEAST_EVIDENCE))
    found = terms.orderBy(F.desc("weight"), "term").limit(MOST_TERMS).collect()
    lexicon = Lexicon(_choose(found, lambda t, c: float(weigh(t, c))))
    if lexicon.terms:
        matcher = automaton(lexicon)

        def pairs(text: str) -> set[str]:
            out = set()
            for end, (size, _) in matcher.iter(text):
                start = end - size + 1
                stop = text.find(" ", start + 1)
                before, after = text.rfind(" ", 0, max(start, 0)), text.find(" ", stop + 1)
                out |= {text[before : stop + 1]} if 0 <= before < start - 1 else set()
                out |= {text[start : after + 1]} if after > stop + 1 else set()
            return out

        excused = _counted(sample, pairs).where(F.col("clean_docs") >= F.greatest(F.lit(LEAST_DOCS), F.col("toxic_docs") * 9))
        lexicon.exceptions = [r["term"] for r in excused.orderBy(F.desc("clean_docs"), "term").limit(MOST_EXCEPTIONS).collect()]
    return lexicon


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from documents (doc_id, text) and labels (doc_id, toxic) that may be learned from."""
    sample = _sample(docs, labels)
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    other = _lexicon(sample.where(half == 0))

    def measure(batches):
        for batch in batches:
            sums, words = features(batch.column("text"), other)
            yield pa.record_batch({"sums": pa.array(sums), "words": pa.array(words), "toxic": batch.column("toxic").cast(pa.int32())})

    rows = sample.where(half == 1).mapInArrow(measure, "sums double, words long, toxic int").orderBy("sums", "words", "toxic").toPandas()
    lexicon = _lexicon(sample)
    if rows["toxic"].nunique() == 2:
        lexicon.curve = _fit(design(rows["sums"].to_numpy(), rows["words"].to_numpy()), rows["toxic"].to_numpy())
    return lexicon


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small quadratic penalty; slopes are not negative."""
    w = np.zeros(x.shape[1])
    free = np.ones(x.shape[1], dtype=bool)
    for _ in range(3):
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ w[free], -30, 30)))
            h = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + penalty * np.eye(free.sum())
            step = np.linalg.solve(h, x[:, free].T @ (p - y) + penalty * w[free])
            w[free] -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & (w < 0)
        wrong[0] = False
        if not wrong.any():
            break
        free &= ~wrong
        w[~free] = 0
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""

    def judge(batches):
        for batch in batches:
            sums, words = features(batch.column("text"), lexicon)
            logit = design(sums, words) @ np.array(lexicon.curve)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))})

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame, fold: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labels outside the held-out fold of ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    found = score(docs, learn(docs, labels.where(remainder(fold) != held_out)))
    return found.select(
        "doc_id", F.coalesce(remainder(fold) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
