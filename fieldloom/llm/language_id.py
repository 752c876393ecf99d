"""Language of a text by sparse multinomial logistic regression on letter n-grams.

Features are hashed letter n-grams, weighted by the root of their count, so that a line
repeated a thousand times does not drown the rest, and the inverse document frequency
over all learning rows; a text's weights have one length.  The model is trained by
follow-the-regularised-leader with an elastic-net penalty on a bounded sample of the
learning rows, and one temperature, fitted on rows of the sample that training leaves
out, calibrates its probabilities.  A prediction reads the whole text and nothing else.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is
every text if there are no learning rows; rows with a null language or id are never
learned from, but predicted; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldloom.llm.grams import gram_chunks
from fieldloom.llm.memory import returning

SIZES = (1, 2, 3)
BITS = 15
#: Expected rows of the training sample (by a hash of the id), of a language at least, and languages at most.
SAMPLE_ROWS, LEAST_ROWS, MOST_LANGUAGES = 6_000, 300, 500
EPOCHS = 2
#: Follow-the-regularised-leader: step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SCALE = 5.0
UNKNOWN = "und"
#: A score below this is no trustworthy language.
LEAST_SCORE = 0.35


def features(hashes: list[np.ndarray], start: int, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed grams of a row, root of the count of each)."""
    counts = np.bincount(np.concatenate([h[start : start + grams] for h in hashes]), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, np.sqrt(counts[found])


def weighted(grams: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf[grams]
    return x * (SCALE / max(float(np.sqrt(x @ x)), 1e-12))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # hashed gram by language
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each language, number of letters) of each row."""
        out, found = [np.zeros((0, len(self.languages)))], [np.zeros(0, np.int64)]
        for rows, hashes, starts, grams, letters in gram_chunks(column, SIZES, BITS):
            logits = np.empty((rows, len(self.languages)))
            for i in range(rows):
                ids, tf = features(hashes, starts[i], grams[i])
                logits[i] = self.bias + weighted(ids, tf, self.idf) @ self.weights[ids]
            out.append(softmax(logits / self.temperature))
            found.append(letters)
        return np.concatenate(out), np.concatenate(found)


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each hashed gram, and how many texts there are; at most 2**BITS rows reach the driver."""

    def count(batches):
        seen_in, texts = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for n, hashes, starts, grams, _ in gram_chunks(batch.column("text"), SIZES, BITS):
                for i in range(n):
                    seen = np.zeros(1 << BITS, dtype=bool)
                    for h in hashes:
                        seen[h[starts[i] : starts[i] + grams[i]]] = True
                    seen_in += seen
                texts += n
        used = np.flatnonzero(seen_in)
        yield pa.record_batch({"gram": pa.array(np.append(used, -1), pa.int32()), "n": pa.array(np.append(seen_in[used], texts), pa.int64())})

    counts = rows.select("text").mapInArrow(returning(count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    found = {r["gram"]: r["n"] for r in counts}
    out = np.zeros(1 << BITS, np.int64)
    total = found.pop(-1, 0)
    for gram, n in found.items():
        out[gram] = n
    return out, total


def _sample(rows: DataFrame, languages: dict[str, int]) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(order, language, grams, roots of counts) of the sampled rows."""
    cut = None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    total = sum(languages.values())
    for name, n in languages.items():  # in proportion, so that the model knows how frequent a language is
        size = max(LEAST_ROWS, SAMPLE_ROWS * n // total)
        wanted = (F.col("lang") == name) & (place < min(1 << 32, -(-size * (1 << 32) // n)))
        cut = wanted if cut is None else cut | wanted

    def featurise(batches):
        for batch in batches:
            grams_of, tf_of = [], []
            for n, hashes, starts, grams, _ in gram_chunks(batch.column("text"), SIZES, BITS):
                for i in range(n):
                    ids, tf = features(hashes, starts[i], grams[i])
                    grams_of.append(ids.astype("<u2" if BITS <= 16 else "<u4").tobytes())
                    tf_of.append(tf.astype("<f4").tobytes())
            yield pa.record_batch({
                "place": batch.column("place"), "lang": batch.column("lang"),
                "grams": pa.array(grams_of, pa.binary()), "tf": pa.array(tf_of, pa.binary()),
            })

    found = rows.where(cut).select(place.alias("place"), "lang", "text").mapInArrow(
        returning(featurise), "place long, lang string, grams binary, tf binary"
    )
    out = [
        (r["place"], r["lang"], np.frombuffer(r["grams"], "<u2" if BITS <= 16 else "<u4"), np.frombuffer(r["tf"], "<f4"))
        for r in found.toLocalIterator()
    ]
    return sorted(out, key=lambda r: (r[0], r[1], r[2].tobytes()))


def _train(rows: list, idf: np.ndarray, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by follow-the-regularised-leader, one row at a time."""
    number = {name: i for i, name in enumerate(languages)}
    size = len(idf) + 1  # the last feature is the bias
    z, n = np.zeros((size, len(languages))), np.zeros((size, len(languages)))

    def weights_of(at):
        zs = z[at]
        shrunk = np.sign(zs) * L1 - zs
        return np.where(np.abs(zs) > L1, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for _, name, grams, tf in rows:
            at = np.append(grams, size - 1)
            x = np.append(weighted(grams, tf, idf), 1.0)
            w = weights_of(at)
            p = softmax(x @ w)
            p[number[name]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights_of(np.arange(size))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t):
        return -np.log(np.maximum(softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth], 1e-12)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(rows: DataFrame) -> Model | None:
    """A model from rows with doc_id, text and lang, none of them null; None without rows."""
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    seen_in, texts = document_frequencies(rows)
    idf = np.log((1 + texts) / (1 + seen_in)) + 1
    sample = _sample(rows, {r["lang"]: r["count"] for r in counts})
    held = [r for i, r in enumerate(sample) if i % 5 == 4]
    weights, bias = _train([r for i, r in enumerate(sample) if i % 5 != 4], idf, languages)
    logits = np.array([weighted(g, tf, idf) @ weights[g] + bias for _, _, g, tf in held]).reshape(len(held), len(languages))
    return Model(languages, weights, bias, idf, _temperature(logits, np.array([languages.index(r[1]) for r in held], np.int64)))


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, lang_pred and score of every row; ``text`` is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").cast("string").alias("text"))

    def judge(batches):
        model = shared.value
        for batch in batches:
            kept = {n: batch.column(n) for n in names}
            if model is None:
                best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p, letters = model.probabilities(batch.column("text"))
                best = [model.languages[i] if n else UNKNOWN for i, n in zip(p.argmax(axis=1), letters, strict=True)]
                score = np.where(letters > 0, p.max(axis=1), 0.0)
            yield pa.record_batch({**kept, "lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())})

    schema = ", ".join([*(f"{n} {t}" for n, t in rows.drop("text").dtypes), "lang_pred string", "score double"])
    found = rows.mapInArrow(returning(judge), schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "lang_pred", "score")


def remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def identify_languages(docs: DataFrame, fold: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from labelled rows outside the held-out fold of ids."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    model = learn(rows.where((remainder(fold) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    found = predict(rows, model)
    return found.select("doc_id", F.coalesce(remainder(fold) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
