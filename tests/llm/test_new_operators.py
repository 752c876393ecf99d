"""Source divergence, document fingerprints and vector codes against plain versions, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import catalog, codes, divergence, fingerprints

SF_DIR = "/root/testdata/sf0.001"


def prose(n, seed, words=300):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in rng.zipf(1.3, n) % words)


# Source divergence


def plain_divergence(rows, least_docs=3, ranks=200):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        langs[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))
        probability = {s: {t: p(counts[lang, s], t) for t in kept} for s in sources}
        typical = {t: p(whole, t) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(b, sum(f(probability[s][t], probability[b][t]) for t in kept)) for b in sources if b != s]
            terms = [(t, f(probability[s][t], typical[t])) for t in kept if counts[lang, s][t] and probability[s][t] > typical[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


ROWS = [(prose(60 + 30 * i, i), "en", f"s{i % 4}") for i in range(16)] + [
    (None, "en", "empty"), ("", "de", "a"), ("Wort wort WORT", "de", "b"), ("Écho écho 12 écho", "fr", "é"), ("écho a_b", "fr", "e"), ("écho", "fr", None),
    ("écho x", None, None), ("x", None, "s"), ("x", None, "s"), ("x y", None, "t"), ("123 --", "xx", "p"), ("4", "xx", "q"),
]


def divergence_rows(spark, rows, **options):
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    frame = frame.withColumns({n: F.lit("x") for n in ("term", "count", "block", "part", "value", "total")})
    return sorted(tuple(r) for r in divergence.source_divergence(frame, **options).collect())


@pytest.mark.parametrize("block", [divergence.BLOCK, 40])
def test_divergence(spark, block):
    got = divergence_rows(spark, ROWS, ranks=20, block=block)
    assert got == plain_divergence(ROWS, ranks=20) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_flushes_its_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    assert divergence_rows(spark, ROWS) == plain_divergence(ROWS)


def test_divergence_without_rows_or_terms(spark):
    assert divergence_rows(spark, []) == []
    assert divergence_rows(spark, [(None, None, None)]) == []
    assert divergence_rows(spark, [("a b", "en", "x"), ("a", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_pair_sums_compare_large_words_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    n = 200
    terms = rng.integers(0, 130, n)
    source, p = rng.integers(0, 5, n), rng.integers(1, 10**9, n)
    keys = {(s, t): q for s, t, q in zip(source, terms, p, strict=True)}
    entries = np.array([(s, q, t >> 6, np.uint64(1) << np.uint64(t & 63)) for (s, t), q in keys.items()], dtype=object)
    zero = rng.integers(1, 10**6, 5)
    args = [entries[:, i].astype(np.int64) for i in range(3)] + [entries[:, 3].astype(np.uint64), zero]
    want = np.zeros((5, 5), np.int64)
    for t in {t for _, t in keys}:
        v = [int(keys.get((s, t), zero[s])) for s in range(5)]
        want += np.array([[(a - b) * (a - b) // b for b in v] for a in v])
    for cells in (divergence.CELLS, 64):
        monkeypatch.setattr(divergence, "CELLS", cells)
        got = divergence.pair_sums(*args)
        assert ((got - want) * ~np.eye(5, dtype=bool) == 0).all()


# Document fingerprints


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(*values):
    """Spark's xxhash64 of longs (int) and ints (numpy.int32) and strings."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return _signed(seed)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return ""
    hashes = [_hash(w) for w in words]
    if len(words) < 5:
        shingles = [_hash(np.int32(len(words)), *hashes)]
    else:
        shingles = [_hash(*hashes[i : i + 5]) for i in range(len(words) - 4)]
    bins = {}
    for h in shingles:
        b = (h >> 56) + 128
        bins[b] = min(h, bins.get(b, h))
    low = []
    for b in range(256):
        tries = [_hash(np.int32(b), np.int32(t)) % 256 for t in range(6)]
        at = b if b in bins else next((t for t in tries if t in bins), None)
        if at is None:
            at = min(bins, key=lambda x: _hash(np.int32(b), np.int32(x), "order"))
        low.append(bins[at] & 255)
    return "".join(bytes(low[i : i + 8][::-1]).hex() for i in range(0, 256, 8))


def likeness(a, b):
    if not a or not b:
        return float(a == b)
    equal = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 512, 2)) / 256
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


def plain_rows(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = sorted((d is None, d or 0, sha(t or ""), t or "") for d, t in rows)
    out = []
    for i, (no_id, doc, _, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (plain_fingerprint(t) for t in (text, edited, after))
        out.append((None if no_id else doc, len(text), sha(edited), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


TEXTS = [(i, prose(40 * i + 1, 100 + i)) for i in range(12)] + [
    (20, prose(9_000, 7)), (21, prose(9_000, 7)), (22, None), (23, ""), (24, " \n"), (25, "One two"), (26, "one TWO"), (27, "ß é 日本 🙂 x"), (27, "other"),
    (28, "same"), (28, "same"), (28, "same"), (None, "no id"), (None, "no id"), (None, None), (-5, "first of all"),
]


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:1], [(1, "a b c")] * 3, []])
def test_fingerprints(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("id", "sum", "block", "bounds", "at", "copies", "key")})
    got = [tuple(r)[:5] + (round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.document_fingerprints(frame).collect()]
    assert sorted(got, key=str) == plain_rows(rows)


def test_fingerprints_estimate_similarity(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    rows = sorted((r.doc_id, r.text or "") for r in rows)
    got = {r.doc_id: r for r in catalog.queries()["op12_document_fingerprints"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    off = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        a, b = shingles(text), shingles(text[: len(text) - half] + after[:half])
        off.append(got[doc].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.02 and np.mean(np.abs(off)) < 0.04


# Vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2, factor=256):
    kept = [(i, tuple(int(np.floor(factor * x)) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for turn in range(rounds + 1):
        found = [[near(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                    if mine:
                        books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=str
    )


def vectors(n, seed, size=32, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, size)], int(i % 3) if i % 5 else None) for i in rng.permutation(n)]


def code_rows(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.withColumns({n: F.lit("x") for n in ("vector", "entry", "distance", "error", "code", "size")})
    return sorted((tuple(r) for r in codes.compressed_vectors(frame).collect()), key=str)


ODD = [(500, None, 1), (501, [None] + [0.0] * 31, 1), (502, [float("nan")] * 32, 1), (503, [float("-inf")] + [1.0] * 31, 2), (None, [0.25] * 32, 1)]


@pytest.mark.parametrize("rows", [vectors(300, 1) + ODD, vectors(300, 2, spread=0.004), vectors(20, 3), [(i, [0.5] * 16, None) for i in range(100)], ODD[:4], []])
def test_codes(spark, rows):
    assert code_rows(spark, rows) == plain_codes(rows)


def test_codes_leave_out_other_lengths(spark):
    rows = vectors(80, 4)
    assert code_rows(spark, rows + [(900, [1.0] * 16, 1), (901, [1.0] * 7, 1), (902, [], 1)]) == plain_codes(rows)


def test_only_moved_entries_decide():
    """Updating by moved entries equals comparing all, with ties, whatever moved."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        before, parts = rng.integers(-2, 3, (8, 2)), rng.integers(-2, 3, (50, 2))
        after = before.copy()
        some = rng.random(8) < rng.random()
        after[some] = rng.integers(-2, 3, (int(some.sum()), 2))
        got = codes.reassign(parts, after, (after != before).any(axis=1), *codes.nearest(parts, before))
        assert all(map(np.array_equal, got, codes.nearest(parts, after)))


def test_large_components_are_exact():
    parts, entries = np.array([[1 << 26, -(1 << 26)]]), np.array([[-(1 << 26), 1 << 26], [(1 << 26) - 1, 0]])
    assert codes.distances(parts, entries).tolist() == [[2 * (1 << 27) ** 2, 1 + (1 << 26) ** 2]]


# Long words


def _twins(n):
    """Two unequal strings of n letters that sums of value * base**i modulo 2^64 do not tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1 << 10, 1 << 11, 1 << 12])
def test_long_words_do_not_collide(spark, n):
    import brute
    import pyarrow as pa
    from tokenizers import Tokenizer

    from fieldloom.llm import encoding, near_dedup, repeats

    s, t = _twins(n)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = catalog.tokenizer_path(name)
        tokenizer = Tokenizer.from_file(path)
        texts = ["x " + s, "x " + t, "X " + t, "x " + s]
        got = [r.tolist() for r in encoding.Encoder(path).rows(pa.array(texts))]
        assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    rest = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{s} {rest}"), (2, f"{t} {rest}"), (3, s), (4, t), (5, s.upper()), (6, s)]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: c for d, (_, c, _) in brute.near_duplicates(rows).items()} and found[4] == 4 and found[5] == found[6] == 3
    rows = [(1, s + " " + " ".join(["y"] * 49)), (2, t + " " + " ".join(["y"] * 49))]
    removed = {r.doc_id: r.n_removed for r in repeats.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert removed == {1: 0, 2: 0}
