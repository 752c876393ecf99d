"""Candidate selection: documented cases and equality with brute force."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import similarity
from fieldloom.functions.similarity import NameBlock, Prefixes, Substrings, Summary
from fieldloom.operators import entities as e

REAL = [
    ("Technische Universität München", ["TUM", "TU München"]), ("Technische Universität Berlin", ["TU Berlin"]),
    ("Europäisches Hochschulinstitut", ["EUI", "European University Institute"]), ("Universität Hamburg", ["UHH"]), ("Freie Universität Berlin", ["FU Berlin"]),
]


def tables(spark, rows):
    ents = spark.createDataFrame([(i, "university", n) for i, (n, _) in enumerate(rows)], "entity_id long, entity_type string, canonical_name string")
    vars_ = spark.createDataFrame([(i, v) for i, (_, vs) in enumerate(rows) for v in vs], "entity_id long, variant_name string")
    return ents, vars_


def candidates(spark, rows, texts, k=50, **blocks):
    ents, vars_ = tables(spark, rows)
    mentions = spark.createDataFrame([(t,) for t in texts], "text string")
    out = {}
    for r in e.entity_candidates(mentions, ents, vars_, k, **blocks).orderBy("text", "rank").collect():
        out.setdefault(r["text"], []).append((r["entity_id"], r["score"]))
    return out


def score(text, names):
    needle, best = text.lower().strip(), 0.0
    if not needle:
        return 0.0
    words = set(re.findall(r"\w+", needle))
    for name in (n.lower().strip() for n in names):
        if not name:
            continue
        if name == needle:
            return 1.0
        inside = 0.8 if needle in name or name in needle else 0.0
        theirs = set(re.findall(r"\w+", name))
        shared = 0.7 * (len(words & theirs) / len(words | theirs)) if words and theirs else 0.0
        best = max(best, inside, shared, 0.6 * SequenceMatcher(None, needle, name).ratio())
    return best


def test_target_found_in_a_large_inventory(spark):
    rows = [(f"Platzhalter Institut {i:04d}", []) for i in range(2000)] + [REAL[0]]
    texts = ["TU München", "TUM", "Technische Universität München", "Techn. Univ. Muenchen", "Bäckerei Schmidt"]
    got = candidates(spark, rows, texts)
    assert all(len(got[t]) == 50 for t in texts)
    assert all(2000 in [i for i, _ in got[t]] for t in texts[:4])


def test_variant_and_closest_come_first(spark):
    rows = REAL + [(f"Füller {i}", []) for i in range(60)]
    got = candidates(spark, rows, ["EUI", "TU Berlin"])
    assert got["EUI"][0][0] == 2 and got["TU Berlin"][0][0] == 1


def test_small_inventory_is_unchanged(spark):
    got = candidates(spark, REAL, ["EUI", "x"])
    assert [i for i, _ in got["x"]] == [0, 1, 2, 3, 4] == [i for i, _ in got["EUI"]]


@pytest.mark.parametrize("blocks", [{}, {"block_mentions": 7, "block_names": 40}])
def test_pruned_result_equals_brute_force(spark, blocks):
    rnd = random.Random(5)
    vocabulary = ["universität", "institut", "berlin", "ulm", "für", "technik", "tu", "hochschule", "der", "kunst"]
    name = lambda: " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 4))) + rnd.choice(["", " 1", "x"])
    rows = [(name(), [name() for _ in range(rnd.randint(0, 2))]) for _ in range(120)] + [("y" * 90 + name(), [])]
    texts = [name().title() for _ in range(20)] + ["zzz", " Ulm ", "a" * 70 + " institut " + "b" * 30]
    got = candidates(spark, rows, texts, k=10, **blocks)
    for text in texts:
        want = sorted(((i, score(text, [n, *v])) for i, (n, v) in enumerate(rows)), key=lambda p: (-p[1], p[0]))[:10]
        assert got[text] == want


def test_same_name_goes_to_the_smallest_entity(spark):
    ents, vars_ = tables(spark, [("A", ["shared"]), ("Shared ", []), ("B", ["b", "A"])])
    index = {r["key"]: (r["entity_id"], r["by_variant"]) for r in e.name_index(ents, vars_).collect()}
    assert index == {"a": (0, False), "shared": (0, True), "b": (2, False)}


def test_decisions(spark):
    ents, vars_ = tables(spark, REAL)
    rows = ["MATCH: TUM (Confidence: 0.95)", "MATCH: tum (Confidence: 0.7)", "LIKELY: ghost (Confidence: 0.1)", "MATCH: TUM", "MATCH: ghost (Confidence: 0.99)", None]
    df = spark.createDataFrame([(i, "university", a) for i, a in enumerate(rows)], "mention_id long, entity_type string, answer string")
    got = [(r["entity_id"], r["action"], r["confidence"]) for r in e.normalization_decision(df, e.name_index(ents, vars_)).orderBy("mention_id").collect()]
    assert got == [(0, "auto_link", 0.95), (0, "review_queue", 0.7), (None, "review_queue", 0.1), (None, "ignore", 0.5), (None, "auto_link", 0.99), (None, "review_queue", 0.0)]


def test_institution_fields_are_the_fallback(spark):
    prompts = spark.createDataFrame([(1, "name", None), (2, "Host_University", None)], "prompt_id long, internal_name string, entity_type string")
    assert [r[0] for r in e.link_prompts(prompts, "university").collect()] == [2]
    assert [r[0] for r in e.link_prompts(prompts.withColumn("entity_type", F.lit("university")), "university").orderBy("prompt_id").collect()] == [1, 2]


def _spellings(seed, n):
    rnd = random.Random(seed)
    words = ["universität", "institut", "berlin", "ulm", "für", "technik", "tu", "hochschule", "der", "kunst"]
    return [" ".join(rnd.choices(words, k=rnd.randint(1, 4))) + rnd.choice(["", " 1", "x"]) for _ in range(n)]


@pytest.mark.parametrize("floor", [-1.0, 0.5])
def test_a_block_equals_brute_force(floor):
    """Names of several cells, some with 200 letters and more, for which difflib drops frequent letters."""
    rows = [(i // 2, n) for i, n in enumerate(_spellings(1, 300))] + [(500, "a" * 250 + " institut"), (501, "b" * 199), (502, "ab ab " * 40 + "ab")]
    block = NameBlock([i for i, _ in rows], [n for _, n in rows])
    for needle in [*_spellings(2, 25), "zzz", "ulm", "a" * 70 + " institut " + "b" * 30, "ß日本", "a" * 300 + " institut", "ab " * 80 + "ab", ""]:
        best = {}
        for i, n in rows:
            best[i] = max(best.get(i, 0.0), score(needle, [n]))
        want = sorted(((i, s) for i, s in best.items() if s >= floor), key=lambda p: (-p[1], p[0]))[:10]
        got = block.best(needle, 10, floor)
        assert got == want if needle else got == [(i, 0.0) for i in range(10)]


def test_bounds_hold():
    """No name of a block or cell scores more than its bound."""
    names = _spellings(3, 200) + ["x" * 240, "sup-1"]
    block = NameBlock(range(len(names)), names)
    shortest, longest, counts, words = block.summary()
    whole = Summary(counts[None, :], np.array([shortest]), np.array([longest]), words[None, :])
    for needle in _spellings(4, 30) + ["sup-1", "q", "office 12 ulm"]:
        assert whole.caps(needle)[0] >= max(score(needle, [n]) for n in names) - 1e-12


def test_blocks_of_unlike_names(spark):
    """Mentions that meet few of many blocks still get all of their closest names."""
    rows = [(f"{chr(97 + b) * 3}{i:03d}{chr(97 + b) * (2 * b)}", []) for b in range(8) for i in range(60)]
    got = candidates(spark, rows, ["aaa001", "hhh002" + "h" * 14], k=5, block_names=60)
    for text, found in got.items():
        assert found == sorted(((i, score(text, [n])) for i, (n, _) in enumerate(rows)), key=lambda p: (-p[1], p[0]))[:5]


def test_longest_common_pieces():
    rnd = random.Random(7)
    names = sorted(("".join(rnd.choices("abc", k=rnd.randint(1, 12))) for _ in range(80)), key=len, reverse=True)
    letters = {c: i for i, c in enumerate("abc")}
    lengths = np.array([len(n) for n in names])
    codes = np.array([letters[c] for n in names for c in n], np.int32)
    for _ in range(60):
        text = "".join(rnd.choices("abcd", k=rnd.randint(1, 14)))
        found = Substrings(text, letters).longest(codes, np.cumsum(lengths) - lengths, lengths)
        for name, size, a, b in zip(names, *(f.tolist() for f in found), strict=True):
            want = SequenceMatcher(None, text, name, autojunk=False).find_longest_match()
            assert size == want.size and (not size or (a, b) == (want.a, want.b))


def test_lookups_read_few_names_and_common_subsequences_are_exact(monkeypatch):
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(out[-1], row[j + 1]))
        return out

    rnd = random.Random(3)
    names = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    block = NameBlock(range(300), names)
    order = np.array(sorted(range(300), key=block.names.__getitem__), np.int64)
    prefixes = Prefixes(order, block.codes, block.starts, block.lengths)
    for text in ["a", "abca cab", "zz", "é" * 64, "ab" * 32]:
        assert prefixes.subsequence(text, block.letters).tolist() == [longest(text, n) for n in block.names]

    nations = ["algeria", "brazil", "china", "egypt", "france", "japan", "kenya", "peru", "romania", "vietnam"]
    block = NameBlock(range(6000), [f"{nations[i % 10]} institute {i}" for i in range(6000)])
    read, own = [], Substrings.longest
    monkeypatch.setattr(Substrings, "longest", lambda self, codes, starts, lengths: read.append(len(starts)) or own(self, codes, starts, lengths))
    for needle in ["office 40123 peru", "office 88 brazil", "china instiute"]:
        found = block.best(needle, 50)
        scores = sorted(((-score(needle, [n]), int(e)) for n, e in zip(block.names, block.ids)))[:50]
        assert [(e, -s) for s, e in scores] == found
    assert sum(read) < 4000  # bounds by letter counts alone have 11,966 of 18,000 names read, these 1,112


def test_lookups_together_equal_brute_force_and_match_no_names_one_by_one(monkeypatch):
    """Lookups of all lengths in one call; names of less than 200 letters are never matched in a call of their own."""
    rows = [(i // 2, n) for i, n in enumerate(_spellings(11, 400))] + [(500, "a"), (501, "ulm"), (502, "日本 institut"), (503, "b" * 199), (3, "ulm")]
    needles = [*_spellings(12, 150), "", "a", "u", "zzz", "日本", "ulm", "institut " * 5, "kunst ulm " * 6 + "tech", "x" * 64, "ulm"]
    floors = [[-1.0, 0.3, 0.75][i % 3] for i in range(len(needles))]
    block = NameBlock([i for i, _ in rows], [n for _, n in rows])
    calls, own = [], similarity.matched_length
    monkeypatch.setattr(similarity, "matched_length", lambda a, b: calls.append(b) or own(a, b))
    assert len(block.best(needles[0], 10)) == 10 and not calls
    found = {place: list(zip(entities.tolist(), scores.tolist())) for place, entities, scores in block.best_of(needles, 10, floors)}
    assert sorted(found) == list(range(len(needles))) and not calls
    for place, (needle, floor) in enumerate(zip(needles, floors)):
        best = {}
        for i, n in rows:
            best[i] = max(best.get(i, 0.0), score(needle, [n]))
        want = sorted(((i, s) for i, s in best.items() if s >= floor or not needle), key=lambda p: (-p[1], p[0]))[:10]
        assert found[place] == want


def test_types_of_one_and_of_several_blocks(spark):
    """A type whose names share one block with another's, one cut into many, one offered whole; NULL and empty mentions."""
    rows = [(i, kind, n) for kind, first, size in [("few", 0, 4), ("large", 100, 150), ("one", 1000, 15)] for i, n in enumerate(_spellings(first + 13, size), first)]
    ents = spark.createDataFrame(rows, "entity_id long, entity_type string, canonical_name string")
    vars_ = spark.createDataFrame([(i, n + " tu") for i, _, n in rows if i % 3 == 0], "entity_id long, variant_name string")
    texts = [*_spellings(14, 12), "Ulm ", "ulm", "", None, "kunst " * 15]
    mentions = spark.createDataFrame([(t, kind) for t in texts for kind in ("few", "large", "one", "none")], "text string, entity_type string")
    got = {}
    for r in e.entity_candidates(mentions, ents, vars_, 5, block_mentions=6, block_names=40).collect():
        kind = next(k for i, k, _ in rows if i == r["entity_id"])
        got.setdefault((r["text"], kind), []).append((r["rank"], r["entity_id"], r["score"]))
    want = {}
    for text in {t for t in texts if t is not None}:
        for kind in ("few", "large", "one"):
            scored = [(i, score(text, [n] + [n + " tu"] * (i % 3 == 0))) for i, k, n in rows if k == kind]
            scored.sort(key=lambda p: p[0] if kind == "few" else (-p[1], p[0]))
            want[text, kind] = [(rank, i, s) for rank, (i, s) in enumerate(scored[:5], 1)]
    assert {key: sorted(found) for key, found in got.items()} == want
