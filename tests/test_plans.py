"""Distributed forms against plain loops, with one hot key holding most rows."""

import random

from pyspark.sql import functions as F

from fieldloom.operators import capture, extraction, jobs, search
from fieldloom.plans.order import global_rank


def test_global_rank_with_equal_keys(spark):
    rows = [(i, 1 if i % 3 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, p int").repartition(5)
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("p"), F.asc("id")]).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_polite_plan_is_the_plain_loop(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.7 else f"h{rnd.randint(0, 5)}", rnd.randint(0, 900)) for i in range(800)]
    df = spark.createDataFrame([(i, h, t, 7 if h == "hot" else 30) for i, h, t in rows], "request_id long, host string, ready_us long, gap_us long")
    got = {r["request_id"]: r["start_us"] for r in capture.polite_fetch_plan(df).collect()}
    last, want = {}, {}
    for i, h, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        gap = 7 if h == "hot" else 30
        want[i] = last[h] = max(t, last[h] + gap) if h in last else t
    assert got == want


def plain_outages(calls, threshold, timeout, states=None):
    episodes, out = {}, {}
    states = dict(states or {})
    for service, ts, _, ok in sorted(calls):
        kind, a, b = states.get(service, (0, 0, 0))
        if kind == 0:
            a = 0 if ok else a + 1
            if a >= threshold:
                kind, a, b = 1, ts, ts
                episodes[service, ts] = [None, 0, 0]
        else:
            part = episodes.setdefault((service, b), [None, 0, 0])
            if ts - a <= timeout:
                part[2] += 1
            elif ok:
                part[0] = ts
                kind, a, b = 0, 0, 0
            else:
                part[1] += 1
                a = ts
        states[service] = (kind, a, b)
    return episodes, states


def call_rows(seed, n=3000):
    rnd = random.Random(seed)
    rows, ts = [], 0
    for i in range(n):
        ts += rnd.choice([0, 1, 1, 2, 30]) * 1_000_000
        bad = (i // 150) % 3 == 1
        rows.append((1 if rnd.random() < 0.7 else rnd.randint(2, 4), ts, i, rnd.random() < (0.08 if bad else 0.7)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "service_id long, ts_us long, event_id long, success boolean")


def collected(episodes, ends):
    got = {(r["service_id"], r["opened_us"]): [r["closed_us"], r["failed_probes"], r["refused_calls"]] for r in episodes.collect()}
    return got, {r["service_id"]: (r["kind"], r["a"], r["b"]) for r in ends.collect()}


def test_outages_are_the_plain_loop(spark):
    for seed, threshold, timeout in ((1, 3, 20), (2, 10, 300), (3, 1, 5)):
        rows = call_rows(seed)
        want = plain_outages(rows, threshold, timeout * 1_000_000)
        assert len(want[0]) > 0
        assert collected(*jobs.outage_episodes(frame(spark, rows), threshold, timeout)) == want


def test_outages_go_on_from_stored_states(spark):
    rows = sorted(call_rows(4), key=lambda r: r[1:3])
    _, ends = jobs.outage_episodes(frame(spark, rows[:1500]), 3, 20)
    want_first = plain_outages(rows[:1500], 3, 20_000_000)
    got = collected(*jobs.outage_episodes(frame(spark, rows[1500:]), 3, 20, start=ends))
    assert got == plain_outages(rows[1500:], 3, 20_000_000, want_first[1])


def test_documented_outage_cases(spark):
    fail = lambda *ts: [(1, t * 1_000_000, t, False) for t in ts]
    ok = lambda t: [(1, t * 1_000_000, t, True)]
    nine = fail(*range(9)) + ok(9)
    opened = nine + fail(*range(10, 20))
    assert collected(*jobs.outage_episodes(frame(spark, nine)))[0] == {}
    closed = opened + ok(100) + ok(319) + ok(320)
    assert collected(*jobs.outage_episodes(frame(spark, closed)))[0] == {(1, 19_000_000): [320_000_000, 0, 2]}
    again = opened + fail(330) + ok(400) + ok(700)
    assert collected(*jobs.outage_episodes(frame(spark, again)))[0] == {(1, 19_000_000): [700_000_000, 1, 1]}


def test_waves_with_several_dependencies_and_cycles(spark):
    prompts = [(1, p) for p in range(8)] + [(2, p) for p in range(3)]
    edges = [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 3, 2), (1, 4, 99), (1, 5, 6), (1, 6, 5), (1, 7, 6), (2, 0, 1), (2, 1, 0), (2, 2, 2)]
    got = extraction.dependency_waves(
        spark.createDataFrame(prompts, "set_id long, prompt_id long"), spark.createDataFrame(edges, "set_id long, prompt_id long, depends_on long"))
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {
        (1, 0): 1, (1, 4): 1, (1, 1): 2, (1, 2): 2, (1, 3): 3, (1, 5): 4, (1, 6): 4, (1, 7): 4, (2, 0): 1, (2, 1): 1, (2, 2): 1}


def test_terms_are_found_in_all_texts_that_hold_them(spark):
    rnd = random.Random(9)
    texts = [(i, " ".join("".join(rnd.choices("abcä", k=rnd.randint(1, 9))) for _ in range(rnd.randint(0, 6)))) for i in range(120)]
    terms = sorted({"".join(rnd.choices("abcä", k=rnd.randint(1, 5))) for _ in range(40)})
    frames = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in terms], "term string")
    want = sorted((w, i) for w in terms for i, text in texts if w in text)
    for sizes in ({}, {"slice_texts": 5, "block_terms": 7}):
        assert sorted((r["term"], r["id"]) for r in search.term_hits(*frames, **sizes).collect()) == want
    assert search.term_hits(frames[0], frames[1].where("false")).isEmpty() and search.term_hits(frames[0].where("false"), frames[1]).isEmpty()


def test_hot_page_keeps_only_its_best_links(spark):
    rows = [(1, "https://h.org/", i, f"https://h.org/{'team' if i == 4000 else 'x'}{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, pos int, link string")
    got = capture.select_subpages(df, 5).orderBy("rank")
    assert [r["pos"] for r in got.collect()] == [4000, 0, 1, 2]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
