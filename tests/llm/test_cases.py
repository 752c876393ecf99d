"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for each operator."""

import hashlib
import time
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import (
    boosting, components, decontamination, encoding, html_extraction, html_pages, language_id, near_dedup, packing, pii, repeats, token_files, topk, toxicity,
)
from fieldloom.llm.catalog import tokenizer_path
from fieldloom.llm.wavelet import WaveletMatrix

RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def frame(spark, rows, schema="doc_id long, text string"):
    """With columns whose names the operators use inside."""
    out = spark.createDataFrame(rows, schema)
    return out.withColumns({n: F.lit("x") for n in ("part", "node", "n", "key", "sum", "cluster", "value", "hashes", "print") if n not in out.columns})


def edited(text, *places):
    words = text.split(" ")
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


BASE = prose(120, 1)
LONG = prose(9_000, 2)
TEXTS = [
    (0, BASE), (1, edited(BASE, 3)), (2, edited(BASE, 60)), (3, edited(BASE, 3, 20, 60, 90)), (4, None), (5, ""), (6, " \n\t "), (7, "One two"), (8, "one TWO"),
    (9, "one two three four five"), (10, LONG), (11, LONG + " tail"), (12, "É one two"), (13, "é one two"), (14, prose(49, 3)), (15, prose(49, 3)),
    (16, "x " * 300), (17, "x " * 300 + "y"), (18, BASE + " " + LONG), (19, prose(60, 9) + " " + BASE[: len(BASE) // 2]), (20, BASE),
]


def test_near_duplicates(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, TEXTS)).collect()}
    assert got == brute.near_duplicates(TEXTS)


def test_near_duplicates_in_chunks(spark, monkeypatch):
    """Groups beyond one chunk, with links only between some members."""
    monkeypatch.setattr(near_dedup, "CHUNK_DOCS", 7)
    rows = [(i, edited(BASE, *np.random.default_rng(i).choice(120, 1 + i % 4, replace=False))) for i in range(60)] + [(90, BASE), (91, BASE)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, BASE), (3, BASE), (3, BASE), (None, None)]
    got = sorted(map(tuple, near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    n = 116
    assert got == sorted([(3, n, 3, True), (3, n, 3, True), (None, n, None, True), (None, 0, None, True)], key=str)
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, None), (300, 250), (300, 251), (251, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 300: 250, 251: 250, 250: 250}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_words(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeated_words(frame(spark, TEXTS)).collect()}
    want = brute.repeated_words(TEXTS)
    assert got == want and sum(n for _, n, _ in want.values()) > 9_000
    shifted = [(i, prose(i, 50 + i) + " " + prose(70, 8) + " " + prose(5, 80 + i)) for i in range(40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeated_words(frame(spark, shifted), units=5).collect()}
    assert got == brute.repeated_words(shifted)
    short = {r.doc_id: r.n_removed for r in repeats.repeated_words(frame(spark, shifted), window=3, period=1, cover=(0,)).collect()}
    assert short == {d: n for d, (_, n, _) in brute.repeated_words(shifted, 3).items()}


def test_windows_of_equal_hash_and_other_words_are_no_repeat():
    """Whatever the first hash says, the second tells windows apart; both must agree to remove."""
    from fieldloom.llm import hashing

    column = pa.array(["a b c", "a b d", "A b c", "x" * 200 + " b c", "x" * 199 + "y b c", None, "a  b\nc"])
    first, bounds = hashing.hashed_words(column)
    second, again = hashing.hashed_words(column, second=True)
    assert (bounds == again).all() and len(set(second.tolist())) == len(set(first.tolist())) == 7
    assert (hashing.window_hashes(first, 3) != hashing.window_hashes(second, 3, True)).all()
    hashes, checks = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    numbers = repeats._groups(hashes, checks)
    assert numbers[0] == numbers[2] and len(set(numbers.tolist())) == 3
    assert repeats._least(numbers, np.array([9, 1, 4, 3]))[numbers].tolist() == [4, 1, 4, 3]
    assert repeats._least(repeats._groups(hashes[:0], checks[:0]), hashes[:0].astype(np.int64)).tolist() == []


def test_repeated_words_of_odd_rows(spark):
    rows = [(None, LONG), (5, LONG), (5, LONG), (None, None), (6, "a b\x1cc d")]
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed) for r in repeats.repeated_words(frame(spark, rows)).collect() if r.doc_id)
    assert got == [(False, 5, 9000, 0), (False, 5, 9000, 0), (False, 6, 2, 0)]
    assert repeats.repeated_words(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        repeats.repeated_words(frame(spark, rows), cover=(1, 2))


def test_contaminated_documents(spark):
    docs = [
        *TEXTS, (30, "A b c."), (31, "x Y z w A-b-c q"), (32, "ß Σ É é a b"), (32, "ß Σ É é a b"), (33, "one two three four five six seven eight nine ten eleven twelve"),
        (34, "zero one two THREE four five six seven eight nine ten!! "), (35, "É. Σ"), (36, "..."), (None, "q a b c"),
    ]
    items = [(1, "a B c"), (2, None), (3, "ten"), (5, "one two three four five six seven eight nine ten eleven"), (5, "É"), (6, "--"), (10, prose(30, 2)), (9, BASE), (9, BASE)]
    got = decontamination.contaminated_documents(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.contaminated(docs, items), key=str)
    nothing = decontamination.contaminated_documents(frame(spark, docs), frame(spark, [], "item_id long, text string")).collect()
    assert sorted(map(tuple, nothing), key=str) == sorted(brute.contaminated(docs, []), key=str)
    assert decontamination.contaminated_documents(frame(spark, []), frame(spark, items, "item_id long, text string")).collect() == []


def test_contaminated_documents_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_FINGERPRINTS", 0)
    items = [(9, BASE), (7, "one two")]
    got = decontamination.contaminated_documents(frame(spark, TEXTS), frame(spark, items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.contaminated(TEXTS, items))


def test_search(spark):
    data = RNG.integers(-40, 40, (300, 12)) / 64
    data[100:130] = data[100]  # ties
    rows = [(int(i), v.tolist()) for i, v in enumerate(data)]
    odd = [(400, None), (420, [None] * 12), (440, [float("nan")] * 12), (460, [float("inf")] * 12), (None, data[0].tolist())]
    table = frame(spark, rows + odd, "vec_id long, embedding array<float>")
    vectors = table.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    got = topk.search(vectors.where("vec_id % 20 = 0"), vectors)
    assert sorted(map(tuple, got.collect())) == sorted(brute.best_vectors(rows))
    assert topk.search(vectors.where("false"), vectors).collect() == []
    few = vectors.where("vec_id < 5")
    assert topk.search(few.where("vec_id = 0"), few).count() == 4


def test_search_of_shards_prunes_exactly(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "SEED", 25)
    rows = [(int(i), v.tolist()) for i, v in enumerate(RNG.normal(size=(400, 24)))]
    vectors = frame(spark, rows, "vec_id long, embedding array<double>").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    assert sorted(map(tuple, topk.search(vectors.where("vec_id % 20 = 0"), vectors).collect())) == sorted(brute.best_vectors(rows))


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">Cookies</div><div class="post-12 content"><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text,
second line<br>third<p>Unclosed <script>var t="</p>"</script>end<ul><li>one<li>two</ul><div class="ad">Buy</div><form>Name<input></form>
<table><tr><td>cell<td>next</table><!-- gone --></div><div class="comments"><p>I think so</p></div><aside>More</aside><footer>&copy; me</footer>"""
MAIN = "Title & more\nFirst bold text, second line third\nUnclosed end\none\ntwo\ncell\nnext"


def test_extract_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("post-12", f"post-{i}")) for i in range(6)]
    odd = [(10, None, None), (11, "", ""), (12, "http://h.example/x", "<p>alone</p>"), (13, "nonsense", "<div" * 50), (14, "http://h.example/y", "<!--"), (10, None, None)]
    got = {r.page_id: r for r in html_extraction.extract_pages(frame(spark, rows + odd, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert all(got[i].text == MAIN and got[i].n_chars == len(MAIN) for i in range(6))
    assert got[10].text == got[11].text == "" and got[12].text == "alone" and got[10].url is None
    assert html_extraction.extract_pages(frame(spark, [], "page_id long, url string, html string")).collect() == []


def test_hosts_agree_on_a_path(spark):
    """A page whose comments are longer than its article follows its host."""
    page = "<body><article>{}</article><div class='talk'>{}</div></body>"
    rows = [(i, "http://a.example/", page.format("text " * 50, "so ")) for i in range(5)] + [(9, "http://a.example/", page.format("few words", "so " * 500))]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "few words"


@pytest.mark.parametrize("page,want", [
    ('<div class="content with-sidebar"><p>a</p><div class="post-comments"><p>no</p></div></div><div class="sidebar-left">no</div>', "a"),
    ('<div id="main"><div class="post-header"><h1>t</h1></div><p>a</p><div class="article-footer">no</div><div id="share-bar">no</div></div>', "t\na"),
    ('<div class="menu-open"><p>all there is</p></div>', "all there is"),
    ('<div class="page-header">no</div><section><p>a</p><p class="notice">no</p><div class="comment-body">no</div></section>', "a"),
    ("<main><article><p>a &lt;b&gt; &#233;</p></article></main><section id=comments>no</section>", "a <b> \u00e9"),
])
def test_extract_page_designs(spark, page, want):
    row = html_extraction.extract_pages(frame(spark, [(1, "http://h.example/", page)], "page_id long, url string, html string")).first()
    assert row.text == want


@pytest.mark.parametrize("page,want", [
    ("<article><h1>{t}</h1><div class=entry-content><p>{x}</p></div></article>", "{t}\n{x}"),
    ("<body><article><h1>{t}</h1><p>{l}</p><section><p>{x}</p></section><section><p>{x}</p></section></article><footer>no</footer></body>", "{t}\n{l}\n{x}\n{x}"),
    ("<body><h1>{t}</h1><div class=content><p>{x}</p></div><nav>no</nav></body>", "{t}\n{x}"),
])
def test_titles_and_leads_around_the_best_container(spark, page, want):
    parts = {"t": "title" * 10, "l": "lead " * 39 + "lead", "x": "words " * 199 + "words"}
    rows = [(i, "http://h.example/", page.format(**parts)) for i in range(3)]
    got = html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [want.format(**parts)] * 3


def test_pages_of_another_design_than_their_host(spark):
    most = "<body><div class=col><div class=box><p>{}</p></div><div class=talk>{}</div></div></body>".format("words " * 100, "so " * 100)
    around = "<body><div class=col><p>{}</p><div class=box><p>end</p></div></div></body>".format("lead " * 100)
    apart = "<body><div class=col><div class=box><p>teaser</p></div></div><div class=story><p>{}</p></div></body>".format("tale " * 100)
    rows = [(i, "http://h.example/", most) for i in range(20)] + [(30, "http://h.example/", around), (31, "http://h.example/", apart)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("words " * 100).strip() and got[30] == ("lead " * 100).strip() + "\nend" and got[31] == "teaser\n" + ("tale " * 100).strip()


def test_pages_inside_a_form(spark):
    """A form that holds the page is a container; one beside the article, or with less text, is furniture."""
    text = "<div class=content><h1>Title</h1><p>A body of some words in a form.</p></div>"
    wrapped = f"<html><body><nav>Menu of the site</nav><form action=/p>{text}<label>Your name</label><button>Go</button></form></body></html>"
    beside = "<body><main><p>Short text.</p></main><form><p>A longer text that explains what is sent with this form.</p></form></body>"
    small = "<body><div><p>The text of this page is longer than its form.</p></div><form>Sign up here</form></body>"
    rows = [(1, "http://w.example/1", wrapped), (2, "http://b.example/1", beside), (3, "http://s.example/1", small)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title\nA body of some words in a form.", 2: "Short text.", 3: "The text of this page is longer than its form."}


@pytest.mark.parametrize("page, text", [
    ("<div class=a1>" * 50_000 + "x" + "</div>" * 50_000, "x"),
    ("<div>" * 50_000 + "x", "x"),
    ("<p><button>" + "<b>" * 50_000 + "<ul>" * 50_000 + "z", ""),
    ("<ul><li>" * 25_000 + "y" + "</b>" * 50_000, "y"),
])
def test_deep_pages_take_linear_time(page, text):
    def seconds(size):
        start = time.process_time()
        read = html_pages.Page(page[:size])
        best = html_extraction._paths(html_pages.containers(read), None)
        html_pages.extract(read, best or None)
        return time.process_time() - start

    assert html_pages.extract(page, None) == text
    # Quadratic work would take 25 times as long on five times the page.
    assert min(seconds(len(page)) for _ in range(2)) < 12 * max(min(seconds(len(page) // 5) for _ in range(2)), 0.05)


def test_long_and_deep_pages_take_linear_time():
    deep = "<div>" * 3_000 + "x" + "</div>" * 3_000
    assert html_pages.extract(deep, None) == "x"
    assert html_pages.extract("<a href='" * 20_000, None) == ""
    assert html_pages.extract("a &am", None) == "a &am"


def test_language_id(spark):
    rows = [(i, prose(80, i) if i % 2 else prose(80, i).translate(str.maketrans("abcdefghij", "klmnopqrst")), "aa" if i % 2 else "bb") for i in range(300)]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "aa"), (903, prose(5, 1), None), (None, prose(50, 4), "aa"), (1, prose(80, 1), "aa")]
    docs = frame(spark, rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language_id.identify_languages(docs).collect()
    assert len(got) == 306
    for r in got:
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("aa" if r.doc_id is None or r.doc_id % 2 else "bb") and 0.5 < r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    unlabelled = language_id.identify_languages(frame(spark, [(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [tuple(r)[2:] for r in unlabelled] == [("und", 0.0)]
    assert language_id.identify_languages(frame(spark, [], "doc_id long, text string, lang string")).collect() == []


def test_toxicity(spark):
    def text(i, toxic):
        words = prose(60, i).split()
        if toxic:
            words[i % 50], words[50 + i % 9] = "vilek", f"grump{VOCABULARY[i % 90]}"
        elif i % 9 == 0:
            words[10:12] = ["good", "vilek"]
        return " ".join(words)

    rows = [(i, text(i, i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, prose(40, 7) + " V1lek grumpаbc"), (903, prose(40, 7)), (None, "x"), (3, text(3, True))])
    labels = frame(spark, [(i, y) for i, _, y in rows] + [(901, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    found = toxicity.toxic_documents(docs, labels).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == 606 and all(got[i].predicted == y for i, _, y in rows)
    assert got[902].predicted == 1 and not (got[900].predicted or got[901].predicted or got[903].predicted)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    unlabelled = toxicity.toxic_documents(docs, labels.where("false")).collect()
    assert len(unlabelled) == 606 and not any(r.predicted for r in unlabelled)
    assert toxicity.toxic_documents(frame(spark, []), labels).collect() == []


def test_toxic_exceptions():
    lexicon = toxicity.Lexicon({" bad": 2.0, " worse ": 3.0}, [" not bad "])
    sums, words = toxicity.features(pa.array(["so bad", "not bad at all", "w0rse, b4dly", None, "worsen", "it is not bad but bad"]), lexicon)
    assert sums.tolist() == [2.0, 0.0, 5.0, 0.0, 0.0, 2.0] and words.tolist() == [2, 4, 2, 0, 1, 6]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_equals_the_tokenizer(name):
    encoder = encoding.Encoder(tokenizer_path(name))
    letters = [*"ab    Z1'.,-\n\t é́İΣς日<|>_-#", "  ", "'s", "<|endoftext|>", "\xa0", " ", "\r\n", "\x1c", "　", "\x01"]
    rng = np.random.default_rng(3)
    texts = [None, "", *("".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(4_000)), LONG, "a" * 5_000, " " * 3_000]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encoder.rows(pa.array(texts))] == want


def test_wavelet_matrix():
    for n, most in ((0, 5), (1, 1), (700, 9), (5_000, 49_407), (3_000, 70_000)):
        ids = RNG.integers(0, most + 1, n)
        matrix = WaveletMatrix.build(ids, max(1, most.bit_length()))
        assert matrix.ids().tolist() == ids.tolist()
        for at in RNG.integers(0, n, 5) if n else ():
            value = int(ids[at])
            assert matrix.access(int(at)) == value and matrix.rank(value, int(at)) == int((ids[:at] == value).sum())
            assert matrix.occurrences(value).tolist() == np.flatnonzero(ids == value).tolist()
            assert matrix.select(value, matrix.rank(value, int(at))) == at
        assert matrix.rank(1 << 20, n) == 0 and not len(matrix.occurrences(1 << 20))


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = [*TEXTS, (None, "no id"), (7, "again")]
    folder = token_files.shared_folder(spark, "test")
    token_files.write_token_files(frame(spark, rows), folder, path, shard_ids=500)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(path)
    assert got == brute.token_rows(tokenizer, rows)
    ids = {i: brute.token_ids(tokenizer, t) for i, t in TEXTS if i not in (7,)}
    token = int(ids[0][0])
    places = sorted((r.doc_id, r.position) for r in token_files.token_occurrences(spark, folder, token).collect() if r.doc_id in ids)
    assert places == sorted((d, int(p)) for d, own in ids.items() for p in np.flatnonzero(own == token))
    counts = dict(map(tuple, token_files.token_counts(spark, folder, [token, 1]).collect()))
    assert counts[1] == len(rows) and counts[token] >= len(places)
    empty = token_files.shared_folder(spark, "test")
    token_files.write_token_files(frame(spark, []), empty, path)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, t, None if i % 5 == 4 else f"s{i % 3}") for i, t in TEXTS] + [(40 + i, prose(300, i), "hot") for i in range(60)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: brute.token_ids(tokenizer, t) for i, t, _ in rows}
    for targets in (None, {"hot": 3.0, "s0": 1.0, None: 1.0}):
        brute.check_pieces(packing.pack_documents(docs, path, targets=targets, units=3).collect(), ids)
    assert packing.pack_documents(docs.where("false"), path).collect() == []
    odd = packing.pack_documents(frame(spark, [(None, "x", "a"), (None, None, None)], "doc_id long, text string, source string"), path, units=1).collect()
    assert sorted((r.doc_id, r.length) for r in odd)[0][0] is None and sum(r.length for r in odd) == 3


def test_windows_keep_the_mixture():
    queues = np.array([400_000, 200_000, 100_000, 500])
    shares = queues / queues.sum()
    windows, sources, cuts = packing.fill_windows(queues, packing.credit_rates(queues, shares, np.zeros(4), False))
    assert np.bincount(sources, cuts).tolist() == queues.tolist()
    sizes = np.bincount(windows, cuts)
    assert (sizes[: len(sizes) - 12] == 2048).all() and all(int(s) & (int(s) - 1) == 0 for s in sizes)
    so_far = np.cumsum(np.where(sources == 0, cuts, 0))
    assert np.abs(so_far - shares[0] * np.cumsum(cuts)).max() < 2 * 2048
    given = packing.credit_rates(queues, np.array([0.25] * 4), np.array([1000.0, -1000, 0, 0]), True)
    assert given[0] > given[2] > given[1] and abs(given.sum() - 1) < 1e-9


def test_windows_of_all_parts_keep_the_mixture(spark, monkeypatch):
    """However a very long document and a source in few rows are spread, all full windows have the sources' proportions."""
    monkeypatch.setattr(packing, "LEAST_WINDOWS", 8)
    rows = [(0, LONG, "long")] + [(i, prose(250, i), "hot") for i in range(1, 61)] + [(i, prose(700, i), None) for i in range(61, 71)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    pieces = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), units=5).collect()
    source = {i: s for i, _, s in rows}
    whole, windows = {}, {}
    for p in pieces:
        whole[source[p.doc_id]] = whole.get(source[p.doc_id], 0) + p.length
        held = windows.setdefault(p.sequence_id, {})
        held[source[p.doc_id]] = held.get(source[p.doc_id], 0) + p.length
    full = [w for w in windows.values() if sum(w.values()) == packing.WINDOW]
    assert len({i >> 32 for i in windows}) == 5 and len(full) > 20
    total = sum(whole.values())
    assert all(abs(w.get(s, 0) / packing.WINDOW - n / total) < 0.05 for w in full for s, n in whole.items())


def test_ranges_of_a_line():
    starts = packing.range_starts(0, 7, 1_000, 7)
    assert starts[0] == 0 and starts[-1] == 1_000 and (starts[1:-1] % packing.LEAST_PIECE == 0).all() and np.abs(starts - np.arange(8) * 1_000 / 7).max() < 32


def test_personal_data(spark):
    texts = [
        None, "", "a@b.co, x.y@z.org.uk", "@b.c a@b a@.b", "10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111111111111112", "+1 (555) 123-4567 +123",
        "1" * 20_000, "é" * 50 + " bob@mail.org", "a" * 20_000 + "@", "4111111111111111 4111111111111111", LONG,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.co"), (2, texts[2])]
    for r in pii.find_personal_data(frame(spark, rows)).collect():
        want = brute.personal_data("a@b.co" if r.doc_id is None else texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.find_personal_data(frame(spark, [])).collect() == []


def test_addresses_with_thousands_of_zeros():
    text = f"at {'0' * 5_000}10.0.0.{'0' * 5_000}7 and {'0' * 5_000}256.1.1.{'9' * 5_000}"
    assert [(s.start, s.end, s.kind) for s in pii.base_spans(text)] == [(3, 3 + 10_008, "ip")]
    assert pii._variants("1.2.3." + "0" * 5_000 + "7", "ip")[0][0] == "1.2.3.263"


def test_trees_learn_from_all_texts(spark, monkeypatch):
    """As many spans as a bounded sample would not hold, in several parts: the trees of all of them, and thresholds that keep the precision."""
    rng = np.random.default_rng(11)

    def number(n):
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def card():
        digits = number(15)
        return digits + next(d for d in "0123456789" if pii.luhn(digits + d))

    def text(i):
        made = [f"{VOCABULARY[int(k)]}@{VOCABULARY[int(k) // 2]}.org" for k in rng.integers(0, 400, 6)] + [f"+1 {number(10)}"] * (i % 3)
        made += [card() for _ in range(i % 5)] + [f"{rng.integers(1, 255)}.{i % 256}.0.{number(2)}"] + [number(int(k)) for k in rng.integers(6, 18, 3)]
        return ", ".join(f"{VOCABULARY[int(rng.integers(400))]} {m}" for m in made)

    texts = [text(i) for i in range(450)] + ["write bob at mail dot org", None, ""]
    docs = frame(spark, list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])])
    monkeypatch.setattr(pii, "TASK_EXAMPLES", 40)
    monkeypatch.setattr(pii, "PART_EXAMPLES", 700)
    judge = pii.learn(docs)
    held = {r.text: r.held for r in docs.selectExpr("text", "pmod(xxhash64(text), 4) = 3 AS held").collect()}
    found = [(held[t], y, x) for t in [*texts, texts[0], texts[1]] if t for y, x in pii._examples(t)]
    kept, y, x = np.array([f[0] for f in found]), np.array([f[1] for f in found]), pii.coarse(np.array([f[2] for f in found], float))
    assert len(found) > 20_000
    want = boosting.boost(x[~kept], y[~kept])
    for name in ("features", "thresholds", "values", "base"):
        assert np.array_equal(getattr(judge.trees, name), getattr(want, name)), name
    chance = judge.trees.probability(x)
    for i, name in enumerate(pii.KINDS):
        chosen = kept & (x[:, 0] == i) & (chance >= judge.thresholds[name])
        assert judge.thresholds[name] > 1 or y[chosen].mean() >= pii.PRECISION


def test_equal_probabilities_are_selected_together():
    p, y = np.array([0.9, 0.9, 0.9, 0.9, 0.95]), np.array([1, 1, 1, 0, 1])
    assert boosting.threshold_of(p, y, 0.9) == 0.95 and boosting.threshold_of(p, y, 0.8) == 0.9
    assert boosting.threshold_of(np.array([0.9, 0.9, 0.95]), np.array([1, 0, 1]), 0.9, times=np.array([99, 1, 1])) == 0.9
    assert boosting.threshold_of(p[:0], y[:0], 0.9) > 1


def test_features_of_long_spans_take_few_values():
    values = pii.coarse(np.arange(1_000_000, dtype=float))
    assert (values[:129] == np.arange(129)).all() and len(np.unique(values)) < 1_000 and (np.diff(values) >= 0).all() and (values >= np.arange(1_000_000) * 0.98).all()


def test_redaction_keeps_clean_texts(spark):
    docs = frame(spark, [(1, "write to bob@mail.org now"), (2, None), (3, LONG), (4, "")])
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "write to [EMAIL] now" and got[2].text is None and got[3].text == LONG and got[4].text == "" and got[1].part == "x"


def test_boosting_learns_and_calibrates():
    x = RNG.normal(size=(3_000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (RNG.random(3_000) < 0.1)).astype(float)
    trees = boosting.calibrate(boosting.boost(x[:1500], y[:1500]), x[1500:2200], y[1500:2200])
    p = trees.probability(x[2200:])
    assert ((p > 0.5) == y[2200:]).mean() > 0.8 and abs(p.mean() - y[2200:].mean()) < 0.05
    assert boosting.threshold_of(p, y[2200:], 1.01) > 1


def test_stages_judge_rows_without_an_id_or_with_a_repeated_one(spark, tmp_path):
    import corpus_pipeline

    other, third = prose(120, 77), prose(120, 78)
    rows = [(None, BASE), (3, BASE), (3, BASE), (3, other), (None, third), (None, third), (5, None), (None, None), (None, None)]
    got = corpus_pipeline.one_of_each(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, BASE), (3, other), (None, third), (5, None), (None, None), (None, None)], key=str)
    spark.createDataFrame([("b1", BASE)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.without_benchmarks(spark, frame(spark, [(None, BASE), (3, BASE), (3, other), (None, third)]), str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, other), (None, third)], key=str)
