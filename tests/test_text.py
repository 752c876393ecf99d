"""Hand-written cases for per-row text logic."""

from difflib import SequenceMatcher
from urllib.parse import urljoin

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import answers, html, markdown as md, render, similarity, text as tx, web
from fieldloom.operators import search as s


def one(spark, values, build, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col(schema.split()[0])).alias("y")).collect()]


def test_resolve_url_agrees_with_urljoin(spark):
    base = "https://h.org/a/b/c.html?q=1#f"
    hrefs = ["x", "./x", "../x", "../../x", "../../../x", "/y/../z", "?p=2", "//o.org/k", "http://o.org/k", "x/./y?z=../k", "mailto:a@b", "sub/", "..", ".", "/a/.."]
    got = one(spark, hrefs, lambda c: web.resolve_url(F.lit(base), c))
    assert got == [urljoin(base, h) for h in hrefs]


def test_page_links(spark):
    page = '<a href="/team">T</a><A class=x HREF=\'/team#me\'>again</A><a href="">e</a><a href="https://o.org/x">o</a><a href="mailto:x@y">m</a><a href="sub?a=1&amp;b=2">s</a><a href="/p">self</a>'
    got = one(spark, [page], lambda c: web.page_links(F.lit("https://h.org/p"), c))
    assert got == [["https://h.org/team", "https://h.org/sub?a=1&b=2"]]


def test_normalize_url(spark):
    values = [" h.org/a\t", "http://h.org", "https://", "http:///x", "", None, "https://[::1", " h.org"]
    got = one(spark, values, web.normalize_url)
    assert got == ["https://h.org/a", "http://h.org", None, None, None, None, None, "https://h.org"]


def test_link_score_uses_whole_address(spark):
    values = ["https://h.org/team", "https://h.org/imprint", "https://h.org/team/login", "https://h.org/x", "https://o.org/team", "https://h.org/Paper"]
    assert one(spark, values, lambda c: web.link_score(c, F.lit("https://h.org/"))) == [10, -2, 5, 3, 0, 6]


def test_strip_removes_all_white_space(spark):
    assert one(spark, [" \tä b\x1f\n", "  ", None], tx.strip) == ["ä b", "", None]


@pytest.mark.parametrize("page,want", [
    ("<body><nav>n</nav><main><h1>A</h1><p>x <b>b</b> <i>i</i></p></main></body>", "# A\n\nx **b** *i*"),
    ("<article><h2>A</h2><footer>f</footer><script>s()</script></article><p>out</p>", "## A"),
    ('<div id="content"><p>c</p></div><div class="content">d</div>', "c"),
    ('<div class="big content"><p>d</p></div>', "d"),
    ('<div class="main">m</div>', "m"),
    ("<body><p>one<p>two<br>three</body>", "one\n\ntwo\nthree"),
    ("no body &amp; text", "no body & text"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "* a\n* b\n  1. c"),
    ('<p><a href="/u">l</a> <img src="s" alt="a"> <code>k</code></p>', "[l](/u) ![a](s) `k`"),
    ("<blockquote><p>q</p></blockquote><hr><pre> x\n y</pre>", "> q\n\n---\n\n```\n x\n y\n```"),
    ("<table><tr><th>a</th><td>b</td></tr></table>", "| a | b |"),
])
def test_markdown_of_page(page, want):
    assert html.to_markdown(page) == want


def test_deep_markup_is_survived():
    assert "x" in html.to_markdown("<div>" * 5000 + "x" + "</div>" * 5000)


@pytest.mark.parametrize("answer,want", [
    ("QUALITY: HIGH\nSCORE: 0.92\nNOTES: -\nRESULT: Example", ("HIGH", 0.92, "-", "Example")),
    ("quality: low\nRESULT:\n- Item 1\n- Item: two\nmore", ("LOW", 0.6, "", "- Item 1\n- Item: two\nmore")),
    ("SCORE: high\nRESULT: a: b\nhint: c", ("MEDIUM", 0.5, "", "a: b\nhint: c")),
    ("SCORE: 1.7", ("MEDIUM", 1.0, "", "")),
    ("", ("MEDIUM", 0.5, "Empty validation response", "")),
    ("RESULT: x\nNOTES: n\nRESULT:", ("MEDIUM", 0.6, "n", "x")),
])
def test_read_validation(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "t string")
    assert tuple(df.select(answers.parse_validation(F.col("t"))).first()[0]) == want


def test_response_confidence(spark):
    rows = [("stop", None, "long text"), ("length", None, "long text"), ("content_filter", [], "long text"), ("tool", None, ""), (None, None, "long"),
            ("stop", [-1.0, -2.0], "long text"), ("stop", [-9.0], "long text"), ("stop", [-1.0], " ab ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, l array<double>, c string").orderBy("i")
    got = [x[0] for x in df.select(answers.response_confidence(F.col("r"), F.col("l"), F.col("c"))).collect()]
    assert got == [0.8, 0.6, 0.3, 0.5, 0.5, 0.85, 0.5, 0.5]


def test_parse_normalization(spark):
    values = ["MATCH: A B (Confidence: 0.95)", "match: A (Confidence: .7)", "LIKELY: A (Confidence: 1.7)", "NO_MATCH (Confidence: 0.2)", "MATCH: A",
              "MATCH: A (Confidence: x)", "free text", "", None, "MATCH: (Confidence: 0.9)"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, answer string")
    got = [tuple(r)[2:] for r in answers.parse_normalization(df).orderBy("i").collect()]
    assert got == [("MATCH", "A B", 0.95), ("MATCH", "A", 0.7), ("LIKELY", "A", 1.0), ("NO_MATCH", None, 0.0), ("MATCH", "A", 0.5), ("MATCH", "A", 0.5),
                   ("NO_MATCH", "free text", 0.5), ("NO_MATCH", None, 0.0), ("NO_MATCH", None, 0.0), ("MATCH", None, 0.9)]


TEXTS = ["# T\n**Institution:** X\n", "Institution: -\nInstitution: Y", "\n" * 15 + "Institution: Z", "\n" * 19 + "Institution: [W](u)", "plain", None]


def test_institution_forms(spark):
    assert one(spark, TEXTS, md.profile_institution) == ["X", "Y", "", "", "", ""]
    assert one(spark, TEXTS, lambda c: md.profile_institution(c, 20, True)) == ["X", "Y", "Z", "W", "", ""]
    assert one(spark, TEXTS, lambda c: md.profile_institution(c, stop=True)) == ["X", "", "", "", "", ""]


def test_section_description(spark):
    values = ["a\n ## Beschreibung \n x \n\ny\n### z\nno", "## Description\n" + "w" * 400, "# none", "## beschreibung"]
    assert one(spark, values, md.section_description) == ["x y", "w" * 297 + "...", "", ""]


@pytest.mark.parametrize("text,want", [
    ("# T\n\n## Kurzbeschreibung\n**a** [l](u)\n## B\nx", "a l"),
    ("# T\n\nURL: x\nfirst *p*\nsecond\n## B", "first p second"),
    ("# T\n# U\n\n", ""),
    ("## Beschreibung\n" + "word " * 80, ("word " * 39).strip() + "..."),
])
def test_teaser(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(md.teaser("t")).first()[0] == want


def test_linkify(spark):
    values = ["**Institution:** TU **B** ü/x", "**Institution**: A", "institution: B", "Institution: N/A", "x Institution: C"]
    assert one(spark, values, lambda c: md.linkify_institutions(c, "/kb/en")) == [
        "**Institution:** [TU **B** ü/x](/kb/en/search.html?q=TU%20B%20%C3%BC/x)", "**Institution**: [A](/kb/en/search.html?q=A)",
        "institution: [B](/kb/en/search.html?q=B)", "Institution: N/A", "x Institution: C"]


def test_render_template(spark):
    template = "$a ${b} $$5 $c ${d}x $ 1 $a_b"
    df = spark.createDataFrame([({"a": "A", "b": "has $word", "a_b": "u"},)], "v map<string,string>")
    got = df.select(md.render_tokens(md.template_tokens(F.lit(template)), F.col("v"))).first()[0]
    assert got == "A has - $5 - -x $ 1 u"


def test_fallback_markdown(spark):
    df = spark.createDataFrame([({"service_name": "S", "contact_email": "e", "a": "1", "source_url": "u"},)], "v map<string,string>")
    got = df.select(md.fallback_markdown(F.col("v"), F.lit("http://u"))).first()[0]
    assert got == "# S\n\n**URL:** http://u\n\n**A:** 1\n\n**Contact Email:** e\n"


@pytest.mark.parametrize("text,want", [
    ("", render.EMPTY),
    ("# A b\n\ntext **b** *i* `c` [l](u)\nmore & <x>", '<h1 id="a-b">A b</h1>\n\n<p>text <strong>b</strong> <em>i</em> <code>c</code> <a href="u">l</a>\nmore &amp; &lt;x&gt;</p>\n'),
    ("- a\n- b\n\n1. c", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n\n<ol>\n<li>c</li>\n</ol>\n"),
    ("```\nx < y\n```", "<pre><code>x &lt; y\n</code></pre>\n"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "<table>\n<thead><tr><th>a</th><th>b</th></tr></thead>\n<tbody>\n<tr><td>1</td><td>2</td></tr>\n</tbody>\n</table>\n"),
])
def test_markdown_to_html(text, want):
    assert render.to_html(text) == want


def test_highlight(spark):
    got = one(spark, ["A+b <i> a+B Äx"], lambda c: s.highlight(c, F.array(F.lit("b"), F.lit("a+b"), F.lit("ä"))))
    assert got == ["<mark>A+<mark>b</mark></mark> &lt;i&gt; <mark>a+<mark>B</mark></mark> <mark>Ä</mark>x"]


@settings(max_examples=400, deadline=None)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_matched_length_is_difflib(a, b):
    want = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    assert similarity.matched_length(a, b) == want
    if b:
        # The letters that two texts share bound what can match.
        block = similarity.NameBlock([1], [b])
        assert np.minimum(similarity.letter_counts(a), block.counts[0]).sum() >= want


def test_name_similarity(spark):
    pairs = [("TU Berlin", "tu berlin "), ("TU Berlin", "die tu berlin"), ("Universität Ulm", "Ulm Universität Klinik"), ("abcd", "abce"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [round(r[0], 6) for r in df.select(similarity.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.8, round(0.7 * 2 / 3, 6), round(0.6 * 0.75, 6), 0.0]


def test_validation_answers(spark):
    texts = [
        "Quality: high\nSCORE: 0.9\nNOTES: ok\nRESULT: a\n- b: c\n\n  d\nquality : low", "RESULT: x\nRESULT:\nSCORE: bad", "score: 7", "", None, " \n ", "no labels: here", "RESULT:\n\nNOTES:\nx",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(answers.parse_validation(F.col("t"))).collect()]
    assert got == [
        ("LOW", 0.9, "ok", "a\n- b: c\nd"), ("MEDIUM", 0.5, "", "x"), ("MEDIUM", 1.0, "", ""), ("MEDIUM", 0.5, "Empty validation response", ""),
        ("MEDIUM", 0.5, "Empty validation response", ""), ("MEDIUM", 0.6, "", ""), ("MEDIUM", 0.6, "", ""), ("MEDIUM", 0.6, "", ""),
    ]


def test_links_by_attribute(spark):
    cases = {
        """<a href="/it's-here">""": ["/it's-here"], '<a data-href="/wrong" href="/right">': ["/right"], "<a href=/unquoted>": ["/unquoted"],
        """<!-- <a href="/c"> --><a title="x href=q" href='/y?a=1&amp;b=2'>""": ["/y?a=1&b=2"], "<script>'<a href=\"/s\">'</script><a HREF = \"/z\">": ["/z"],
    }
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert [r[0] for r in df.select(web.hrefs(F.col("h"))).collect()] == list(cases.values())


def test_deep_and_nested_markup():
    assert html.to_markdown("<ul><div><li>kept</li></div><li>a<ul><li>b</ul>text</ul>") == "* kept\n* atext\n  * b"
    assert html.to_markdown("<blockquote>" * 100 + "x").endswith("> x")
    assert html.to_markdown("<div>" * 205 + "a<script>var leak=1</script><nav>NAVLEAK</nav>") == "a"
