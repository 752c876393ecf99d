"""Every registered llm query over a whole folder, against its twin or a plain version."""

import hashlib
import html
import re

import brute
import pytest
from compare import check, make_duck
from pyspark.sql import functions as F

from fieldloom.llm import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_twin(spark, name):
    assert check(spark, make_duck(SF_DIR), SF_DIR, name, catalog.queries()[name], catalog.oracle_sql()[name]) is None


def run(spark, name, sf_dir=SF_DIR):
    return catalog.queries()[name](spark, sf_dir)


def test_html_extraction(spark):
    def plain(page):
        inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))
        return "\n".join(line for b in blocks if (line := " ".join(html.unescape(b).split())))

    got = {r.page_id: r for r in run(spark, "op2_html_extraction").collect()}
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == plain(p.html) and got[p.page_id].n_chars == len(plain(p.html))


def test_language_id(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = run(spark, "op4_language_id", sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 0.25 < len(held) / len(rows) < 0.42
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = run(spark, "op5_toxicity", sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic) and sum(r.predicted for r in clean) < 0.02 * len(clean)
    assert got.where("score < 0 OR score > 1 OR score IS NULL OR (score >= 0.3) <> (predicted = 1)").isEmpty()


def test_token_files(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer_path("word_bpe_49k.json"))
    got = sorted(tuple(r) for r in run(spark, "op8_token_files").select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute.token_rows(tokenizer, [(d.doc_id, d.text) for d in documents])


def test_personal_data(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op9_pii").collect()}
    for d in documents:
        want = brute.personal_data(d.text)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[d.doc_id].spans.split(","))
        for kind in ("email", "ip", "card", "phone"):
            assert got[d.doc_id][f"n_{kind}"] == want.count(kind)


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalog.tokenizer_path("byte_bpe_50k.json"))
    brute.check_pieces(run(spark, "op10_mixture_packing").collect(), {d.doc_id: brute.token_ids(tokenizer, d.text) for d in documents})


def test_each_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries())
    assert numbers == list(range(1, 14)) and set(catalog.oracle_sql()) < set(catalog.queries())


def test_pipeline(spark, documents):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs, columns = spark.read.parquet(f"{SF_DIR}/documents.parquet"), None
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    whole = {d.doc_id: d.text for d in documents}
    assert seen[0] == whole  # all have letters and a clear language
    assert seen[1] == {d: whole[d] for d, (_, _, kept) in brute.near_duplicates(whole.items()).items() if kept}
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    hits = {r[0] for r in brute.contaminated(seen[1].items(), [(b.item_id, b.text) for b in benchmark]) if r[5]}
    assert hits and seen[2] == {d: t for d, t in seen[1].items() if d not in hits}
    assert seen[3].keys() == seen[2].keys()
    for doc, text in seen[3].items():
        assert not brute.personal_data(text)
        assert (text == seen[2][doc]) == (not brute.personal_data(seen[2][doc]))
    assert docs.where(F.col("n_chars") != F.char_length("text")).isEmpty()
    tokenizer = Tokenizer.from_file(catalog.tokenizer_path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    brute.check_pieces(pieces, {d: brute.token_ids(tokenizer, t) for d, t in seen[3].items()})
