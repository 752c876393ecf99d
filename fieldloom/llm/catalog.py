"""Registered queries of the llm operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import twins
from fieldloom.plans.ship import ship_package

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, str] = {}


def _query(sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        _QUERIES[fn.__name__] = run
        if sql is not None:
            _TWINS[fn.__name__] = sql
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_TWINS)


@_query(twins.REPEATED_WORDS)
def op6_substring_dedup(read):
    from fieldloom.llm.repeats import repeated_words

    return repeated_words(read("documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query(twins.NEAR_DUPLICATES)
def op1_minhash_near_dedup(read):
    from fieldloom.llm.near_dedup import near_duplicates

    return near_duplicates(read("documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query()
def op8_token_files(read):
    from fieldloom.llm.token_files import read_token_files, shared_folder, write_token_files

    docs = read("documents")
    folder = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(docs.sparkSession, folder)


@_query()
def op10_mixture_packing(read):
    from fieldloom.llm.packing import pack_documents

    return pack_documents(read("documents"), tokenizer_path("byte_bpe_50k.json"))


@_query(twins.CONTAMINATED)
def op7_benchmark_decontamination(read):
    from fieldloom.llm.decontamination import contaminated_documents

    return contaminated_documents(read("documents"), read("benchmark"))


@_query(twins.BEST_VECTORS)
def op3_maxscore_search(read):
    from fieldloom.llm.topk import scaled, search

    table = read("embeddings")
    vectors = table.select(table["vec_id"].cast("long").alias("vec_id"), scaled(table["embedding"]).alias("vector"))
    return search(vectors.where("vec_id % 20 = 0"), vectors)


@_query()
def op4_language_id(read):
    from fieldloom.llm.language_id import identify_languages

    return identify_languages(read("documents"))


@_query()
def op5_toxicity(read):
    from fieldloom.llm.toxicity import toxic_documents

    return toxic_documents(read("documents"), read("labels"))


@_query()
def op2_html_extraction(read):
    from fieldloom.llm.html_extraction import extract_pages

    return extract_pages(read("pages"))


@_query()
def op9_pii(read):
    from fieldloom.llm.pii import find_personal_data

    return find_personal_data(read("documents"))


@_query(twins.SOURCE_DIVERGENCE)
def op11_source_divergence(read):
    from fieldloom.llm.divergence import source_divergence

    return source_divergence(read("documents"))


@_query()
def op12_document_fingerprints(read):
    from fieldloom.llm.fingerprints import document_fingerprints

    return document_fingerprints(read("documents"))


@_query(twins.VECTOR_CODES)
def op13_vector_codes(read):
    from fieldloom.llm.codes import compressed_vectors

    return compressed_vectors(read("embeddings"))
