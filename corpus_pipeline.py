"""A corpus from raw documents: language, near copies, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a frame that is
written as Parquet and read again for the next.  All stages but the last return the
columns of ``docs``; a document that a stage rejects is not in its result.

A row may lack an id or repeat one: a stage judges documents by id and text, so such rows are
kept or rejected like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm import decontamination, language_id, near_dedup, packing, pii
from fieldloom.llm.catalog import tokenizer_path
from fieldloom.llm.token_files import shared_folder
from fieldloom.plans.order import cut_lineage
from fieldloom.plans.ship import ship_package

#: A document with a greater share of words in benchmark passages, or with so many of them, is rejected.
MOST_HIT_WORDS = 0
KEY = "_row_key"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is recognised; learned from the rows that have a language."""
    ship_package(spark)
    named = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    found = language_id.predict(docs, language_id.learn(named), keep=tuple(docs.columns))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= language_id.LEAST_SCORE)
    return found.where(known).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of each row from its id and text, which are null or repeated in some."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumn(KEY, F.xxhash64(doc, doc.isNull(), text, text.isNull()))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; one without an id only if none has one."""
    ship_package(spark)
    keyed = _keyed(docs)
    found = near_dedup.near_duplicates(keyed.select(F.col(KEY).alias("doc_id"), "text")).where("n_shingles > 0")
    rows = cut_lineage(found.groupBy(F.col("doc_id").alias("of")).agg(F.first("component_id").alias("group"), F.count(F.lit(1)).alias("n")))
    # Only groups of several rows, whose ids decide, go on.
    several = rows.groupBy("group").agg(F.sum("n").alias("rows")).where("rows > 1").select("group")
    rows = rows.join(several, "group")
    ids = keyed.select(F.col(KEY).alias("of"), F.col("doc_id").cast("long").alias("id")).join(rows, "of").groupBy("of", "group", "n").agg(F.min("id").alias("id"))
    best = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "of")).alias("best"))
    verdicts = ids.join(best, "group").select("of", (F.col("best.of") == F.col("of")).alias("first"), "n")
    verdicts = verdicts.where("NOT first OR n > 1").select("of", "first")
    judged = keyed.join(verdicts, F.col(KEY) == F.col("of"), "left")
    # Rows of equal id and text: one of them stays.
    once = judged.where("first").dropDuplicates([KEY])
    return judged.where("first IS NULL").unionByName(once).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    found = decontamination.contaminated_documents(keyed.select(F.col(KEY).alias("doc_id"), "text"), benchmark)
    hit = found.where(F.col("n_hit") > MOST_HIT_WORDS).select(F.col("doc_id").alias("hit")).distinct()
    return keyed.join(hit, F.col(KEY) == F.col("hit"), "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    ship_package(spark)
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(kind))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with the mixture of the sources."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("pii", redacted),
    ("packing", packed),
]

#: Language models, boosted trees and tokenizers can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
