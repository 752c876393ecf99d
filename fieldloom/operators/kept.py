"""Counts and sums that are kept current instead of counted anew.

A change of a table is a set of signed rows (the old row -1, the new row 1).  Its signed
counts and sums are added to the stored ones, and groups that fall to no rows go.  Averages
are kept as a sum and a count.  Sums are decimals, so any order of changes gives the sums
that a new count would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.operators.records import SOURCE_STATES, has_value
from fieldloom.operators.statistics import metrics
from fieldloom.sources.versions import VersionedTable, read_or_empty

_SUM = "decimal(38,6)"


def signed_counts(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``by``, ``n`` and the sums of rows that carry ``_sign``."""
    sign = F.col("_sign")
    totals = [F.sum(F.when(value.isNotNull(), (sign * value).cast(_SUM)).otherwise(F.lit(0).cast(_SUM))).cast(_SUM).alias(name) for name, value in sums.items()]
    return rows.groupBy(*by).agg(F.sum(sign.cast("long")).alias("n"), *totals)


def fold(state: DataFrame, delta: DataFrame, by: list[str]) -> DataFrame:
    """Stored counts with the signed counts of a change; groups without rows are left out."""
    sums = [c for c in state.columns if c not in (*by, "n")]
    added = state.unionByName(delta).groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).cast(_SUM).alias(c) for c in sums])
    return added.where("n <> 0")


class KeptCounts:
    """Counts by ``by`` and sums of a versioned table, stored beside it, one folder a version.

    ``refresh`` reads only the buckets that changed since the version counted last.
    """

    def __init__(self, table: VersionedTable, name: str, by: list[str], sums: dict[str, Column] | None = None):
        self.table, self.by, self.sums = table, by, sums or {}
        self.folder = f"{table.root}/views/{name}"
        empty = table.spark.createDataFrame([], table.schema).withColumn("_sign", F.lit(1))
        self.schema = signed_counts(empty, by, self.sums).schema

    def counted(self) -> int:
        """The version counted last; -1 if none is."""
        newest = read_or_empty(self.table.spark, f"{self.folder}/done", "version long", "json").agg(F.max("version")).first()[0]
        return -1 if newest is None else newest

    def _stored(self, version: int) -> DataFrame:
        if version < 0:
            return self.table.spark.createDataFrame([], self.schema)
        return self.table.spark.read.schema(self.schema).parquet(f"{self.folder}/counts/version={version}")

    def refresh(self) -> DataFrame:
        """Counts of the newest version."""
        last, now = self.counted(), self.table.current()
        if last < now:
            delta = signed_counts(self.table.changed(last, now), self.by, self.sums)
            fold(self._stored(last), delta, self.by).write.mode("overwrite").parquet(f"{self.folder}/counts/version={now}")
            # Named only when all files are there; a lost refresh is done again from the last one named.
            self.table.spark.range(1).select(F.lit(now).alias("version")).coalesce(1).write.mode("append").json(f"{self.folder}/done")
        return self._stored(now)


def average(total: str, count: str) -> Column:
    """Average of a kept sum; NULL for a group without values."""
    return F.col(total).cast("double") / F.nullif(F.col(count), F.lit(0)).cast("double")


class KeptStatistics:
    """Reports over versioned tables of sources, extractions and profiles.

    ``refresh`` folds what changed since the last call into three sets of counts, of one row
    per state and category, per field and translation state, and per state of publication;
    the reports read these counts only, never the tables.
    """

    def __init__(self, sources: VersionedTable, extractions: VersionedTable, profiles: VersionedTable, threshold: float = 0.7):
        value, english = has_value(), F.col("validated_result_en").isNotNull()
        score = F.col("final_confidence")
        flags = {
            "filled": value, "untranslated": value & ~english, "linked": F.col("linked_entity_id").isNotNull(),
            "scored": score.isNotNull(), "low": score < threshold,
        }
        sums = {name: F.coalesce(flag, F.lit(False)).cast("int") for name, flag in flags.items()}
        self._views = (
            KeptCounts(sources, "states", ["status", "category_id"]),
            KeptCounts(extractions, "fields", ["prompt_id", "translation_status"], {**sums, "confidence": score.cast("decimal(18,6)")}),
            KeptCounts(profiles, "published", ["published"]),
        )

    def refresh(self) -> KeptStatistics:
        self.sources, self.extractions, self.profiles = (view.refresh() for view in self._views)
        return self

    def count_by_status(self) -> DataFrame:
        """Rows per state; states without a row count zero."""
        states = self.sources.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SOURCE_STATES])).alias("status"))
        return states.join(self.sources.groupBy("status").agg(F.sum("n").alias("n")), "status", "left").fillna(0, ["n"])

    def with_sources(self, categories: DataFrame, name: str, status: str | None = None) -> DataFrame:
        """Categories with the number of their sources (in a state), zero included."""
        counted = self.sources if status is None else self.sources.where(F.col("status") == status)
        return categories.join(counted.groupBy("category_id").agg(F.sum("n").alias(name)), "category_id", "left").fillna(0, [name])

    def dashboard(self) -> DataFrame:
        """(metric, value) rows; the average is exact to six decimals of a confidence."""
        of = lambda name, test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(name)
        state = lambda *names: F.col("status").isin(*names)
        total = lambda name, column: F.coalesce(F.sum(column), F.lit(0)).alias(name)
        scored = self.extractions.agg(
            total("total_extractions", "n"), total("validated_extractions", "filled"), total("linked_extractions", "linked"),
            total("low_confidence", "low"), F.sum("confidence").alias("_sum"), F.sum("scored").alias("_n"))
        return metrics(
            self.sources.agg(
                of("total_sources", F.lit(True)), of("completed_sources", state("completed")), of("failed_sources", state("failed")),
                of("open_sources", state("pending", "crawled", "extracting"))),
            self.profiles.agg(of("total_profiles", F.lit(True)), of("published_profiles", F.col("published")), of("unpublished_profiles", ~F.col("published"))),
            scored.withColumn("avg_confidence", F.bround(F.coalesce(average("_sum", "_n"), F.lit(0.0)) * 100, 1)).drop("_sum", "_n"))

    def translation_stats(self, prompts: DataFrame) -> DataFrame:
        """Translation progress; fields that ``prompts`` does not list are left out."""
        rows = self.extractions.join(prompts.select("prompt_id", "translatable"), "prompt_id")
        of = lambda column, test=F.lit(True): F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).cast("long")
        state, can = F.col("translation_status"), F.coalesce("translatable", F.lit(False))
        waits = F.coalesce(state == "pending", F.lit(True))
        counted = rows.agg(
            of("filled").alias("total"), of("filled", can).alias("translatable"), of("n", state == "translated").alias("translated"),
            (of("filled", can & waits) + of("untranslated", can & ~waits)).alias("pending"), of("n", state == "failed").alias("failed"))
        share = F.bround(F.col("translated") / F.nullif(F.col("translatable"), F.lit(0)) * 100, 1)
        return counted.select("*", (F.col("total") - F.col("translatable")).alias("skipped"), F.coalesce(share, F.lit(0.0)).alias("progress"))
