"""Tables in buckets: a change set rewrites the buckets it touches and nothing else.

A version is a manifest of one row per bucket that names the folder with the bucket's rows.
A commit writes the touched buckets into a folder of its own and then the manifest, one
file, which takes the other buckets from the version before by reference.  So the bytes
written follow the change set, a reader of a version sees the same rows whatever is
committed after, and a commit that is lost before its manifest leaves the old version.

Only the manifest, bounded by the number of buckets, passes through the driver.  One writer
at a time is assumed; one that started from an older version than the newest is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fieldloom.plans.order import cut_lineage


class StaleVersion(RuntimeError):
    """The table has a newer version than the one that a commit started from."""


def read_or_empty(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    """A folder of files; no rows while nothing has been written to it."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


class VersionedTable:
    """Rows with the columns of ``schema``, dealt to ``buckets`` by the hash of ``placed_by``.

    ``placed_by`` is the key of the table or its first part, so that what changes together
    lies together.  A bucket of 100 to 500 MB is a good size: it is the least that a commit
    rewrites, and one task writes it.
    """

    def __init__(self, spark: SparkSession, root: str, schema, placed_by: list[str], buckets: int = 64):
        self.spark, self.root, self.placed_by, self.buckets = spark, root, placed_by, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._placed = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.placed_by), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/manifests", "bucket int, folder string, n_rows long, version long", "json")

    def current(self) -> int:
        """The newest version; -1 before the first commit."""
        newest = self._manifests().agg(F.max("version")).first()[0]
        return -1 if newest is None else newest

    def manifest(self, version: int) -> dict[int, tuple[str, int]]:
        """Folder and number of rows of each bucket that has been written."""
        return {r["bucket"]: (r["folder"], r["n_rows"]) for r in self._manifests().where(F.col("version") == version).collect()}

    def _rows(self, files: dict[int, tuple[str, int]]) -> DataFrame:
        paths = [f"{folder}/_bucket={bucket}" for bucket, (folder, n) in sorted(files.items()) if n]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(self.current() if version is None else version))

    def changed(self, since: int, to: int) -> DataFrame:
        """Rows of the buckets that differ between two versions: ``_sign`` -1 as they were, 1 as they are.

        Rows of these buckets that are equal in both cancel in any sum over the signs.
        """
        old, new = (self.manifest(v) if v >= 0 else {} for v in (since, to))
        differ = [b for b in old.keys() | new.keys() if old.get(b) != new.get(b)]
        before, after = (self._rows({b: files[b] for b in differ if b in files}) for files in (old, new))
        return before.withColumn("_sign", F.lit(-1)).unionByName(after.withColumn("_sign", F.lit(1)))

    def replace(self, rows: DataFrame) -> int:
        """Commit ``rows`` as the whole table."""
        return self._commit(rows, self.current(), {}, range(self.buckets))

    def apply(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Commit ``merge(rows, changes)`` over the buckets that ``changes`` touches; the number of the version.

        ``changes`` has the columns of ``placed_by``; ``merge`` must leave rows alone that no
        change names, and keep the rows it changes under the same ``placed_by``.
        """
        base = self.current()
        files = self.manifest(base) if base >= 0 else {}
        changes = cut_lineage(changes)
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}
        if not touched:
            return base
        old = self._rows({b: f for b, f in files.items() if b in touched})
        return self._commit(merge(old, changes), base, files, touched)

    def _commit(self, rows: DataFrame, base: int, files: dict, touched) -> int:
        folder = f"{self.root}/data/commit={uuid.uuid4().hex}"
        rows.select(*self.schema.names).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        written = self.spark.read.schema(self._placed).parquet(folder).groupBy("_bucket").count().collect()
        sizes = {r["_bucket"]: r["count"] for r in written}
        if not sizes.keys() <= set(touched):
            raise ValueError("merge moved rows to buckets that no change names")
        files = {**files, **{b: (folder, sizes.get(b, 0)) for b in touched}}
        if self.current() != base:
            raise StaleVersion(f"version {base} of {self.root} is not the newest any more")
        manifest = self.spark.createDataFrame([(b, *f) for b, f in sorted(files.items())], "bucket int, folder string, n_rows long")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifests/version={base + 1}")
        return base + 1
