"""Writers.  Every sink is a folder of part files written by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F


def write_search_index(items: DataFrame, path: str) -> None:
    """One JSON object per line and item."""
    items.write.mode("overwrite").json(path)


def write_entity_index(entries: DataFrame, path: str) -> None:
    """JSON lines in one folder per section, sorted by name inside each file."""
    entries.repartitionByRange("section", "name").sortWithinPartitions("section", "name").write.mode("overwrite").partitionBy("section").json(path)


#: The protocol allows 50,000 addresses per document.
SITEMAP_ADDRESSES = 25_000


def write_sitemap(pages: DataFrame, path: str, most: int = SITEMAP_ADDRESSES) -> None:
    """One complete sitemap document per part file, closed by its own root tags.

    Each task closes a document after ``most`` addresses, so the pages are read once and not
    counted; small parts are merged first, so a small site is one document.  A document is a
    row and a file; without pages there is none.
    """
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'

    def documents(batches):
        import pandas as pd

        def closed(some):
            return pd.DataFrame({"value": [head + "".join(f"{line}\n" for line in some) + "</urlset>"]})

        lines: list[str] = []
        for batch in batches:
            lines.extend(batch["value"])
            while len(lines) >= most:
                yield closed(lines[:most])
                lines = lines[most:]
        if lines:
            yield closed(lines)

    rows = pages.select(F.col("xml").alias("value")).hint("rebalance").mapInPandas(documents, "value string")
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_observed(rows: DataFrame, path: str, **counts: Column) -> DataFrame:
    """Write ``rows`` as Parquet and count in the same pass: one row with the number of rows and of those that meet each condition.

    The counts are taken right below the write, by the tasks whose files are committed, so
    a task that runs again after a loss does not count twice.  A condition that is NULL is
    not met.  No rows give counts of 0.
    """
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counts.items()]).write.mode("overwrite").parquet(path)
    found = seen.get
    names = ["rows", *counts]
    return rows.sparkSession.createDataFrame([tuple(found.get(n) or 0 for n in names)], ", ".join(f"`{n}` long" for n in names))


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write a new version folder and name it in the pointer table beside it."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    current = df.sparkSession.range(1).select(F.lit(version).alias("version"))
    current.write.mode("overwrite").json(f"{root}/_current")
    return path


def read_current(spark, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/_current").first()["version"]
    return spark.read.parquet(f"{root}/version={version}")
