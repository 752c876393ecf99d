"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldloom.llm.token_files import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read again: cuts the lineage, compressed and of known size."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
