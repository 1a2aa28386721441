"""Named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as it lies in the folder (a file or a folder of files named NAME.parquet)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Each key once: redelivered rows repeat an earlier row's content, so any of them will do."""
    return df.dropDuplicates(list(keys))
