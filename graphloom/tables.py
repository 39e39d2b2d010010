"""Access to the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, a Parquet file or folder named after it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
