"""Table access: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.session import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``; Catalyst prunes its columns."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
