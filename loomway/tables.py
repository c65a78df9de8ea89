"""Tables by name under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomway.session import ensure_workers


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table `name` of `folder`, cut to `columns` when given."""
    ensure_workers(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
