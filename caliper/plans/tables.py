"""Access to the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores.  The driver's tables are single files; a table with
    many splits needs no such shuffle, so no operator does this by itself."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
