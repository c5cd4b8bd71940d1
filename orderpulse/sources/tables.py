"""Reading the parquet tables of a data directory, with column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, data_dir: str, name: str, columns=None) -> DataFrame:
    """``spark.read.parquet`` of ``<data_dir>/<name>.parquet``; selecting ``columns``
    early keeps the scan's ReadSchema to what the query needs."""
    df = spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the frame is
    returned unchanged and the planner (AQE) picks the join strategy from
    runtime sizes."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
