"""Writing results; each writer is one Spark write, nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.write.mode("overwrite").json(path)


def write_ledger(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, so that later queries read only their columns and partitions."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
