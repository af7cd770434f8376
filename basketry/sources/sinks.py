"""Sinks: feature tables as Parquet, experiment logs as CSV, nested pattern documents as JSON.

All writes go through Spark's writers (one file set per partition, atomic commit per job), so they
work unchanged on a cluster file system. ``overwrite`` replaces the whole target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header row (the experiment log format)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, column: str | None = None) -> str:
    """JSON lines; with ``column`` naming a JSON string column (e.g. ``shopping_patterns_json``'s
    ``patterns``), that document is written as-is, one per line."""
    if column:
        df.select(column).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)
    return path
