"""Readers for the input tables (parquet, one file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

# Tables whose rows carry long texts: per-row work is CPU-heavy.
TEXT_TABLES = {"documents", "pages", "conversations"}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    p = os.path.join(sf_dir, f"{name}.parquet")
    return p if os.path.exists(p) or "://" in sf_dir else os.path.join(sf_dir, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.
    Text tables are spread over the cores when the scan is under-split."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if name in TEXT_TABLES else df
