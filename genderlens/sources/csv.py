"""CSV sources and sinks (S1-S5) with explicit schemas.

Scratch output goes under the shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temp folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

# Values are kept byte for byte: Spark's CSV writer trims surrounding
# whitespace unless told not to, and an explicit null marker keeps an empty
# string ("") apart from a missing value.
NULL_MARK = "\\N"
CSV_OPTS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "nullValue": NULL_MARK}


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/csv-{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    """CSV sink; 'append' adds part files, each with its own header."""
    opts = {k: v for k, v in CSV_OPTS.items() if k != "multiLine"}
    df.write.mode(mode).options(**dict(opts, header=str(header).lower())).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV scan with an explicit schema (no inference), quoted
    multi-line fields allowed."""
    opts = dict(CSV_OPTS, header=str(header).lower())
    return spark.read.options(**opts).schema(schema).csv(path)


def drop_embedded_headers(df: DataFrame, first_col: str) -> DataFrame:
    """Drop rows that repeat the header (left by appending a header with
    every write); the caller casts the columns afterwards."""
    return df.filter(~F.col(first_col).eqNullSafe(first_col))


def write_lines_in_order(df: DataFrame, line: str, order: list[str], path: str) -> None:
    """Write text lines in a given order as one file (for small result
    tables only: the caller bounds the size, e.g. one row per model)."""
    df.orderBy(*order).select(line).coalesce(1).write.mode("overwrite").text(path)


def with_index(df: DataFrame, order_col: str, name: str = "index") -> DataFrame:
    """A 0-based row index column for sinks that write one, following a
    dense 1-based order column (e.g. the categorical model order)."""
    return df.select((F.col(order_col) - 1).cast("long").alias(name), *[c for c in df.columns])
