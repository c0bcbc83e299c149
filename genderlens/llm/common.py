"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sized as cut

__all__ = ["components", "crc_rest", "cut", "range_buckets", "small", "sound", "table", "utf8_chunks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; any store that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_rest(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``. A null id counts
    as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def sound(vector: str):
    """Whether a vector (array of doubles) is there and holds finite numbers only."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def utf8_chunks(column: pa.Array, limit: int = 1 << 18):
    """Split a string column into row ranges of about ``limit`` bytes (one
    row at least) and yield ``(first_row, data, offsets)``: the UTF-8 bytes
    of the rows back to back and their bounds. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]
        at = end


def small(batches, column: int, limit: int = 1 << 20):
    """Cut record batches so that a text column holds about ``limit`` bytes
    each (one row at least): a batch has a bound on its rows only, and as
    Python objects long texts would take a worker's memory."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        step = max(1, b.num_rows * limit // max(b.column(column).nbytes, 1))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def range_buckets(df: DataFrame, key: str, bounds: list[float], out: str) -> DataFrame:
    """``df`` with ``out`` (int) = how many of the ascending ``bounds`` are at
    most ``key``, found by binary search; ``len(bounds) + 1`` for null."""
    if not bounds:
        return df.withColumn(out, F.when(F.col(key).isNull(), 1).otherwise(0))
    x = df.withColumn("__key", F.col(key).cast("double"))
    x = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="__key", outputCol="__at", handleInvalid="keep").transform(x)
    return x.withColumn(out, F.col("__at").cast("int")).drop("__key", "__at")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` (bigint nodes).

    Returns ``(node, component)`` for every node that has an edge; the
    component is its smallest node. Alternates large-star and small-star
    steps until the edge set no longer changes; every round is written to
    the shared folder. An empty edge table gives an empty result. Rows with
    a null end or equal ends are ignored."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(e)
    while seen[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.where("u <> v").distinct())
        now = _state(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Row count and order-free checksum of an edge table (one row)."""
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
