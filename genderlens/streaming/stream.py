"""Structured Streaming form of the row-wise operators.

Cleaning (C1, C2, C4-C6, C8-C11), counting and the three rewrites (T4-T9,
T14 word path) are stateless per row, so the same column expressions run on
a ``readStream`` source. ``run_available`` drains what is available
(``availableNow``) into a parquet sink with its own checkpoint folder under
the shared ``spark.checkpoint.dir``; a run restarted under the same name
resumes from that checkpoint (exactly-once file sink)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.terms import masked_table
from ..session import checkpoint_dir
from ..sources import files
from ..sources import lexicon as lx
from ..sources.tables import table_path


def document_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Documents table as a file stream (schema taken from the batch table).
    A table with fewer splits than the cores is dealt round-robin to twice as
    many tasks as there are cores; at scale the files' splits are the tasks."""
    path = table_path(sf_dir, "documents")
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if path.endswith(".parquet") and files.is_file(spark, path):
        # a single-file table: watch its folder, filtered to that file
        stream = reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    else:
        stream = reader.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return stream.repartition(2 * cores) if table.rdd.getNumPartitions() < cores else stream


def masked_stream(docs: DataFrame) -> DataFrame:
    """Stateless masking of a (streaming or batch) documents frame."""
    base = docs.select(F.col("doc_id").alias("ID"), clean_text("text").alias("Review_cleaned"))
    return masked_table(base, "Review_cleaned", lx.f2m_pairs(), lx.m2f_pairs(), lx.term_universe(),
                        lx.PRONOUNS)


def run_available(stream: DataFrame, name: str) -> str:
    """Drain the stream into parquet under the shared checkpoint folder and
    return the output path. ``name`` identifies the stream: a later call with
    the same name takes up where the last one stopped and adds to its output.
    Runs the stream before it returns."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    q = (stream.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/_checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{root}/out"
