"""The corpus pipeline: five stages over ``documents``. Each is written as
Parquet and read again as the next one's input; all but the last return the
columns of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genderlens.llm import packing, quality, simhash, suffix_dedup, toxicity
from genderlens.llm.common import table
from genderlens.session import checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the boosted trees call toxic."""
    judged = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the support vectors reject."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest id) of each near-duplicate group."""
    return simhash.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the repeated byte strings of each text; ``n_chars`` follows."""
    cut = suffix_dedup.cleaned(docs, kept="text")
    cut = cut.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins."""
    return packing.pack_apart(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity_stage), ("quality classifier", quality_stage), ("simhash near-dedup", simhash_stage),
          ("suffix-array dedup", suffix_stage), ("best-fit packing", packing_stage)]

#: Trained models and suffix sorting cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage's rows are written to
    the shared checkpoint folder and read back."""
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{n}")
        docs = spark.read.parquet(f"{root}/{n}")
    return docs
