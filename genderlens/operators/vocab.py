"""Vocabulary, word-class filtering and name classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name
from .terms import vocabulary


def corpus_vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """Distinct words of the corpus (sort at the sink if needed)."""
    return vocabulary(docs, text)


def filter_by_class(vocab: DataFrame, classes: DataFrame, word_col: str = "word") -> DataFrame:
    """Vocabulary words present in a user-supplied word-class table."""
    return vocab.join(classes.select(F.col(word_col).alias("word")), "word", "left_semi")


def classify_names(lookup: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Name -> male / female / unknown.

    probability >= threshold with gender male/female -> that gender; below
    the threshold or without a probability -> unknown; confident but any
    other gender -> dropped."""
    p, g = F.col("probability"), F.col("gender")
    cls = (F.when(p.isNull(), "unknown")
           .when(p >= threshold, F.when(g == "male", "male").when(g == "female", "female"))
           .otherwise("unknown"))
    return lookup.withColumn("class", cls).filter(F.col("class").isNotNull())


def name_lists(lookup: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Cleaned male and female names as ``(name, gender, ord)`` for the lexicon."""
    c = classify_names(lookup, threshold).filter(F.col("class").isin("male", "female"))
    return c.select(clean_name("name").alias("name"), F.col("class").alias("gender"), "ord")


def list_sizes(vocab: DataFrame, classified: DataFrame) -> DataFrame:
    """Cardinalities of the unique vocabulary and of each name class."""
    v = vocab.agg(F.count_distinct("word").alias("n")).select(F.lit("vocabulary").alias("list"), "n")
    n = classified.groupBy(F.col("class").alias("list")).agg(F.count_distinct("name").alias("n"))
    return v.unionByName(n).withColumn("n", F.col("n").cast("long"))
