"""Cleaning operators over review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import danish_date_fixed, danish_date_parity, sentiment, strip_author
from ..functions.text import clean_text
from .ranking import dense_id


def clean_reviews(df: DataFrame, order_key: str = "doc_id", mode: str = "parity") -> DataFrame:
    """Author prefix -> sentiment -> dense ID -> date -> cleaned text, on
    a raw review table (Title, URL, Author, Date, Rating, Review, <order_key>)."""
    date = danish_date_parity if mode == "parity" else danish_date_fixed
    x = (df.withColumn("Author", strip_author("Author", mode))
         .withColumn("Sentiment", sentiment("Rating")))
    x = dense_id(x, order_key, "ID")
    return (x.withColumn("Date", date("Date"))
            .withColumn("Review_cleaned", clean_text("Review")))


def drop_neutral(df: DataFrame) -> DataFrame:
    """Keep rows whose Sentiment is not 'neu' (nulls are kept)."""
    return df.filter(~F.col("Sentiment").eqNullSafe("neu"))


def length_gate(df: DataFrame, text: str = "text", max_chars: int = 5000) -> DataFrame:
    """Flag rows short enough for the paraphrase arm."""
    return df.withColumn("fits", F.length(text) <= max_chars)


def project_variant(df: DataFrame, variant: str) -> DataFrame:
    """C11: ID, <variant> AS text, Sentiment."""
    return df.select("ID", F.col(variant).alias("text"), "Sentiment")
