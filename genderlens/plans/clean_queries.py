"""Cleaning queries (C1-C11) over the ``reviews`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import (danish_date_fixed, danish_date_parity, label_encode,
                                  sentiment, strip_author)
from ..functions.text import clean_name, clean_text
from ..operators.clean import clean_reviews, drop_neutral, length_gate, project_variant
from ..operators.ranking import dense_id, file_order_id
from ..sources import fixtures as fx
from ..sources.csv import scratch_path
from ..sources.tables import read_table
from .registry import register

# DuckDB (RE2) spelling of the not-word-not-space class.
NW_SQL = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x{85}\p{Z}]"
DATE_PARITY_SQL = """strftime(try_strptime(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      {c}, 'jan.', 'Jan', 'g'), 'feb.', 'Feb', 'g'), 'mar.', 'Mar', 'g'), 'apr.', 'Apr', 'g'),
      'maj.', 'May', 'g'), 'jun.', 'Jun', 'g'), 'jul.', 'Jul', 'g'), 'aug.', 'Aug', 'g'),
      'sep.', 'Sep', 'g'), 'okt.', 'Oct', 'g'), 'nov.', 'Nov', 'g'), 'dec.', 'Dec', 'g'),
      ' \\|.*', ''), '(\\D)(\\d{{4}})$', '\\1 \\2'), '\\s+', ' ', 'g'), '%d. %b %Y'), '%d/%m/%Y')"""
DATE_FIXED_SQL = r"""CASE WHEN regexp_matches(lower(trim({c})), '^(\d{{1,2}})\.\s*(jan|feb|mar|apr|maj|jun|jul|aug|sep|okt|nov|dec)\p{{L}}*\.?\s*(\d{{4}})')
  THEN strftime(try_strptime(
    regexp_extract(lower(trim({c})), '^(\d{{1,2}})\.\s*(jan|feb|mar|apr|maj|jun|jul|aug|sep|okt|nov|dec)\p{{L}}*\.?\s*(\d{{4}})', 3) || '-' ||
    lpad(list_position(['jan','feb','mar','apr','maj','jun','jul','aug','sep','okt','nov','dec'],
      regexp_extract(lower(trim({c})), '^(\d{{1,2}})\.\s*(jan|feb|mar|apr|maj|jun|jul|aug|sep|okt|nov|dec)\p{{L}}*\.?\s*(\d{{4}})', 2))::VARCHAR, 2, '0') || '-' ||
    lpad(regexp_extract(lower(trim({c})), '^(\d{{1,2}})\.\s*(jan|feb|mar|apr|maj|jun|jul|aug|sep|okt|nov|dec)\p{{L}}*\.?\s*(\d{{4}})', 1), 2, '0'),
    '%Y-%m-%d'), '%d/%m/%Y') END"""
SENT_SQL = "CASE WHEN {r} >= 5 THEN 'pos' WHEN {r} <= 3 THEN 'neg' ELSE 'neu' END"


def clean_text_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), '{NW_SQL}', '', 'g')"


@register("clean_author", fx.with_views(
    "SELECT doc_id, ltrim(Author, 'Af ') AS Author FROM reviews", "reviews"))
def q_clean_author(spark, sf):
    return fx.reviews(spark, sf).select("doc_id", strip_author("Author", "parity").alias("Author"))


@register("clean_author_fixed", fx.with_views(
    r"SELECT doc_id, regexp_replace(Author, '^Af\s+', '') AS Author FROM reviews", "reviews"))
def q_clean_author_fixed(spark, sf):
    return fx.reviews(spark, sf).select("doc_id", strip_author("Author", "fixed").alias("Author"))


@register("sentiment_bucket", fx.with_views(
    f"SELECT doc_id, Rating, {SENT_SQL.format(r='Rating')} AS Sentiment FROM reviews", "reviews"))
def q_sentiment_bucket(spark, sf):
    return fx.reviews(spark, sf).select("doc_id", "Rating", sentiment("Rating").alias("Sentiment"))


@register("dense_id", fx.with_views(
    f"""SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ID
        FROM reviews WHERE {SENT_SQL.format(r='Rating')} IS DISTINCT FROM 'neu'""", "reviews"))
def q_dense_id(spark, sf):
    r = fx.reviews(spark, sf).withColumn("Sentiment", sentiment("Rating"))
    return dense_id(drop_neutral(r), "doc_id", "ID").select("doc_id", "ID")


@register("dense_id_nulls", """SELECT doc_id, n_chars, (row_number() OVER (ORDER BY key NULLS LAST, doc_id) - 1)::BIGINT AS ID
FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS key FROM documents)
WHERE key IS NOT NULL OR doc_id = (SELECT min(doc_id) FROM documents WHERE doc_id % 5 = 0)""")
def q_dense_id_nulls(spark, sf):
    """Keys with a null: it is kept and ranked last."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("key"))
    low = d.where(F.col("key").isNull()).agg(F.min("doc_id").alias("low"))
    one = d.join(F.broadcast(low), d["doc_id"] == low["low"], "left_semi")  # one row of null key
    return dense_id(d.where(F.col("key").isNotNull()).unionByName(one), "key", "ID", tie="doc_id").select("doc_id", "n_chars", "ID")


@register("dense_id_nulls_all", """SELECT doc_id, n_chars, (row_number() OVER (ORDER BY key NULLS LAST, doc_id) - 1)::BIGINT AS ID
FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS key FROM documents)""")
def q_dense_id_nulls_all(spark, sf):
    """Keys that repeat and a fifth of them null: every row gets one id, ties
    and null keys go by ``doc_id``."""
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("key"))
    return dense_id(d, "key", "ID", tie="doc_id").select("doc_id", "n_chars", "ID")


@register("dense_id_file_order", """SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ID
FROM (SELECT doc_id, n_chars FROM documents UNION ALL SELECT doc_id, n_chars FROM documents)""")
def q_dense_id_file_order(spark, sf):
    """A table of many files in which every row stands twice, numbered in the
    order of the files."""
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    path = f"{scratch_path(spark, 'order')}.parquet"
    d.union(d).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return file_order_id(spark.read.parquet(path))


@register("danish_date", fx.with_views(
    f"SELECT doc_id, Date AS raw_date, {DATE_PARITY_SQL.format(c='Date')} AS Date FROM reviews",
    "reviews"))
def q_danish_date(spark, sf):
    return fx.reviews(spark, sf).select("doc_id", F.col("Date").alias("raw_date"),
                                        danish_date_parity("Date").alias("Date"))


@register("danish_date_fixed", fx.with_views(
    f"SELECT doc_id, Date AS raw_date, {DATE_FIXED_SQL.format(c='Date')} AS Date FROM reviews",
    "reviews"))
def q_danish_date_fixed(spark, sf):
    return fx.reviews(spark, sf).select("doc_id", F.col("Date").alias("raw_date"),
                                        danish_date_fixed("Date").alias("Date"))


@register("clean_text", f"SELECT doc_id, {clean_text_sql('text')} AS Review_cleaned FROM documents")
def q_clean_text(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", clean_text("text").alias("Review_cleaned"))


@register("clean_names", fx.with_views(
    f"SELECT ord, trim({clean_text_sql('name')}) AS Name FROM name_lookup", "name_lookup"))
def q_clean_names(spark, sf):
    return fx.name_lookup(spark, sf).select("ord", clean_name("name").alias("Name"))


CLEAN_REVIEWS_SQL = fx.with_views(f"""
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ID, doc_id, Title, URL,
       ltrim(Author, 'Af ') AS Author, {DATE_PARITY_SQL.format(c='Date')} AS Date, Rating,
       {SENT_SQL.format(r='Rating')} AS Sentiment, {clean_text_sql('Review')} AS Review_cleaned
FROM reviews""", "reviews")


@register("clean_reviews", CLEAN_REVIEWS_SQL)
def q_clean_reviews(spark, sf):
    return clean_reviews(fx.reviews(spark, sf)).select(
        "ID", "doc_id", "Title", "URL", "Author", "Date", "Rating", "Sentiment", "Review_cleaned")


@register("drop_neutral", fx.with_views(
    f"""SELECT doc_id, Rating, {SENT_SQL.format(r='Rating')} AS Sentiment FROM reviews
        WHERE {SENT_SQL.format(r='Rating')} IS DISTINCT FROM 'neu'""", "reviews"))
def q_drop_neutral(spark, sf):
    r = fx.reviews(spark, sf).select("doc_id", "Rating", sentiment("Rating").alias("Sentiment"))
    return drop_neutral(r)


@register("label_encode", fx.with_views(
    f"""SELECT doc_id, CASE s WHEN 'pos' THEN 1 WHEN 'neg' THEN 0 END AS label
        FROM (SELECT doc_id, {SENT_SQL.format(r='Rating')} AS s FROM reviews)""", "reviews"))
def q_label_encode(spark, sf):
    return fx.reviews(spark, sf).select("doc_id", label_encode(sentiment("Rating")).alias("label"))


@register("length_gate", "SELECT doc_id, length(text)::BIGINT AS n, length(text) <= 5000 AS fits FROM documents")
def q_length_gate(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return length_gate(d, "text").select("doc_id", F.length("text").cast("long").alias("n"), "fits")


@register("project_variant", fx.with_views(
    f"""SELECT doc_id AS ID, {clean_text_sql('Review')} AS text, {SENT_SQL.format(r='Rating')} AS Sentiment
        FROM reviews""", "reviews"))
def q_project_variant(spark, sf):
    r = fx.reviews(spark, sf).select(F.col("doc_id").alias("ID"), "Review",
                                     sentiment("Rating").alias("Sentiment"))
    return project_variant(r.withColumn("Review_cleaned", clean_text("Review")), "Review_cleaned")
