"""Vocabulary, name and analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import analytics as P
from ..operators import bias as B
from ..operators.vocab import classify_names, corpus_vocabulary, filter_by_class, list_sizes
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .clean_queries import clean_text_sql
from .metric_queries import BIAS_SUMMARY_SQL
from .registry import register
from .term_queries import W_SQL, cleaned_docs

VOCAB_SQL = f"""cdocs AS (SELECT doc_id, {clean_text_sql('text')} AS text FROM documents),
vocab AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{W_SQL}+')) AS word FROM cdocs),
bench_words AS (SELECT DISTINCT unnest(regexp_extract_all({clean_text_sql('text')}, '{W_SQL}+')) AS word
                FROM benchmark)"""


@register("vocabulary", f"WITH {VOCAB_SQL}\nSELECT word FROM vocab")
def q_vocabulary(spark, sf):
    return corpus_vocabulary(cleaned_docs(spark, sf), "text")


def bench_words(spark, sf):
    b = read_table(spark, sf, "benchmark").select(clean_text("text").alias("t"))
    return corpus_vocabulary(b, "t")


@register("vocabulary_filtered", f"WITH {VOCAB_SQL}\nSELECT word FROM vocab WHERE word IN (SELECT word FROM bench_words)")
def q_vocabulary_filtered(spark, sf):
    return filter_by_class(corpus_vocabulary(cleaned_docs(spark, sf), "text"), bench_words(spark, sf))


CLASS_SQL = """CASE WHEN probability IS NULL THEN 'unknown'
     WHEN probability >= 0.75 THEN CASE gender WHEN 'male' THEN 'male' WHEN 'female' THEN 'female' END
     ELSE 'unknown' END"""


@register("name_gender", fx.with_views(
    f"SELECT name, class FROM (SELECT name, {CLASS_SQL} AS class FROM name_lookup) WHERE class IS NOT NULL",
    "name_lookup"))
def q_name_gender(spark, sf):
    return classify_names(fx.name_lookup(spark, sf)).select("name", "class")


@register("list_sizes", f"""WITH {VOCAB_SQL}, {fx.NAME_LOOKUP_SQL},
cls AS (SELECT name, {CLASS_SQL} AS class FROM name_lookup)
SELECT 'vocabulary' AS list, count(DISTINCT word)::BIGINT AS n FROM vocab
UNION ALL SELECT class, count(DISTINCT name)::BIGINT FROM cls WHERE class IS NOT NULL GROUP BY class""")
def q_list_sizes(spark, sf):
    return list_sizes(corpus_vocabulary(cleaned_docs(spark, sf), "text"),
                      classify_names(fx.name_lookup(spark, sf)))


RATING_SUMMARY_SQL = fx.with_views("""
SELECT count(Rating)::BIGINT AS n, round(avg(Rating::DOUBLE), 9) AS mean, round(median(Rating::DOUBLE), 9) AS median,
       round(stddev_samp(Rating::DOUBLE), 9) AS std,
       round(avg(Rating::DOUBLE) - stddev_samp(Rating::DOUBLE), 9) AS mean_minus_sd,
       round(avg(Rating::DOUBLE) + stddev_samp(Rating::DOUBLE), 9) AS mean_plus_sd
FROM reviews""", "reviews")


@register("rating_summary", RATING_SUMMARY_SQL)
def q_rating_summary(spark, sf):
    return P.rating_summary(fx.reviews(spark, sf))


@register("rating_kde", fx.with_views("""
, hist AS (SELECT Rating::DOUBLE AS r, count(*)::DOUBLE AS c FROM reviews WHERE Rating IS NOT NULL GROUP BY 1),
h1 AS (SELECT r, c, sum(c) OVER () AS n, sum(c * r) OVER () / sum(c) OVER () AS mean FROM hist),
h2 AS (SELECT r, c, n, sqrt(sum(c * (r - mean) ^ 2) OVER () / (n - 1)) AS std FROM h1),
h3 AS (SELECT r, c, n, std * pow(n, -0.2) AS bw FROM h2),
grid AS (SELECT (0.0 + i * 0.25)::DOUBLE AS x FROM range(0, 29) t(i))
SELECT round(x, 2) AS x, round(sum(c * exp(-0.5 * ((x - r) / bw) ^ 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 9)
       AS density
FROM h3 JOIN grid ON TRUE GROUP BY x""", "reviews").replace(")\n\n, hist AS", "),\nhist AS"))
def q_rating_kde(spark, sf):
    return P.rating_kde(fx.reviews(spark, sf))


@register("bias_unpivot", f"""WITH bs AS ({BIAS_SUMMARY_SQL})
SELECT Model, 'Total_Bias' AS Bias_Type, Total_Bias AS Bias_Value FROM bs
UNION ALL SELECT Model, 'Abs_Bias', Abs_Bias FROM bs""")
def q_bias_unpivot(spark, sf):
    return P.unpivot_bias(B.bias_summary(B.sample_bias(fx.pred_pairs(spark, sf), ["Model"]), ["Model"]))


@register("model_order", f"""WITH bs AS ({BIAS_SUMMARY_SQL})
SELECT Model, coalesce(list_position({fx._sql_list(fx.MODELS)}, Model), 0)::INTEGER AS model_rank, Total_Bias
FROM bs""")
def q_model_order(spark, sf):
    s = B.bias_summary(B.sample_bias(fx.pred_pairs(spark, sf), ["Model"]), ["Model"])
    return P.model_order(s, fx.MODELS).select("Model", "model_rank", "Total_Bias")


@register("rounded_labels", f"""WITH s AS ({RATING_SUMMARY_SQL})
SELECT round(mean, 2) AS mean_label, round(mean_minus_sd, 2) AS mean_minus_sd_label,
       round(mean_plus_sd, 2) AS mean_plus_sd_label FROM s""")
def q_rounded_labels(spark, sf):
    return P.rounded_labels(P.rating_summary(fx.reviews(spark, sf)), ["mean", "mean_minus_sd", "mean_plus_sd"])
