"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import csv as C
from ..sources import csv_scan as CS
from ..sources import fixtures as fx
from ..sources.html import scrape_pages
from ..sources.tables import read_table
from .clean_queries import CLEAN_REVIEWS_SQL, q_clean_reviews
from ..operators import analytics as P
from ..operators import bias as B
from ..operators.joins import known_bytes
from .metric_queries import BIAS_SUMMARY_SQL, BINARY_SQL, TRAINING_STATS_SQL, binary_metrics_df, q_training_stats
from .registry import register

SP_SQL = r"[\s\p{Z}\x0B\x1c-\x1f\x{85}]"


# The oracle states the rules of S6 on its own: the fixture's blocks are cut
# out by what the fixture wrote around them, and references are decoded by a
# list of those that occur.
ENTITY_SQL = [("&lt;", "<"), ("&gt;", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;?", chr(160)),
              ("&copy;?", "©"), ("&middot;?", "·"), ("&aelig;", "æ"), ("&oslash;", "ø"), ("&aring;", "å"), ("&#230;", "æ"),
              ("&#xF8;", "ø"), ("&AElig;", "Æ"), ("&amp;?", "&")]


def _decode_sql(s: str) -> str:
    for k, v in ENTITY_SQL:
        s = f"regexp_replace({s}, '{k}', '{v}', 'g')"
    return s


def get_text_sql(frag: str) -> str:
    nodes = (f"list_transform(regexp_split_to_array({frag}, '<[^>]*>'), lambda s: "
             f"regexp_replace({_decode_sql('s')}, '^{SP_SQL}+|{SP_SQL}+$', '', 'g'))")
    return f"array_to_string(list_filter({nodes}, lambda s: s <> ''), '')"


def block_sql(h: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({h}, '{pattern}') THEN regexp_extract({h}, '{pattern}', 1) END"


def paragraphs_sql(frag: str) -> str:
    pieces = f"regexp_split_to_array({frag}, '<[pP](?:{SP_SQL}[^>]*)?>')"
    return (f"array_to_string(list_transform(list_slice({pieces}, 2, len({pieces})), lambda p: "
            + get_text_sql("regexp_replace(p, '(?is)</p>.*', '')") + "), ' ')")


def html_sql(view: str, inner: str) -> str:
    """``inner``: what the text block holds, as SQL over ``h``."""
    return fx.with_views(f"""
SELECT page_id, {get_text_sql('title_b')} AS Title, url AS URL, {get_text_sql('author_b')} AS Author,
       {get_text_sql('date_b')} AS Date,
       CASE WHEN rating_b IS NOT NULL THEN len(regexp_extract_all(rating_b, 'star-black'))::INTEGER END AS Rating,
       {paragraphs_sql('text_b')} AS Review
FROM b""", view, extra=[
        f"h AS (SELECT page_id, url, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS h FROM {view})",
        f"""b AS (SELECT page_id, url, {block_sql('h', '(?is)<h1[^>]*>(.*?)</h1>')} AS title_b,
             {block_sql('h', '(?is)<div[^>]*published[^>]*>(.*?)</div>')} AS date_b,
             {block_sql('h', '(?is)<div[^>]*author[^>]*>(.*?)</div>')} AS author_b,
             {block_sql('h', '(?is)<div[^>]*rating[^>]*>(.*?)</div>')} AS rating_b,
             {inner} AS text_b FROM h)"""])


@register("html_fields", html_sql("page_reviews", block_sql("h", r'(?is)<div class="text">(.*)</div></article>')))
def q_html_fields(spark, sf):
    return scrape_pages(fx.page_reviews(spark, sf))


@register("html_nested", html_sql("page_nested", block_sql("h", r"(?is)<div id=main class=.text.>(.*)</div><!-- text -->")))
def q_html_nested(spark, sf):
    """Text blocks with blocks inside them, character references, and
    attributes in single quotes or none."""
    return scrape_pages(fx.page_nested(spark, sf))


CLEAN_SCHEMA = ("ID long, doc_id long, Title string, URL string, Author string, Date string, Rating int, "
                "Sentiment string, Review_cleaned string")


@register("csv_roundtrip", CLEAN_REVIEWS_SQL)
def q_csv_roundtrip(spark, sf):
    path = C.scratch_path(spark, "clean")
    C.write_csv(q_clean_reviews(spark, sf), path)
    return C.read_csv(spark, path, CLEAN_SCHEMA)


@register("csv_headerless", fx.with_views("SELECT Title, URL FROM reviews", "reviews"))
def q_csv_headerless(spark, sf):
    path = C.scratch_path(spark, "urls")
    C.write_csv(fx.reviews(spark, sf).select("Title", "URL"), path, header=False)
    return C.read_csv(spark, path, "Title string, URL string", header=False).select("Title", "URL")


METRICS_SCHEMA = ("Model_type string, Gender string, Model string, Accuracy double, Precision double, "
                  "Recall double, `F1 Score` double")


@register("csv_append", f"WITH m AS ({BINARY_SQL})\nSELECT * FROM m UNION ALL SELECT * FROM m")
def q_csv_append(spark, sf):
    path = C.scratch_path(spark, "metrics")
    m = binary_metrics_df(spark, sf)
    C.write_csv(m, path, mode="append")
    C.write_csv(m, path, mode="append")
    return C.read_csv(spark, path, METRICS_SCHEMA)


#: Bytes of the input table for each file of the split scan: about two byte ranges of CSV.
FILE_BYTES = 128 << 20


def file_count(n_bytes):
    return max(1, -(-n_bytes // FILE_BYTES))


@register("csv_split_scan", CLEAN_REVIEWS_SQL)
def q_csv_split_scan(spark, sf):
    """CSV files of the cleaned reviews, line ends and quotes in the texts, each
    read by as many tasks as it has byte ranges. The number of files follows the
    table's bytes, so that no task that writes one grows with the table."""
    path = C.scratch_path(spark, "split")
    n = file_count(known_bytes(read_table(spark, sf, "documents")))
    C.write_csv(q_clean_reviews(spark, sf).coalesce(n), path)
    rows, _ = CS.scan(spark, path, CLEAN_SCHEMA)
    return rows.drop("file", "start", "place")


REJECT_SQL = """d AS (SELECT doc_id, coalesce(source, '') AS source, n_chars, doc_id % 7 AS kind FROM documents)"""


@register("csv_rejects", f"""WITH {REJECT_SQL}
SELECT doc_id, source, n_chars, NULL::VARCHAR AS reason, NULL::VARCHAR AS record FROM d WHERE kind NOT IN (3, 5)
UNION ALL SELECT NULL, NULL, NULL, 'fields', doc_id || ',' || source FROM d WHERE kind = 3
UNION ALL SELECT NULL, NULL, NULL, 'n_chars', doc_id || ',' || source || ',' || 'many' FROM d WHERE kind = 5""")
def q_csv_rejects(spark, sf):
    """Two files of the same table, one with its columns in another order; by
    the id some lines lack a field and some hold a word for a number. Every
    line is either a typed row or a rejected record with its reason."""
    d = read_table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars", (F.col("doc_id") % 7).alias("kind"))
    broken = F.concat_ws(",", "doc_id", "source", F.when(F.col("kind") == 5, "many").when(F.col("kind") != 3, F.col("n_chars").cast("string")))
    turned = F.concat_ws(",", "n_chars", "doc_id", "source")
    root = C.scratch_path(spark, "rejects")
    even = F.col("kind") % 2 == 0
    for name, rows, line, head in (("plain", d.where(~even), broken, "doc_id,source,n_chars"), ("turned", d.where(even), turned, "n_chars,doc_id,source")):
        x = rows.select(line.alias("line"), F.lit(1).alias("o"), "doc_id").unionByName(
            spark.range(1).select(F.lit(head).alias("line"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("doc_id")))
        C.write_lines_in_order(x, "line", ["o", "doc_id"], f"{root}/{name}")
    rows, rejects = CS.scan(spark, [f"{root}/plain", f"{root}/turned"], "doc_id long, source string, n_chars long")
    return rows.select("doc_id", "source", "n_chars").unionByName(rejects.select("reason", "record"), allowMissingColumns=True)


@register("csv_append_replayed", f"WITH m AS ({BINARY_SQL})\nSELECT * FROM m UNION ALL SELECT * FROM m")
def q_csv_append_replayed(spark, sf):
    """Two runs append; the first is replayed after it was committed, and an
    attempt at the second wrote its files without a commit."""
    path = C.scratch_path(spark, "runs")
    m = binary_metrics_df(spark, sf)
    CS.append_run(m, path, "a")
    CS.append_run(m, path, "a")
    C.write_csv(m, f"{path}/run=b/dead")
    CS.append_run(m, path, "b")
    return CS.read_runs(spark, path, METRICS_SCHEMA)


_MCOLS = ["Model_type", "Gender", "Model", "Accuracy", "Precision", "Recall", "F1 Score"]


@register("drop_embedded_headers", BINARY_SQL)
def q_drop_embedded_headers(spark, sf):
    """One CSV file where every appended batch (one per model) repeats the
    header line; read with the first line as header, then drop the rest."""
    m = binary_metrics_df(spark, sf)
    data = m.select("Model", F.lit(1).alias("is_data"), "Gender",
                    F.concat_ws(",", *[F.col(c).cast("string") for c in _MCOLS]).alias("line"))
    heads = m.select("Model").distinct().select("Model", F.lit(0).alias("is_data"), F.lit("").alias("Gender"),
                                                F.lit(",".join(_MCOLS)).alias("line"))
    path = C.scratch_path(spark, "embedded")
    C.write_lines_in_order(data.unionByName(heads), "line", ["Model", "is_data", "Gender"], path)
    raw = C.read_csv(spark, path, ", ".join(f"`{c}` string" for c in _MCOLS))
    kept = C.drop_embedded_headers(raw, "Model_type")
    return kept.select("Model_type", "Gender", "Model",
                       *[F.col(c).cast("double").alias(c) for c in _MCOLS[3:]])


@register("bias_csv_indexed", f"""WITH bs AS ({BIAS_SUMMARY_SQL})
SELECT (coalesce(list_position({fx._sql_list(fx.MODELS)}, Model), 0) - 1)::BIGINT AS "index", Model,
       Total_Bias, Abs_Bias, Effect_Size
FROM bs""")
def q_bias_csv_indexed(spark, sf):
    """S3 with an index: the bias table written with a leading row index in
    model order, read back with an explicit schema."""
    s = B.bias_summary(B.sample_bias(fx.pred_pairs(spark, sf), ["Model"]), ["Model"])
    indexed = C.with_index(P.model_order(s, fx.MODELS), "model_rank").drop("model_rank")
    path = C.scratch_path(spark, "bias")
    C.write_csv(indexed, path)
    return C.read_csv(spark, path, "`index` long, Model string, Total_Bias double, Abs_Bias double, "
                                   "Effect_Size double")


_STATS = [f"{side}_{c}" for side in ("train", "val") for c in ("loss", "accuracy", "f1", "recall", "precision")]


@register("training_stats_csv", f"""WITH ts AS ({TRAINING_STATS_SQL})
SELECT Model, epoch, {', '.join(_STATS)} FROM ts""")
def q_training_stats_csv(spark, sf):
    """S3: the training statistics written with the epoch as their leading
    index, read back with an explicit schema."""
    path = C.scratch_path(spark, "stats")
    C.write_csv(q_training_stats(spark, sf).select("epoch", "Model", *_STATS), path)
    return C.read_csv(spark, path, "epoch long, Model string, " + ", ".join(f"{c} double" for c in _STATS))
