"""Views derived from the driver tables, in two forms with the same
arithmetic: a Spark DataFrame builder and a DuckDB SQL definition (used by
the oracle queries). They give the study's inputs (reviews, labelled texts,
logits, predictions, pages, name lookups, trial losses) a realistic shape
while staying deterministic functions of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import argmax
from .tables import read_table

# Danish month abbreviations and full names, January to December.
MONTH_ABBR = ["jan", "feb", "mar", "apr", "maj", "jun", "jul", "aug", "sep", "okt", "nov", "dec"]
MONTH_FULL = ["januar", "februar", "marts", "april", "maj", "juni", "juli", "august",
              "september", "oktober", "november", "december"]
# The four model conditions, in report order.
MODELS = ["pretrained", "original", "neutral", "mix"]
GENDERS = ["female", "male"]


def _arr(vals):
    return F.array(*[F.lit(v) for v in vals])


def _sql_list(vals):
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


# --------------------------------------------------------------------- reviews
def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    day = (F.lit(1) + did % 28).cast("string")
    year = (F.lit(2000) + did % 24).cast("string")
    abbr = F.element_at(_arr(MONTH_ABBR), (did % 12 + 1).cast("int"))
    full = F.element_at(_arr(MONTH_FULL), (did % 12 + 1).cast("int"))
    v = F.floor(did / 12) % 4
    date = (F.when(v == 0, F.concat(day, F.lit(". "), abbr, F.lit(" "), year))
            .when(v == 1, F.concat(day, F.lit(". "), abbr, F.lit(" "), year, F.lit(" | 10:00")))
            .when(v == 2, F.concat(day, F.lit(". "), abbr, year))
            .otherwise(F.concat(day, F.lit(". "), full, F.lit(" "), year)))
    return d.select(
        F.concat(F.lit("doc "), did.cast("string")).alias("Title"),
        F.concat(F.lit("https://film.example/anmeldelse/"), did.cast("string")).alias("URL"),
        F.when(did % 5 == 0, F.lit("Af Anders Fogh"))
         .otherwise(F.concat(F.lit("Af "), F.col("source"))).alias("Author"),
        date.alias("Date"),
        F.when(did % 97 == 0, F.lit(None))
         .otherwise((did * 7 + F.col("n_chars")) % 7).cast("int").alias("Rating"),
        F.col("text").alias("Review"),
        did.alias("doc_id"),
    )


REVIEWS_SQL = f"""reviews AS (
  SELECT 'doc ' || doc_id AS Title,
         'https://film.example/anmeldelse/' || doc_id AS URL,
         CASE WHEN doc_id % 5 = 0 THEN 'Af Anders Fogh' ELSE 'Af ' || source END AS Author,
         CASE (doc_id // 12) % 4
           WHEN 0 THEN (1 + doc_id % 28) || '. ' || {_sql_list(MONTH_ABBR)}[doc_id % 12 + 1] || ' ' || (2000 + doc_id % 24)
           WHEN 1 THEN (1 + doc_id % 28) || '. ' || {_sql_list(MONTH_ABBR)}[doc_id % 12 + 1] || ' ' || (2000 + doc_id % 24) || ' | 10:00'
           WHEN 2 THEN (1 + doc_id % 28) || '. ' || {_sql_list(MONTH_ABBR)}[doc_id % 12 + 1] || (2000 + doc_id % 24)
           ELSE (1 + doc_id % 28) || '. ' || {_sql_list(MONTH_FULL)}[doc_id % 12 + 1] || ' ' || (2000 + doc_id % 24)
         END AS Date,
         CASE WHEN doc_id % 97 = 0 THEN NULL ELSE ((doc_id * 7 + n_chars) % 7)::INTEGER END AS Rating,
         text AS Review,
         doc_id
  FROM documents)"""


# -------------------------------------------------------------- sentiment_docs
def sentiment_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("ID"), "text",
        F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("Sentiment"))


SENTIMENT_DOCS_SQL = """sentiment_docs AS (
  SELECT d.doc_id AS ID, d.text, CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS Sentiment
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# ------------------------------------------------------------ logits / preds
def logit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ID, Model, Gender, logits array<double>, label). Model k reads its
    female logits from elements 4k..4k+1 and male logits from 4k+2..4k+3."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    combos = F.array(*[
        F.struct(F.lit(m).alias("Model"), F.lit(g).alias("Gender"),
                 F.array(F.col("embedding")[4 * k + 2 * j].cast("double"),
                         F.col("embedding")[4 * k + 2 * j + 1].cast("double")).alias("logits"))
        for k, m in enumerate(MODELS) for j, g in enumerate(GENDERS)])
    return (e.select(F.col("vec_id").alias("ID"), (F.col("label") % 2).cast("int").alias("label"),
                     F.explode(combos).alias("c"))
            .select("ID", "c.Model", "c.Gender", "c.logits", "label"))


def _logit_rows_sql():
    parts = []
    for k, m in enumerate(MODELS):
        for j, g in enumerate(GENDERS):
            a, b = 4 * k + 2 * j + 1, 4 * k + 2 * j + 2
            parts.append(f"SELECT vec_id AS ID, '{m}' AS Model, '{g}' AS Gender, "
                         f"[embedding[{a}]::DOUBLE, embedding[{b}]::DOUBLE] AS logits, "
                         f"(label % 2)::INTEGER AS label FROM embeddings")
    return "\n  UNION ALL ".join(parts)


LOGIT_PAIRS_SQL = f"""logit_pairs AS (
  {_logit_rows_sql()})"""


def pred_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ID, Model, Gender, pred, label, batch, epoch): argmax of each pair."""
    return logit_pairs(spark, sf_dir).select(
        "ID", "Model", "Gender", argmax("logits").alias("pred"), "label",
        F.floor(F.col("ID") / 16).alias("batch"), (F.col("ID") % 5).alias("epoch"))


PRED_PAIRS_SQL = LOGIT_PAIRS_SQL + """,
pred_pairs AS (
  SELECT ID, Model, Gender, (list_position(logits, list_max(logits)) - 1)::INTEGER AS pred, label,
         ID // 16 AS batch, ID % 5 AS epoch
  FROM logit_pairs)"""


# ------------------------------------------------------------------ name lookup
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, gender, probability, ord): names drawn from the texts by hash, so
    that documents do contain them: single words, two-word names, names
    inside other names (the first four letters of a word), and pairs where
    deleting one inside a word leaves the other."""
    from ..functions.text import clean_text
    d = read_table(spark, sf_dir, "documents").select(clean_text("text").alias("t"))

    def drawn(pattern, share, single):
        found = F.array_distinct(F.regexp_extract_all(F.col("t"), F.lit(pattern), 0))
        return F.transform(F.filter(found, lambda w: F.md5(w) < share),
                           lambda w: F.struct(w.alias("w"), F.lit(single).alias("single")))

    # one scan; the other forms come from the distinct words
    words = d.select(F.explode(F.concat(drawn(r"[\p{L}]{5,}", "01", True), drawn(r"[\p{L}]{3,} [\p{L}]{3,}", "004", False))).alias("x"))
    words = words.select("x.*").distinct().withColumn("k", F.substring(F.md5("w"), 5, 1))
    long = F.col("single") & F.col("k").between("4", "7") & (F.length("w") >= 9)
    forms = F.array(F.col("w"), F.when(F.col("single") & (F.col("k") < "4"), F.substring("w", 1, 4)),
                    F.when(long, F.substring("w", 3, 5)), F.when(long, F.expr("concat(substring(w, 1, 2), substring(w, 8))")))
    names = words.select(F.explode(forms).alias("w")).where("w is not null").distinct()
    h = F.md5("w")
    return names.select(
        F.concat(F.lit(" "), F.col("w"), F.lit(". ")).alias("name"),
        F.when(F.substring(h, 3, 1) < "7", "male").when(F.substring(h, 3, 1) < "e", "female").alias("gender"),
        (F.lit(0.6) + F.conv(F.substring(h, 4, 1), 16, 10).cast("double") / 40.0).alias("probability"),
        F.conv(F.substring(h, 5, 12), 16, 10).cast("long").alias("ord"))


NAME_LOOKUP_SQL = r"""name_texts AS (
  SELECT regexp_replace(lower(text), '[^\p{L}\p{N}_\t-\r\x1c-\x1f\x{85}\p{Z}]', '', 'g') AS t FROM documents),
name_words AS (
  SELECT DISTINCT w, substr(md5(w), 5, 1) AS k
  FROM (SELECT unnest(list_distinct(regexp_extract_all(t, '[\p{L}]{5,}'))) AS w FROM name_texts) WHERE md5(w) < '01'),
name_forms AS (
  SELECT w FROM name_words
  UNION SELECT w FROM (SELECT unnest(list_distinct(regexp_extract_all(t, '[\p{L}]{3,} [\p{L}]{3,}'))) AS w FROM name_texts)
        WHERE md5(w) < '004'
  UNION SELECT substr(w, 1, 4) FROM name_words WHERE k < '4'
  UNION SELECT substr(w, 3, 5) FROM name_words WHERE k BETWEEN '4' AND '7' AND length(w) >= 9
  UNION SELECT substr(w, 1, 2) || substr(w, 8) FROM name_words WHERE k BETWEEN '4' AND '7' AND length(w) >= 9),
name_lookup AS (
  SELECT ' ' || w || '. ' AS name,
         CASE WHEN substr(md5(w), 3, 1) < '7' THEN 'male' WHEN substr(md5(w), 3, 1) < 'e' THEN 'female' END AS gender,
         0.6::DOUBLE + ('0x' || substr(md5(w), 4, 1))::BIGINT / 40.0::DOUBLE AS probability,
         ('0x' || substr(md5(w), 5, 12))::BIGINT AS ord
  FROM name_forms)"""


# ------------------------------------------------------------------ paraphrase
def paraphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.filter(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("ID"),
        F.array_join(F.reverse(F.split(F.col("text"), " ")), " ").alias("paraphrase"))


PARAPHRASE_SQL = """paraphrase AS (
  SELECT doc_id AS ID, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS paraphrase
  FROM documents WHERE doc_id % 3 = 0)"""


# ---------------------------------------------------------------------- trials
def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, epoch, val_loss): one validation loss per trial and epoch."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return (e.groupBy(F.col("label").alias("trial"), (F.col("vec_id") % 15).alias("epoch"))
            .agg(F.min(F.abs(F.col("embedding")[0]).cast("double")).alias("val_loss")))


TRIALS_SQL = """trials AS (
  SELECT label AS trial, vec_id % 15 AS epoch, min(abs(embedding[1])::DOUBLE) AS val_loss
  FROM embeddings GROUP BY 1, 2)"""


# ---------------------------------------------------------------- page_reviews
def page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with review blocks: the article wrapped in a text div, then
    author, published and rating blocks appended; page_id % 5 = 1, 2, 3, 4
    lack the author, published, rating and text block respectively."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pid = F.col("page_id")
    stars = (pid % 7).cast("int")
    html = F.when(pid % 5 == 4, F.col("html")).otherwise(
        F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit('<article><div class="text">')),
                  F.lit("</article>"), F.lit("</div></article>")))
    author = F.when(pid % 5 != 1, F.concat(F.lit('<div class="author">Af Anmelder '),
                                           (pid % 13).cast("string"), F.lit("</div>")))
    published = F.when(pid % 5 != 2, F.concat(
        F.lit('<div class="published">'), (F.lit(1) + pid % 28).cast("string"), F.lit(". "),
        F.element_at(_arr(MONTH_ABBR), (pid % 12 + 1).cast("int")), F.lit(" "),
        (F.lit(2000) + pid % 24).cast("string"), F.lit("</div>")))
    rating = F.when(pid % 5 != 3, F.concat(
        F.lit('<div class="rating">'),
        F.repeat(F.lit('<img src="/img/star-black.png" alt="*">'), stars),
        F.repeat(F.lit('<img src="/img/star-white.png" alt="">'), F.lit(6) - stars),
        F.lit("</div>")))
    return p.select("page_id", "url",
                    F.concat_ws("", html, author, published, rating).alias("html"))


PAGE_REVIEWS_SQL = f"""page_reviews AS (
  SELECT page_id, url,
    concat_ws('',
      CASE WHEN page_id % 5 = 4 THEN html
           ELSE replace(replace(html, '<article>', '<article><div class="text">'), '</article>', '</div></article>') END,
      CASE WHEN page_id % 5 <> 1 THEN '<div class="author">Af Anmelder ' || (page_id % 13) || '</div>' END,
      CASE WHEN page_id % 5 <> 2 THEN '<div class="published">' || (1 + page_id % 28) || '. '
           || {_sql_list(MONTH_ABBR)}[page_id % 12 + 1] || ' ' || (2000 + page_id % 24) || '</div>' END,
      CASE WHEN page_id % 5 <> 3 THEN '<div class="rating">'
           || repeat('<img src="/img/star-black.png" alt="*">', (page_id % 7)::INTEGER)
           || repeat('<img src="/img/star-white.png" alt="">', (6 - page_id % 7)::INTEGER) || '</div>' END
    ) AS html
  FROM pages)"""


# ----------------------------------------------------------------- page_nested
# Pieces of html around the article of a nested page.
NEST_OPEN = ("<div id=main class='text'><div class=box><p>f&oslash;r &#230;ble&amp;p&aelig;re</p><div><p>to <b>lag</b> inde</p></div></div>"
             "<p>&Aring;</p>").replace("&Aring;", "&AElig;n &#xF8;")
NEST_CLOSE = "<div><div><p>slut</div></div></div><!-- text -->"


def page_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text block holds further blocks before, around and after
    the article; fields with unquoted and single-quoted classes."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    pid = F.col("page_id")
    html = F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit(NEST_OPEN + "<div>")),
                     F.lit("</article>"), F.lit("</div>" + NEST_CLOSE))
    author = F.concat(F.lit("<div class='author x'>S&oslash;ren "), (pid % 13).cast("string"), F.lit("</div>"))
    published = F.concat(F.lit("<div class=published>"), (F.lit(1) + pid % 28).cast("string"), F.lit(". maj</div>"))
    rating = F.concat(F.lit("<div class='rating'><span>"),
                      F.repeat(F.lit("<img src=/img/star-black.png>"), (pid % 7).cast("int")), F.lit("</span></div>"))
    return p.select("page_id", "url", F.concat(html, author, published, rating).alias("html"))


PAGE_NESTED_SQL = f"""page_nested AS (
  SELECT page_id, url, replace(replace(html, '<article>', '{NEST_OPEN.replace("'", "''")}<div>'),
                               '</article>', '</div>{NEST_CLOSE}')
    || '<div class=''author x''>S&oslash;ren ' || (page_id % 13) || '</div>'
    || '<div class=published>' || (1 + page_id % 28) || '. maj</div>'
    || '<div class=''rating''><span>' || repeat('<img src=/img/star-black.png>', (page_id % 7)::INTEGER) || '</span></div>' AS html
  FROM pages)"""


VIEWS_SQL = {
    "reviews": REVIEWS_SQL, "sentiment_docs": SENTIMENT_DOCS_SQL, "logit_pairs": LOGIT_PAIRS_SQL,
    "pred_pairs": PRED_PAIRS_SQL, "name_lookup": NAME_LOOKUP_SQL, "paraphrase": PARAPHRASE_SQL,
    "trials": TRIALS_SQL, "page_reviews": PAGE_REVIEWS_SQL, "page_nested": PAGE_NESTED_SQL,
}


def with_views(sql: str, *views: str, extra: list[str] | None = None) -> str:
    """Prefix ``sql`` with the CTE definitions of ``views`` (and extra CTEs)."""
    ctes = [VIEWS_SQL[v] for v in views] + list(extra or [])
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
