"""Lexicon, term-count and rewrite queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import sentiment
from ..functions.text import clean_text
from ..operators.clean import drop_neutral
from ..operators.ranking import rank_by_numeric
from ..operators.names import term_counts
from ..operators.terms import add_masks, masked_table, render_counts
from ..operators.vocab import name_lists
from ..session import sized
from ..sources import fixtures as fx
from ..sources import lexicon as lx
from ..sources.tables import read_table
from .clean_queries import NW_SQL, SENT_SQL, clean_text_sql
from .registry import register

W_SQL = r"[\p{L}\p{N}_]"


# ----------------------------------------------------------------- Spark side
def cleaned_docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", clean_text("text").alias("text"))


def names(spark, sf):
    """The name lists, written once: a lexicon is read several times."""
    return sized(name_lists(fx.name_lookup(spark, sf)))


def lexicon(spark, sf, direction):
    lex = lx.lexicon_frame(spark, direction, names(spark, sf))
    return rank_by_numeric(lex, "pos", "rank").select("term", "repl", F.col("rank").alias("pos"))


def universe(spark, sf):
    nm = names(spark, sf)
    return lx.universe_frame(lx.lexicon_frame(spark, "f2m", nm), lx.lexicon_frame(spark, "m2f", nm))


# ------------------------------------------------------------------ SQL side
def _q(s: str) -> str:
    return s.replace("'", "''")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{_q(v)}'" if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in rows)


CDOCS_SQL = f"cdocs AS (SELECT doc_id, {clean_text_sql('text')} AS text FROM documents)"
NAMES_SQL = fx.NAME_LOOKUP_SQL + f""",
names AS (
  SELECT trim({clean_text_sql('name')}) AS name, cls AS gender, ord FROM (
    SELECT name, ord, CASE WHEN probability IS NULL THEN 'unknown'
                           WHEN probability >= 0.75 THEN CASE gender WHEN 'male' THEN 'male'
                                                                     WHEN 'female' THEN 'female' END
                           ELSE 'unknown' END AS cls
    FROM name_lookup) WHERE cls IN ('male', 'female'))"""


def lexicon_sql(direction: str) -> str:
    raw = [(k, v, i) for i, (k, v) in enumerate(lx.TERM_PAIRS + lx.PRONOUN_PAIRS)]
    if direction == "f2m":
        one, gender = lx.FEMALE_ONLY_TERMS, "female"
        fixed = "SELECT term, repl, pos FROM fwd"
    else:
        one, gender = lx.MALE_ONLY_TERMS, "male"
        fixed = ("SELECT repl AS term, max_by(term, pos) AS repl, min(pos) AS pos "
                 "FROM fwd GROUP BY repl")
    ones = [(t, lx._ONE_SIDED_BASE + i) for i, t in enumerate(one)]
    return f"""raw_{direction}(term, repl, pos) AS (VALUES {_values(raw)}),
fwd_{direction} AS (SELECT term, max_by(repl, pos) AS repl, min(pos) AS pos FROM raw_{direction} GROUP BY term),
ent_{direction} AS (
  {fixed.replace('fwd', f'fwd_{direction}')}
  UNION ALL SELECT t.term, '' AS repl, t.pos::BIGINT FROM (VALUES {_values(ones)}) t(term, pos)
  UNION ALL SELECT name, '', {lx._NAME_BASE} + ord FROM names WHERE gender = '{gender}'),
lex_{direction} AS (
  SELECT term, max_by(repl, pos) AS repl, min(pos) AS pos FROM ent_{direction}
  WHERE term IS NOT NULL AND term <> '' GROUP BY term)"""


def lex_ctes(*directions) -> str:
    return ",\n".join([NAMES_SQL] + [lexicon_sql(d) for d in directions])


UNIVERSE_CTE = "universe AS (SELECT term FROM lex_f2m UNION SELECT term FROM lex_m2f)"


# ------------------------------------------------------------------- queries
for _d in ("f2m", "m2f"):
    def _mk(d):
        @register(f"lexicon_{d}", f"WITH {lex_ctes(d)}\nSELECT term, repl, "
                  f"(row_number() OVER (ORDER BY pos) - 1)::BIGINT AS pos FROM lex_{d}")
        def q(spark, sf):
            return lexicon(spark, sf, d)
        return q
    _mk(_d)


@register("term_universe", f"WITH {lex_ctes('f2m', 'm2f')}, {UNIVERSE_CTE}\nSELECT term FROM universe")
def q_term_universe(spark, sf):
    return universe(spark, sf)


# A match is a term with the rest of its word, so a term without a space is
# matched once by every word that contains it; only terms of several words
# need a pattern.
COUNTS_CTE = f"""cwords AS (SELECT doc_id, text, regexp_extract_all(text, '{W_SQL}+') AS ws FROM cdocs),
present AS (SELECT doc_id, text, ws, term FROM cwords, universe WHERE contains(text, term)),
counts AS (SELECT doc_id, term, CASE WHEN contains(term, ' ') OR contains(term, '-')
                  THEN len(regexp_extract_all(text, term || '{W_SQL}*'))
                  ELSE len(list_filter(ws, lambda w: contains(w, term))) END::BIGINT AS n FROM present)"""
TERM_COUNTS_SQL = f"""WITH {lex_ctes('f2m', 'm2f')}, {UNIVERSE_CTE}, {CDOCS_SQL},
{COUNTS_CTE}
"""


@register("term_counts", TERM_COUNTS_SQL + "SELECT doc_id, term, n FROM counts WHERE n > 0")
def q_term_counts(spark, sf):
    return term_counts(cleaned_docs(spark, sf), "doc_id", "text", universe(spark, sf))


@register("term_total", TERM_COUNTS_SQL + """SELECT d.doc_id, coalesce(sum(c.n), 0)::BIGINT AS count_total
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id GROUP BY d.doc_id""")
def q_term_total(spark, sf):
    docs = cleaned_docs(spark, sf)
    c = term_counts(docs, "doc_id", "text", universe(spark, sf))
    return (docs.select("doc_id").join(c, "doc_id", "left").groupBy("doc_id")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count_total")))


_PRON_LIST = ", ".join(f"'{p}'" for p in lx.PRONOUNS)


@register("pronoun_total", TERM_COUNTS_SQL + f"""SELECT d.doc_id,
  coalesce(sum(c.n) FILTER (WHERE c.term IN ({_PRON_LIST})), 0)::BIGINT AS count_prons
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id GROUP BY d.doc_id""")
def q_pronoun_total(spark, sf):
    docs = cleaned_docs(spark, sf)
    pronouns = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in lx.PRONOUNS])).alias("term"))
    c = term_counts(docs, "doc_id", "text", pronouns)
    return (docs.select("doc_id").join(c, "doc_id", "left").groupBy("doc_id")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count_prons")))


def fold_sql(text: str, pairs) -> str:
    """Chained whole-text replacements (the fixed terms are letters and
    hyphens, which are literal in a pattern)."""
    expr = text
    for t, r in pairs:
        expr = f"regexp_replace({expr}, '({_q(t)})({W_SQL}*)', '{_q(r)}\\2', 'g')"
    return expr


def neutral_sql(text: str, terms) -> str:
    """One leftmost alternation, longest term first."""
    ordered = "|".join(sorted({_q(t) for t in terms}, key=lambda t: (-len(t), t)))
    return f"regexp_replace({text}, '(?:{ordered}){W_SQL}*', '', 'g')"


F2M, M2F, UNIVERSE = lx.f2m_pairs(), lx.m2f_pairs(), lx.term_universe()


@register("mask_male", f"WITH {CDOCS_SQL}\nSELECT doc_id, {fold_sql('text', F2M)} AS text_all_male FROM cdocs")
def q_mask_male(spark, sf):
    return add_masks(cleaned_docs(spark, sf), "text", {"text_all_male": F2M}, UNIVERSE).select(
        "doc_id", "text_all_male")


@register("mask_female", f"WITH {CDOCS_SQL}\nSELECT doc_id, {fold_sql('text', M2F)} AS text_all_female FROM cdocs")
def q_mask_female(spark, sf):
    return add_masks(cleaned_docs(spark, sf), "text", {"text_all_female": M2F}, UNIVERSE).select(
        "doc_id", "text_all_female")


@register("mask_neutral", f"WITH {CDOCS_SQL}\nSELECT doc_id, {neutral_sql('text', UNIVERSE)} AS text_all_neutral FROM cdocs")
def q_mask_neutral(spark, sf):
    return add_masks(cleaned_docs(spark, sf), "text", {"text_all_neutral": "neutral"}, UNIVERSE).select(
        "doc_id", "text_all_neutral")


def masked_cte() -> str:
    """CTEs ``reviews, base, c, masked`` (masked = T14 columns per review)."""
    terms = sorted(UNIVERSE)
    ns = ", ".join(f"CASE WHEN contains(t, '{_q(x)}') THEN len(regexp_extract_all(t, "
                   f"'{_q(x)}{W_SQL}*')) ELSE 0 END" for x in terms)
    entries = ", ".join(f"CASE WHEN ns[{i + 1}] > 0 THEN '{_q(x)}=' || ns[{i + 1}] END"
                        for i, x in enumerate(terms))
    prons = " + ".join(f"ns[{terms.index(p) + 1}]" for p in lx.PRONOUNS)
    return fx.REVIEWS_SQL + f""",
base AS (
  SELECT doc_id, {clean_text_sql('Review')} AS t, {SENT_SQL.format(r='Rating')} AS Sentiment FROM reviews
  WHERE {SENT_SQL.format(r='Rating')} IS DISTINCT FROM 'neu'),
c AS (SELECT doc_id, t, Sentiment, [{ns}] AS ns FROM base),
masked AS (
  SELECT doc_id AS ID, t AS Review_cleaned, Sentiment, concat_ws(',', {entries}) AS count_table,
         list_sum(ns)::INTEGER AS count_total, ({prons})::INTEGER AS count_prons,
         {fold_sql('t', F2M)} AS text_all_male,
         {fold_sql('t', M2F)} AS text_all_female,
         {neutral_sql('t', UNIVERSE)} AS text_all_neutral
  FROM c)"""


def _masked_sql() -> str:
    return ("WITH " + masked_cte() + "\nSELECT ID, count_table, count_total, count_prons, text_all_male, "
            "text_all_female, text_all_neutral FROM masked")


def review_base(spark, sf):
    """Labelled reviews after C8 with cleaned text: (ID, Review_cleaned, Sentiment)."""
    r = fx.reviews(spark, sf).select("doc_id", "Review", sentiment("Rating").alias("Sentiment"))
    return drop_neutral(r).select(F.col("doc_id").alias("ID"), clean_text("Review").alias("Review_cleaned"),
                                  "Sentiment")


def mask_reviews(base):
    return masked_table(base, "Review_cleaned", F2M, M2F, UNIVERSE, lx.PRONOUNS)


def masked_reviews(spark, sf):
    return mask_reviews(review_base(spark, sf))


@register("masked_table", _masked_sql())
def q_masked_table(spark, sf):
    m = masked_reviews(spark, sf)
    return m.select("ID", render_counts("count_table").alias("count_table"), "count_total",
                    "count_prons", "text_all_male", "text_all_female", "text_all_neutral")
