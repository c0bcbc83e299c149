"""Split, condition-set, augmentation, shuffle, batch and encode queries
(Q1-Q11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import label_encode, sentiment
from ..functions.text import clean_text, ws_words
from ..operators import augment as A
from ..operators import splits as S
from ..operators.clean import drop_neutral
from ..session import sized
from ..sources import fixtures as fx
from .clean_queries import SENT_SQL, clean_text_sql
from .registry import register
from .term_queries import cleaned_docs, mask_reviews, masked_cte, review_base

SP_SQL = r"[\s\p{Z}\x0B\x1c-\x1f\x{85}]"


def u_sql(id_expr: str, tag_expr: str, seed: int = 123) -> str:
    return (f"(('0x' || substr(md5({id_expr}::VARCHAR || ':' || {tag_expr} || ':{seed}'), 1, 8))::BIGINT"
            f" / 4294967296.0)")


def ws_sql(t: str) -> str:
    norm = f"trim(regexp_replace({t}, '{SP_SQL}+', ' ', 'g'))"
    return f"CASE WHEN {norm} = '' THEN []::VARCHAR[] ELSE string_split({norm}, ' ') END"


def key_sql(id_expr: str, seed: int = 123) -> str:
    return f"md5({id_expr}::VARCHAR || ':{seed}')"


# ---------------------------------------------------------------- splits
def c8_reviews(spark, sf):
    r = fx.reviews(spark, sf).select(F.col("doc_id").alias("ID"), sentiment("Rating").alias("Sentiment"))
    return drop_neutral(r)


C8_SQL = fx.REVIEWS_SQL + f""",
c8 AS (SELECT doc_id AS ID, {SENT_SQL.format(r='Rating')} AS Sentiment FROM reviews
       WHERE {SENT_SQL.format(r='Rating')} IS DISTINCT FROM 'neu')"""
SPLIT_EXPR = (f"CASE WHEN row_number() OVER (ORDER BY {key_sql('ID')}, ID) - 1 "
              f"< ceil(0.3::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END")


@register("split_70_30", f"WITH {C8_SQL}\nSELECT ID, {SPLIT_EXPR} AS split FROM c8")
def q_split(spark, sf):
    return S.split(c8_reviews(spark, sf), "ID").select("ID", "split")


LABELLED_SQL = fx.SENTIMENT_DOCS_SQL + """,
labelled AS (SELECT ID, text, CASE Sentiment WHEN 'pos' THEN 1 WHEN 'neg' THEN 0 END AS label FROM sentiment_docs)"""


def labelled(spark, sf):
    return fx.sentiment_docs(spark, sf).select("ID", "text", label_encode("Sentiment").alias("label"))


@register("split_stratified", f"""WITH {LABELLED_SQL}
SELECT ID, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {key_sql('ID')}, ID) - 1
                        < ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split
FROM labelled""")
def q_split_stratified(spark, sf):
    return S.stratified_split(labelled(spark, sf), "label", "ID").select("ID", "label", "split")


def masked_split(spark, sf):
    """Split first, then mask: the rank shuffle carries one text column,
    and the masks are computed after it (row-wise, no shuffle)."""
    return mask_reviews(S.split(review_base(spark, sf), "ID"))


MASKED_SPLIT_SQL = masked_cte() + f""",
msplit AS (SELECT *, {SPLIT_EXPR} AS split FROM masked)"""


@register("condition_sets", f"""WITH {MASKED_SPLIT_SQL}
SELECT 'original_train' AS condition, ID, Review_cleaned AS text, Sentiment FROM msplit WHERE split = 'train'
UNION ALL SELECT 'neutral_train', ID, text_all_neutral, Sentiment FROM msplit WHERE split = 'train'
UNION ALL SELECT 'all_male_test', ID, text_all_male, Sentiment FROM msplit WHERE split = 'test'
UNION ALL SELECT 'all_female_test', ID, text_all_female, Sentiment FROM msplit WHERE split = 'test'""")
def q_condition_sets(spark, sf):
    return S.condition_sets(masked_split(spark, sf))


@register("mix_set", f"""WITH {MASKED_SPLIT_SQL}
SELECT ID, 'male' AS variant, text_all_male AS text, Sentiment FROM msplit WHERE split = 'train'
UNION ALL SELECT ID, 'female', text_all_female, Sentiment FROM msplit WHERE split = 'train'""")
def q_mix_set(spark, sf):
    return S.mix_set(masked_split(spark, sf))


@register("head_subset", f"""WITH {C8_SQL}, s AS (SELECT ID, Sentiment, {SPLIT_EXPR} AS split FROM c8)
SELECT ID, Sentiment FROM s WHERE split = 'train' ORDER BY {key_sql('ID')}, ID LIMIT 250""")
def q_head_subset(spark, sf):
    train = S.split(c8_reviews(spark, sf), "ID").filter(F.col("split") == "train")
    return S.head_subset(train, "ID", 250).select("ID", "Sentiment")


# ---------------------------------------------------------- augmentation
CDOCS_WS_SQL = f"""cdocs AS (SELECT doc_id AS ID, {clean_text_sql('text')} AS t FROM documents),
b AS (SELECT ID, t, {ws_sql('t')} AS ws FROM cdocs)"""

DELETION_SQL = (f"CASE WHEN len(ws) <= 1 THEN t "
                f"WHEN len(list_filter(ws, lambda w, i: {u_sql('ID', '(i - 1)::VARCHAR')} > 0.3)) = 0 "
                f"THEN ws[floor({u_sql('ID', chr(39) + 'pick' + chr(39))} * len(ws))::BIGINT + 1] "
                f"ELSE array_to_string(list_filter(ws, lambda w, i: {u_sql('ID', '(i - 1)::VARCHAR')} > 0.3), ' ') END")


@register("random_deletion", f"WITH {CDOCS_WS_SQL}\nSELECT ID, {DELETION_SQL} AS text FROM b")
def q_random_deletion(spark, sf):
    d = cleaned_docs(spark, sf).withColumnRenamed("doc_id", "ID")
    return A.random_deletion(d, "text", "ID", "deleted").select("ID", F.col("deleted").alias("text"))


def swap_ctes(src: str = "b") -> str:
    parts = [f"w0 AS (SELECT ID, t, ws, len(ws) AS n FROM {src})"]
    for k in range(1, 6):
        a = f"floor({u_sql('ID', repr(f'swap:{2 * k}'))} * n)::BIGINT"
        o = f"(1 + floor({u_sql('ID', repr(f'swap:{2 * k + 1}'))} * (n - 1))::BIGINT)"
        parts.append(f"""w{k} AS (SELECT ID, t, n, CASE WHEN n < 2 THEN ws ELSE list_transform(ws, lambda x, i:
      CASE WHEN i - 1 = a THEN ws[bb + 1] WHEN i - 1 = bb THEN ws[a + 1] ELSE x END) END AS ws
    FROM (SELECT *, a0 AS a, CASE WHEN n < 2 THEN 0 ELSE (a0 + o0) % n END AS bb
          FROM (SELECT *, {a} AS a0, {o} AS o0 FROM w{k - 1})))""")
    return ",\n".join(parts)


SWAP_RESULT = "CASE WHEN n < 2 THEN t ELSE array_to_string(ws, ' ') END"


@register("random_swap", f"WITH {CDOCS_WS_SQL},\n{swap_ctes()}\nSELECT ID, {SWAP_RESULT} AS text FROM w5")
def q_random_swap(spark, sf):
    d = cleaned_docs(spark, sf).withColumnRenamed("doc_id", "ID")
    return A.random_swap(d, "text", "ID", "swapped").select("ID", F.col("swapped").alias("text"))


def labelled_clean(spark, sf):
    return labelled(spark, sf).withColumn("text", clean_text("text"))


AUG_SQL = LABELLED_SQL + ",\n" + fx.PARAPHRASE_SQL + f""",
lb AS (SELECT l.ID, {clean_text_sql('l.text')} AS t, l.label, p.paraphrase FROM labelled l
       LEFT JOIN paraphrase p ON l.ID = p.ID),
b AS (SELECT ID, t, label, paraphrase, {ws_sql('t')} AS ws FROM lb),
{swap_ctes()},
sw AS (SELECT ID, {SWAP_RESULT} AS stext FROM w5),
aug AS (
  SELECT ID, 'paraphrase' AS kind, paraphrase AS text, label FROM b
    WHERE paraphrase IS NOT NULL AND length(t) <= 5000
  UNION ALL SELECT ID, 'deletion', {DELETION_SQL}, label FROM b
  UNION ALL SELECT b.ID, 'swap', sw.stext, b.label FROM b JOIN sw ON b.ID = sw.ID)"""


def augmented_from(spark, sf, rows):
    return A.augment(rows, fx.paraphrase(spark, sf), "ID", "text", "label")


def augmented(spark, sf):
    return augmented_from(spark, sf, labelled_clean(spark, sf))


@register("augment", f"WITH {AUG_SQL}\nSELECT ID, kind, text, label FROM aug")
def q_augment(spark, sf):
    return augmented(spark, sf)


SHUF_SQL = f"""WITH {AUG_SQL},
allrows AS (SELECT ID, 'orig' AS kind, t AS text, label FROM b UNION ALL SELECT * FROM aug),
shuf AS (SELECT ID, kind, (row_number() OVER (ORDER BY {key_sql("ID::VARCHAR || ':' || kind")},
                          ID::VARCHAR || ':' || kind) - 1)::BIGINT AS "order" FROM allrows)"""


def shuffled(spark, sf):
    base = labelled_clean(spark, sf).select("ID", F.lit("orig").alias("kind"), "text", "label")
    allrows = base.unionByName(augmented(spark, sf))
    return S.seeded_shuffle(allrows, F.concat_ws(":", F.col("ID").cast("string"), F.col("kind")))


@register("augment_shuffle", SHUF_SQL + '\nSELECT ID, kind, "order" FROM shuf')
def q_augment_shuffle(spark, sf):
    return shuffled(spark, sf).select("ID", "kind", "order")


@register("batch_assign", SHUF_SQL + '\nSELECT ID, kind, ("order" // 16)::BIGINT AS batch FROM shuf')
def q_batch_assign(spark, sf):
    return S.batches(shuffled(spark, sf), "order", 16).select("ID", "kind", "batch")


# ------------------------------------------------------------------ encode
ENCODE_LEN = 512  # the maximum sequence length of the studied encoder


@register("encode_fixed", f"""WITH {CDOCS_WS_SQL},
vocab AS (SELECT word, (row_number() OVER (ORDER BY cnt DESC, word) + 3)::INTEGER AS id
          FROM (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w)),
head AS (SELECT ID, unnest(ws[1:{ENCODE_LEN - 2}]) AS word, generate_subscripts(ws[1:{ENCODE_LEN - 2}], 1) AS p FROM b),
ids AS (SELECT h.ID, list(coalesce(v.id, 1) ORDER BY h.p) AS w FROM head h LEFT JOIN vocab v ON h.word = v.word
        GROUP BY h.ID),
body AS (SELECT b.ID, [2] || coalesce(ids.w, []::INTEGER[]) || [3] AS body FROM b LEFT JOIN ids ON b.ID = ids.ID)
SELECT ID AS doc_id,
       array_to_string(list_resize(body, {ENCODE_LEN}, 0), ' ') AS input_ids,
       array_to_string(list_resize(list_transform(body, lambda x: 1), {ENCODE_LEN}, 0), ' ') AS attention_mask
FROM body""")
def q_encode(spark, sf):
    d = sized(cleaned_docs(spark, sf).select("doc_id", ws_words("text").alias("words")))  # cut once, read by both steps
    v = A.vocabulary_ids(d, "words")
    e = A.encode(d, v, "doc_id", "words", ENCODE_LEN)
    return e.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"))
