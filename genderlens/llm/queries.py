"""The registered queries of this subpackage and their oracle SQL.

Each query applies its operator with production parameters to its whole
table. SQL can express the URL filter, the repeated strings and the brute force
that the embedding search is held to; the others are trained, hashed or packed
and are tested against brute force or held-out labels in ``tests/llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (bpe, embed_dedup, hard_negatives, html_extract, order_minhash, packing, ppm, quality, simhash, suffix_dedup, toxicity,
               url_filter, whitening)
from .common import table

#: The explicit url rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def page_document(url):
    """The document that a page shows: the number at the end of its path."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)


def op1_url_filter(spark, sf_dir):
    """A page's outcome is good if the document that it shows is labelled of
    quality and not toxic; a label that lacks either mark tells nothing."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = page_document(F.col("url"))
    shown = pages.select("url", F.when(number != "", number).cast("bigint").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    outcomes = shown.join(labels, "doc_id").select("url", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return url_filter.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_apart(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.cleaned(docs, kept="digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_simhash(spark, sf_dir):
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op8_html_extract(spark, sf_dir):
    """The labelled pages are a bounded sample of pages with the texts of the
    documents that they show."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    number = page_document(F.col("url"))
    some = pages.select(F.when(number != "", number).cast("bigint").alias("__doc"), "html").where("__doc is not null")
    some = some.orderBy(F.xxhash64("__doc"), F.xxhash64("html")).limit(html_extract.SAMPLE)  # at most SAMPLE rows: broadcast
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__doc"))
    chain = html_extract.learn(labelled.select("html", "text"))
    return html_extract.extracted(pages, chain).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_embed_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_order_minhash(spark, sf_dir):
    return order_minhash.successor_likeness(table(spark, sf_dir, "documents"))


def op11_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_lm_score(spark, sf_dir):
    return ppm.scored(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op13_hard_negatives(spark, sf_dir):
    """Labels of every seventh id move on by one before mining; every
    fiftieth id is an anchor."""
    moved = ((F.col("label").cast("decimal(20,0)") + 1) % 10).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_html_extract": op8_html_extract,
    "op9_embed_dedup": op9_embed_dedup,
    "op10_order_minhash": op10_order_minhash,
    "op11_whitening": op11_whitening,
    "op12_lm_score": op12_lm_score,
    "op13_hard_negatives": op13_hard_negatives,
}

_URL_SQL = r"""
with p as (
  select page_id, url,
         case when position('://' in coalesce(url, '')) > 0
              then substr(url, position('://' in url) + 3) else '' end as rest
  from pages),
q as (
  select page_id, url,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path,
         try_cast(nullif(regexp_extract(rest, '^[^/?#]*/[a-z]+/([0-9]{1,18})', 1, 's'), '') as bigint) as doc_id
  from p),
lab as (
  select q.host, count(*) as n, sum(case when l.quality = 1 and l.toxic = 0 then 1 else 0 end) as x
  from q join labels l on l.doc_id = q.doc_id
  where l.quality is not null and l.toxic is not null group by q.host),
h as (
  select d.host, coalesce(n, 0) as n, coalesce(x, 0) as x,
         list_aggregate(list_slice(string_split(d.host, '.'), -2, -1), 'string_agg', '.') as domain,
         list_extract(string_split(d.host, '.'), -1) as suffix
  from (select distinct host from q) d left join lab on lab.host = d.host),
whole as (select case when sum(n) > 0 then sum(x)::double / sum(n) else 0.5 end as m from h),
s as (select suffix, sum(n) as n, sum(x) as x, (select m from whole) as prior from h group by suffix),
ks as (select 1 / least(greatest(coalesce((sum(n * pow(x / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0.5), 0.001), 0.5) - 1 as k from s where n > 0),
sp as (select suffix, (k * prior + x) / (k + n) as prior from s, ks),
d as (select h.suffix, h.domain, sum(n) as n, sum(x) as x, any_value(sp.prior) as prior
      from h join sp on sp.suffix = h.suffix group by h.suffix, h.domain),
kd as (select 1 / least(greatest(coalesce((sum(n * pow(x / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0.5), 0.001), 0.5) - 1 as k from d where n > 0),
dp as (select suffix, domain, (k * prior + x) / (k + n) as prior from d, kd),
j as (select h.host, h.n, h.x, dp.prior from h join dp on dp.suffix = h.suffix and dp.domain = h.domain),
kj as (select 1 / least(greatest(coalesce((sum(n * pow(x / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0.5), 0.001), 0.5) - 1 as k from j where n > 0),
ab as (select host, k * prior + x as a, k * (1 - prior) + n - x as b from j, kj),
rep as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from ab),
r as (
  select q.page_id, q.host, q.path, rep.bound,
         case when (q.host = 'www.example.com' or q.host like '%.www.example.com') and starts_with(q.path, '/en/') then 'www.example.com/en/'
              when (q.host = 'example.com' or q.host like '%.example.com') and starts_with(q.path, '/en/') then 'example.com/en/'
              when (q.host = 'net' or q.host like '%.net') and starts_with(q.path, '/es/') then 'net/es/'
              when (q.host = 'net' or q.host like '%.net') and starts_with(q.path, '/fr/') then 'net/fr/'
              when (q.host = 'com' or q.host like '%.com') and starts_with(q.path, '/') then 'com/' end as rule
  from q join rep on rep.host = q.host)
select page_id, host, path, rule,
       case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
            when bound >= 0.5 then 'allow' else 'block' end as verdict
from r
"""

# Every 100-byte string of a text, with the first place where it starts.
_REPEATS_SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as h from documents),
w as (select doc_id, unnest(range(1, octet_length(h) - 98)) as s, h from d),
g as (select doc_id, s, array_slice(h, s, s + 99) as x from w),
f as (select x, min((doc_id, s)) as first, count(*) as n from g group by x having count(*) > 1),
later as (select g.doc_id, g.s from g join f on f.x = g.x where (g.doc_id, g.s) <> f.first),
edge as (select doc_id, s, s - lag(s) over (partition by doc_id order by s) as gap from later),
run as (select doc_id, s, sum(case when gap is null or gap > 100 then 1 else 0 end) over (partition by doc_id order by s) as r from edge),
span as (select doc_id, r, min(s) as a, max(s) + 100 as z from run group by doc_id, r),
kept as (
  select d.doc_id, coalesce(lag(z) over (partition by d.doc_id order by a), 1) as p, a as q, false as tail from d join span on span.doc_id = d.doc_id
  union all select d.doc_id, coalesce(m.z, 1), octet_length(h) + 1, true from d left join (select doc_id, max(z) as z from span group by doc_id) m on m.doc_id = d.doc_id),
text as (select k.doc_id, string_agg(hex(array_slice(h, p, q - 1)), '' order by p, tail) as x
         from kept k join d on d.doc_id = k.doc_id group by k.doc_id),
gone as (select doc_id, sum(z - a) as n, count(*) as k from span group by doc_id)
select d.doc_id, octet_length(h)::bigint as n_bytes, coalesce(gone.n, 0)::bigint as n_removed, coalesce(gone.k, 0)::bigint as n_spans,
       sha256(unhex(text.x)) as kept_sha256
from d join text on text.doc_id = d.doc_id left join gone on gone.doc_id = d.doc_id
"""

# All pairs by cosine; a label travels along links from smaller ids.
_EMBED_SQL = r"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
half as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id and len(a.e) = len(b.e)
         where list_cosine_similarity(a.e, b.e) >= 0.9),
link as (select a, b from half union all select b, a from half),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join link l on l.a = r.vec_id where r.c < l.b)
select e.vec_id, (select count(*) from link where link.a = e.vec_id)::bigint as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join (select vec_id, min(c) as c from r group by vec_id) m on m.vec_id = e.vec_id
"""

# Every anchor against every row; the row number tells repeated rows apart.
_NEGATIVES_SQL = r"""
with r as (
  select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding::double[], lambda x: floor(256 * x)) as x
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.k, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from r a join r b on a.k <> b.k where a.vec_id % 50 = 0),
p as (
  select k, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by k order by score desc, vec_id) as place
  from s where same),
n as (
  select p.k, p.place, p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.k, p.place order by s.score desc, s.vec_id)::integer as rank
  from p join s on s.k = p.k and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
  where p.place <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _URL_SQL, "op4_suffix_dedup": _REPEATS_SQL, "op9_embed_dedup": _EMBED_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
