"""Cleaning edge rows, exact dense ranks and splits, augmentation and
early-stop properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genderlens.functions.cleaning import (danish_date_fixed, danish_date_parity, label_encode,
                                           sentiment, strip_author)
from genderlens.functions.text import clean_text, ws_words
from genderlens.operators import analytics as P
from genderlens.operators import augment as A
from genderlens.operators import splits as S
from genderlens.operators.metrics import early_stop
from genderlens.operators.ranking import dense_id, rank_by_uniform
from genderlens.sources.html import scrape_pages


def test_author_date_sentiment_edges(spark):
    rows = [("Af Anders", "5. jan 2018", 4), ("Af Bo", "12. maj2019", None), ("Fie", "1. januar 2017", 6),
            ("Af  Ib", "2. juni 2017", 3), ("Af Ea", "3. mar 2020 | 10:00", 5), ("Af Ea", "7. okt.2021", 1)]
    df = spark.createDataFrame(rows, "Author string, Date string, Rating int")
    out = df.select(strip_author("Author", "parity").alias("p"), strip_author("Author", "fixed").alias("f"),
                    danish_date_parity("Date").alias("d"), danish_date_fixed("Date").alias("df"),
                    sentiment("Rating").alias("s"), label_encode(sentiment("Rating")).alias("l")).collect()
    assert [r.p for r in out] == ["nders", "Bo", "Fie", "Ib", "Ea", "Ea"]
    assert [r.f for r in out] == ["Anders", "Bo", "Fie", "Ib", "Ea", "Ea"]
    assert [r.d for r in out] == ["05/01/2018", None, None, "02/06/2017", "03/03/2020", "07/10/2021"]
    assert [r.df for r in out] == ["05/01/2018", "12/05/2019", "01/01/2017", "02/06/2017", "03/03/2020",
                                   "07/10/2021"]
    assert [r.s for r in out] == ["neu", "neu", "pos", "neg", "pos", "neg"]
    assert [r.l for r in out] == [None, None, 1, 0, 1, 0]


def test_clean_text_keeps_letters_and_newlines(spark):
    df = spark.createDataFrame([("Hej, Søster!\nÆble-grød 2x_y",), ("",)], "t string")
    out = [r.c for r in df.select(clean_text("t").alias("c")).collect()]
    assert out == ["hej søster\næblegrød 2x_y", ""]


def test_dense_id_matches_row_number(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10 ** 9), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = {r.k: r.ID for r in dense_id(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_rank_by_uniform_is_partition_independent(spark):
    df = spark.range(5000).withColumnRenamed("id", "ID")
    a = {r.ID: r.rank for r in S.seeded_rank(df.repartition(3), "ID", 123).collect()}
    b = {r.ID: r.rank for r in S.seeded_rank(df.repartition(11), "ID", 123).collect()}
    assert a == b and sorted(a.values()) == list(range(5000))


def test_split_sizes_exact_and_disjoint(spark):
    df = spark.range(1001).withColumnRenamed("id", "ID")
    out = S.split(df, "ID").collect()
    test = [r.ID for r in out if r.split == "test"]
    assert len(test) == math.ceil(0.3 * 1001) and len(out) == 1001
    strat = S.stratified_split(df.withColumn("label", (F.col("ID") % 3 == 0).cast("int")), "label").collect()
    for lab in (0, 1):
        n = sum(1 for r in strat if r.label == lab)
        t = sum(1 for r in strat if r.label == lab and r.split == "test")
        assert t == math.ceil(0.3 * n)


def test_augment_properties(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 12))) for i in range(200)]
    df = spark.createDataFrame(texts, "ID int, text string")
    d = A.random_deletion(df, "text", "ID", "d")
    d = A.random_swap(d, "text", "ID", "s").collect()
    for r in d:
        words = r.text.split()
        if len(words) <= 1:
            assert r.d == r.text and r.s == r.text
            continue
        kept = r.d.split()
        assert kept and all(w in words for w in kept)
        assert [w for w in words if w in kept] == kept  # order kept
        assert sorted(r.s.split()) == sorted(words)  # swap is a permutation


def test_ws_words_matches_str_split(spark):
    samples = ["  a  b\n c\t", "", "   ", "one", "x y z"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    out = [r.w for r in df.select(ws_words("t").alias("w")).collect()]
    assert out == [s.split() for s in samples]


def test_early_stop_curves(spark):
    rows = []
    curves = {"stops": [0.5, 0.6, 0.6, 0.59, 0.7], "never": [0.1, 0.2, 0.3, 0.4],
              "tiny": [0.5, 0.5005, 0.5009, 0.9]}
    for g, vals in curves.items():
        rows += [(g, i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, e int, v double")
    out = {r.g: (r.stop_epoch, r.best_epoch) for r in early_stop(df, ["g"], "e", "v").collect()}
    assert out == {"stops": (3, 1), "never": (None, 3), "tiny": (2, 0)}


def test_html_missing_blocks(spark):
    html = ('<html><script>var t="</p>";</script><h1> A &amp; B </h1><div class="rating">'
            '<img src="/star-black.png"><img src="/star-black.png"><img src="/star-white.png"></div>'
            '<div class="text"><p>First <b>bold</b></p><p>Second</div></html>')
    df = spark.createDataFrame([(1, "u1", html), (2, "u2", "<p>no blocks</p>")], "page_id int, url string, html string")
    r1, r2 = scrape_pages(df).orderBy("page_id").collect()
    assert (r1.Title, r1.Rating, r1.Review, r1.Author) == ("A & B", 2, "Firstbold Second", None)
    assert (r2.Title, r2.Rating, r2.Review) == (None, None, None)


def test_splits_independent_of_partitioning(spark):
    df = spark.range(3000).withColumnRenamed("id", "ID").withColumn("label", (F.col("ID") % 4 == 0).cast("int"))
    a = {r.ID: r.split for r in S.stratified_split(df.repartition(2), "label", buckets=16).collect()}
    b = {r.ID: r.split for r in S.stratified_split(df.repartition(13), "label", buckets=64).collect()}
    c = {r.ID: r.split for r in S.split(df.repartition(5), buckets=7).collect()}
    d = {r.ID: r.split for r in S.split(df.repartition(9)).collect()}
    assert a == b and c == d


def test_stratified_split_of_many_labels(spark):
    """100,000 labels, one of them with a third of the rows: exact, and the
    same with the cuts broadcast or shuffled."""
    many = spark.range(200_000).selectExpr("id as ID", "concat('g', id div 2) as label")
    large = spark.range(200_000, 300_000).selectExpr("id as ID", "'large' as label")
    few = spark.range(300_000, 300_010).selectExpr("id as ID", "cast(null as string) as label")
    df = many.union(large).union(few)
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = S.stratified_split(df, "label")
            sizes = got.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
            assert sizes.where("t <> ceil(0.3D * n)").count() == 0 and sizes.count() == 100_002
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    small = df.where("ID >= 299000")
    keys = {r.ID: r.k for r in small.select("ID", S.order_key("ID", 123).alias("k")).collect()}
    split = {r.ID: r.split for r in S.stratified_split(small, "label").collect()}
    for ids in ([i for i in keys if i < 300_000], [i for i in keys if i >= 300_000]):
        ordered = sorted(ids, key=lambda i: (keys[i], i))
        n = math.ceil(0.3 * len(ids))
        assert [split[i] for i in ordered] == ["test"] * n + ["train"] * (len(ids) - n)


def test_continuous_columns_have_exact_order_statistics(spark):
    rng = np.random.default_rng(3)
    for values in (rng.lognormal(3, 4, 1001), np.r_[np.zeros(500), rng.standard_normal(501) * 1e-300], np.array([5.0]), np.array([1.0, np.nextafter(1, 2)] * 3),
                   np.array([-1.7e308, 1.7e308, 3.0, -math.inf, math.inf]), np.repeat([1.0, 2.0, 7.0], 100)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "Rating double")
        n = len(values)
        assert P.order_statistics(df, "Rating", [0, n // 2, n - 1]) == np.sort(values)[[0, n // 2, n - 1]].tolist()
    values = rng.gamma(2, 1.5, 2000)
    df = spark.createDataFrame([(float(v),) for v in values], "Rating double")
    s = P.rating_summary(df).first()
    assert s.median == pytest.approx(np.median(values), abs=1e-9) and s.n == 2000
    x = np.arange(29) * 0.25
    bw = values.std(ddof=1) * 2000 ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - values) / bw) ** 2).sum(1) / (2000 * bw * math.sqrt(2 * math.pi))
    got = [r.density for r in P.rating_kde(df).orderBy("x").collect()]
    assert got == pytest.approx(want, abs=1e-4)
    empty = df.limit(0)
    assert P.rating_summary(empty).first().n == 0 and P.rating_kde(empty).count() == 0 and P.rating_kde(df.limit(1)).count() == 0
