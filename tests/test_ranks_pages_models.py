"""Ranks with nulls and empty tables, nested pages, naive Bayes, plan shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from genderlens.operators import ml
from genderlens.operators.augment import vocabulary_ids
from genderlens.operators.ranking import dense_id, rank_by_order
from genderlens.operators.splits import seeded_rank, stratified_split
from genderlens.sources.html import review_fields, scrape_pages

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_id_keeps_nulls_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (None, "c")], "k bigint, v string")
    assert {r.v: r.ID for r in dense_id(df, "k").collect()} == {"a": 0, "b": 1, "c": 2}
    assert dense_id(df.limit(0), "k").columns == ["k", "v", "ID"] and dense_id(df.limit(0), "k").count() == 0
    big = spark.range(5000).select((F.col("id") * 37 % 5003).alias("k"))
    assert all(r.ID == i for i, r in enumerate(dense_id(big, "k").orderBy("k").collect()))


def test_dense_id_deals_null_keys(spark):
    df = spark.range(0, 6000, 1, 4).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), (F.col("id") * 7 % 6007).alias("t"))
    got = dense_id(df, "k", tie="t")
    rows = sorted((r.k is None, r.t if r.k is None else r.k, r.ID) for r in got.collect())
    assert [r[2] for r in rows] == list(range(6000))
    for one in (got, dense_id(df, "k"), dense_id(df.select("k"), "k")):
        assert sorted(r.ID for r in one.collect()) == list(range(6000))
        assert all((r.k is None) == (r.ID >= 4000) for r in one.collect())
        nulls = one.where("k is null").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in nulls) < 0.6 * 2000  # not ranked in one task


def test_seeded_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "x")], "ID bigint, g string")
    got = seeded_rank(df, "ID", 1, group=["g"]).collect()
    assert sorted((str(r.g), r["rank"]) for r in got) == [("None", 0), ("None", 1), ("x", 0), ("x", 1)]
    assert stratified_split(df, "g").count() == 4


def test_rank_by_order_spreads_ties(spark):
    rng = random.Random(1)
    rows = [(f"w{i:05d}", 1 if i > 50 else rng.randint(2, 9)) for i in range(4000)]
    ranked = rank_by_order(spark.createDataFrame(rows, "word string, cnt int"), [F.col("cnt").desc(), F.col("word")])
    got = [r.word for r in ranked.orderBy("rank").collect()]
    assert got == [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(4000))


def test_vocabulary_ids_have_no_dominant_task(spark):
    docs = spark.createDataFrame([(i, " ".join(f"th{i}x{j}" for j in range(40)) + " the") for i in range(100)], "id int, text string")
    v = vocabulary_ids(docs, "text")
    assert v.count() == 4001 and v.where("word = 'the'").first().id == 4
    # the rare tail, all of one prefix and frequency, is dealt over many range partitions
    sizes = [r["count"] for r in docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
             .repartitionByRange(32, F.col("cnt").desc(), "word").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.1 * sum(sizes)


def test_pages_nested_blocks_entities_and_attributes():
    page = ("<h1>A &amp; b</h1><div class='text big'><p>one</p><div><p>t&oslash;<b>w</b>&#230;</p></div><p>three<p>four</div><p>after</p>"
            "<div class=author>Af <i>S&oslash;ren</i></div><div class=\"published\"> 1. maj </div>"
            "<div class=rating><div><img src=x/star-black.png></div><img src='y/star-black.png'><img src=z></div><img src=star-black.png>")
    assert review_fields(page) == ("A & b", "1. maj", "AfSøren", 2, "one tøwæ three four")
    assert review_fields(None) == (None,) * 5 and review_fields("") == (None,) * 5
    assert review_fields("<div class='text'></div>")[4] == "" and review_fields("<script><h1>x</h1></script>")[0] is None


def test_pages_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "<h1>x</h1>", "t")], "page_id int, url string, html string, Title string")
    got = {r.page_id: r for r in scrape_pages(df).collect()}
    assert got[1].Title is None and got[1].URL == "u" and got[2].Title == "x" and got[2].URL is None
    assert scrape_pages(df.limit(0)).count() == 0


def test_bayes_equals_plain_python(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [("m", " ".join(rng.choice(words[:20] if y else words[8:]) for _ in range(12)), y) for y in [0, 1] * 40]
    rows += [("m", "w0 w1", None), ("one", "w3 w4", 1), ("one", None, 1)]
    train = spark.createDataFrame(rows, "Model string, text string, label int")
    texts = [(i, " ".join(rng.choice(words + ["new"]) for _ in range(6))) for i in range(40)] + [(98, ""), (99, None)]
    got = {(r.Model, r.ID): r.pred for r in ml.bayes_predict(train, "Model", spark.createDataFrame(texts, "ID int, text string"), ["ID"]).collect()}
    n = {0: {}, 1: {}}
    for m, t, y in rows:
        if m == "m" and y is not None:
            for w in t.split():
                n[y][w] = n[y].get(w, 0) + 1
    v, tot = len(set(n[0]) | set(n[1])), {c: sum(n[c].values()) for c in n}
    for i, t in texts:
        s = sum(math.log((n[1].get(w, 0) + 1) / (tot[1] + v)) - math.log((n[0].get(w, 0) + 1) / (tot[0] + v))
                for w in (t or "").split() if w in n[0] or w in n[1])
        assert got["m", i] == int(s > 0) and got["one", i] == 1
    assert len(got) == 2 * len(texts)
    assert ml.bayes_predict(train.limit(0), "Model", spark.createDataFrame(texts, "ID int, text string"), ["ID"]).count() == 0


def test_logistic_training_shapes(spark):
    rows = entry.queries()["train_conditions_logistic"](spark, SF).collect()
    assert {r.Model for r in rows} == {"original", "neutral", "mix"} and {r.pred for r in rows} <= {0, 1}
    data = spark.createDataFrame([("god film", 1), ("ringe film", 0), (None, None), ("x", None)] * 5, "text string, label int")
    model = ml.fit(data.fillna({"text": ""}), num_features=64, max_iter=3)
    assert ml.predict(model, data).count() == 20


@pytest.mark.parametrize("name", ["condition_sets", "mix_set"])
def test_condition_sets_scan_once(spark, name):
    assert plan_of(entry.queries()[name](spark, SF)).count("FileScan") == 1


def test_names_rewrite_does_not_move_texts(spark):
    p = plan_of(entry.queries()["masked_table_names"](spark, SF))
    assert "hashpartitioning" not in p and "SortMergeJoin" not in p and "Generate" not in p


def test_masked_table_scans_each_text_once(spark):
    p = plan_of(entry.queries()["masked_table"](spark, SF))
    assert p.count("split(regexp_replace(") == 1
