"""Faults named by the third round's findings."""

import random

import pytest
from pyspark.sql import functions as F

from genderlens.operators import augment as A
from genderlens.operators import epochs as E
from genderlens.operators import ml
from genderlens.operators import names as N
from genderlens.operators import terms as T
from genderlens.plans.io_queries import FILE_BYTES, file_count
from genderlens.sources import csv as C
from genderlens.sources import lexicon as lx


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_meet_the_ties_where_they_are(spark):
    """The pairs of neighbours were dealt by word, with all parts of each word."""
    texts = ["anna maria gik", "hanna mariane og anna", "xanna mari", "maria anna"]
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, __text string")
    ties = N.sized(spark.createDataFrame([("anna", " ", "maria"), ("na", " ", "mariane")], "l string, sep string, r string"))
    none = spark.createDataFrame([], "unit string, ls array<string>, rs array<string>")
    lengths = {"l": [2, 4], "r": [5, 7]}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = N._tied(N._pairs(rows), none, ties, lengths, None, spark.createDataFrame([], "unit string"))
        assert "hashpartitioning(left" not in plan_of(got) and "hashpartitioning(right" not in plan_of(got)
        assert sorted((r[0], r[1]) for r in got.collect()) == [(0, 0), (1, 0)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_gained_parts_on_either_side_tie(spark):
    """A part that a word gains counts with the other's own and gained parts."""
    rows = spark.createDataFrame([(0, "q b"), (1, "a q"), (2, "q p"), (3, "a b"), (4, "p p"), (5, "q q")], "__row long, __text string")
    ties = N.sized(spark.createDataFrame([("a", " ", "b")], "l string, sep string, r string"))
    gained = spark.createDataFrame([("q", ["a"], ["b"]), ("p", [], ["b"])], "unit string, ls array<string>, rs array<string>")
    got = N._tied(N._pairs(rows), gained, ties, {"l": [1], "r": [1]}, None, spark.createDataFrame([], "unit string"))
    assert sorted(r[0] for r in got.collect()) == [0, 1, 2, 3, 5]


def test_only_lengths_that_fit_are_made(spark):
    df = spark.createDataFrame([("",), ("a",), ("abc",), ("abcdefgh",), (None,)], "s string")
    got = sorted((r.s, r[1]) for r in N._sizes(df, "s", [2, 3, 5]).collect())
    assert got == [("abc", 2), ("abc", 3), ("abcdefgh", 2), ("abcdefgh", 3), ("abcdefgh", 5)]
    assert N._sizes(df, "s", []).count() == 0


def test_split_scan_files_are_written_by_many_tasks():
    """all rows went through one task."""
    assert [file_count(n) for n in (0, FILE_BYTES, FILE_BYTES + 1, 48 * FILE_BYTES)] == [1, 1, 2, 48]


def test_search_cuts_texts_into_words_once(spark, monkeypatch):
    """every trial cut all texts three times."""
    calls = []
    cut = ml.RegexTokenizer._transform
    monkeypatch.setattr(ml.RegexTokenizer, "_transform", lambda self, df: calls.append(1) or cut(self, df))
    data = spark.createDataFrame([(i, "god film" if i % 2 else "ringe film", i % 2) for i in range(40)], "ID int, text string, label int")
    assert ml.search_params(spark, data, 2).count() == 2
    assert len(calls) == 1


def test_grouped_trie_finds_the_same_words(spark):
    """a position tries a few of the term beginnings."""
    import re
    words = [t for t in lx.term_universe() if T.is_word_term(t)]
    rng = random.Random(5)
    texts = ["".join(rng.choice([rng.choice(words), "a", "n", "x", " "]) for _ in range(30)) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.regexp_extract_all("t", F.lit(T.hit_word_regex(words)), 0).alias("h")).collect()
    for r in got:
        assert r.h == [w for w in re.findall(r"\w+", r.t) if any(t in w for t in words)]
    assert "(?=[" in T.trie_regex(words)


def labelled(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("god fin dårlig trist film og den er".split()) for _ in range(rng.randint(0, 6))), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows + [(3, "god god", 1), (None, None, 0)], "ID long, text string, label int")
    return df, df.where("ID > 19")


def test_trials_cut_the_texts_once(spark, monkeypatch):
    """every trial cut, counted and scaled the words of all texts again."""
    calls = []
    cut = E.word_runs
    monkeypatch.setattr(E, "word_runs", lambda c: calls.append(1) or cut(c))
    trials = [E.Settings(lr=0.1, epochs=1, batches=n) for n in (1, 2)]
    assert E.search(*labelled(spark), C.scratch_path(spark, "once"), trials).count() == 2
    assert len(calls) == 1


def test_steps_do_not_shuffle_frequent_words(spark, monkeypatch):
    """the words of a batch were shuffled to their weights; rare words still are, to the same figures."""
    s = E.Settings(lr=0.1, epochs=1, batches=1, warmup=0.0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        for hot in (100, 3):
            monkeypatch.setattr(E, "HOT", hot)
            t = E.Trainer(*labelled(spark), C.scratch_path(spark, "hot"), s)
            if hot == 100:
                model = N.sized(t.model(0).join(t.x.select("word").distinct().withColumn("id", F.lit(0)), "word"))
                plan = plan_of(t.margins(model, 0))
                assert "hashpartitioning(word" not in plan and "hashpartitioning(id" not in plan
            got.append(tuple(t.run().first()))
        assert got[0] == pytest.approx(got[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_encode_does_not_shuffle_frequent_words(spark, monkeypatch):
    """words beyond the first thousand were shuffled to their ids."""
    texts = ["b a a", "c a  d", None, "", "a", "z b c d a"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "b a a"), (None, "a")], "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6), ("d", 7)], "word string, id int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        for hot in (100, 2):
            monkeypatch.setattr(A, "HOT", hot)
            e = A.encode(docs, vocab, "doc_id", "text", 6)
            if hot == 100:
                assert "hashpartitioning(word" not in plan_of(e)
            got.append(sorted((r.doc_id is None, r.doc_id, r.input_ids, r.attention_mask) for r in e.collect()))
        assert got[0] == got[1]
        assert {r[1]: r[2] for r in got[0] if r[1] not in (None, 0)} == {
            1: [2, 6, 4, 7, 3, 0], 2: [2, 3, 0, 0, 0, 0], 3: [2, 3, 0, 0, 0, 0], 4: [2, 4, 3, 0, 0, 0], 5: [2, 1, 5, 6, 7, 3]}
        assert [r[2] for r in got[0] if r[1] is None] == [[2, 3, 0, 0, 0, 0]]  # a null id meets nothing, as before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
