"""Lexicon rewrites and counts: goldens, and equality with a plain Python
sequential-regex implementation of the same rules on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from genderlens.operators import names as N
from genderlens.operators.terms import add_masks, mask_text, masked_table, neutral_pattern
from genderlens.sources import lexicon as lx

F2M, M2F, UNI = lx.f2m_pairs(), lx.m2f_pairs(), lx.term_universe()

GOLDEN = [  # word, female->male, male->female, neutral
    ("mormor", "farmor", "mormor", ""), ("hendes", "hams", "hendes", ""),
    ("hans", "hans", "huns", ""), ("woman", "man", "wowoman", ""), ("men", "men", "women", ""),
    ("moster", "morbror", "moster", ""), ("morbror", "farbror", "morsøster", ""),
    ("damer", "mandr", "damer", ""), ("søsterlig", "brorlig", "søsterlig", ""),
    ("kvindelig", "mandlig", "kvindelig", ""), ("drengepige", "drengedreng", "pigeepige", ""),
    ("elskerinde", "elsker", "elskerindeinde", ""), ("blomsterpigen", "blomsterdrengn", "blomsterpigen", "blomster"),
    ("handling", "handling", "hundling", ""),
]


def py_fold(text, pairs):
    for t, r in pairs:
        text = re.sub(rf"({re.escape(t)})(\w*)", lambda m, r=r: r + m.group(2), text)
    return text


def py_neutral(text, terms):
    alt = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return re.sub(rf"(?:{alt})\w*", "", text)


def py_counts(text, terms):
    return {t: len(re.findall(rf"{re.escape(t)}\w*", text)) for t in terms}


def test_lexicon_sizes():
    assert (len(F2M), len(M2F), len(UNI)) == (83, 71, 154)
    assert dict(F2M)["kvindelig"] == "mandig" and dict(M2F)["mand"] == "dame"


def test_rewrite_goldens(spark):
    df = spark.createDataFrame([(i, w) for i, (w, *_r) in enumerate(GOLDEN)], "id int, text string")
    out = add_masks(df, "text", {"m": F2M, "f": M2F, "n": "neutral"}, UNI).orderBy("id").collect()
    for row, (w, m, f, n) in zip(out, GOLDEN):
        assert (row.m, row.f, row.n) == (m, f, n), w


def random_texts(n=300, seed=7):
    rng = random.Random(seed)
    parts = ["mor", "hun", "han", "s", "lig", "inde", "kvinde", "pige", "men", "wo", "man", "gal",
             "hende", "dreng", "x", "æø", "bror", "enke", "r", "e", "blondine", "bh"]
    seps = [" ", "  ", "\n", " ", " "]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 25))]
        out.append((i, "".join(w + rng.choice(seps) for w in words)))
    return out


def test_word_path_equals_python_fold(spark):
    texts = random_texts()
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: r for r in add_masks(df, "text", {"m": F2M, "f": M2F, "n": "neutral"}, UNI).collect()}
    whole = {r.id: r for r in df.select("id", mask_text("text", F2M).alias("m")).collect()}
    for i, t in texts:
        assert got[i].m == py_fold(t, F2M) == whole[i].m, t
        assert got[i].f == py_fold(t, M2F), t
        assert got[i].n == py_neutral(t, UNI), t


def test_counts_equal_findall(spark):
    texts = random_texts(200, seed=11)
    df = spark.createDataFrame(texts, "id int, text string")
    m = masked_table(df, "text", F2M, M2F, UNI, lx.PRONOUNS).collect()
    for r in m:
        exp = py_counts(texts[r.id][1], UNI)
        assert dict(r.count_table) == exp
        assert r.count_total == sum(exp.values())
        assert r.count_prons == sum(exp[p] for p in lx.PRONOUNS)


def test_scan_counts_equal_text_path(spark):
    texts = random_texts(200, seed=3)
    df = spark.createDataFrame(texts, "id int, text string")
    terms = spark.createDataFrame([(t,) for t in UNI], "term string")
    got = {(r.id, r.term): r.n for r in N.term_counts(df, "id", "text", terms).collect()}
    exp = {(i, t): n for i, tx in texts for t, n in py_counts(tx, UNI).items() if n > 0}
    assert got == exp


def lexicon_of(spark, pairs):
    return spark.createDataFrame([(t, r, i) for i, (t, r) in enumerate(pairs)], "term string, repl string, pos long")


@pytest.fixture(params=["10m", "-1"])
def broadcast_limit(spark, request):
    """Small tables broadcast, and nothing broadcast but the head of the keys."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.unset(name)


def test_index_rewrite_equals_python_fold(spark, broadcast_limit):
    texts = random_texts(150, seed=5)
    df = spark.createDataFrame(texts, "id int, text string")
    got = N.rewrite(df, "text", lexicon_of(spark, F2M[:40]), "t").orderBy("id").collect()
    assert [r.t for r in got] == [py_fold(t, F2M[:40]) for _, t in texts]
    got = N.neutral(df, "text", lexicon_of(spark, F2M[:40]), "t").orderBy("id").collect()
    assert [r.t for r in got] == [py_neutral(t, [t for t, _ in F2M[:40]]) for _, t in texts]


PARTS = ["i", "abo", "da", " ", " ", "é na", "x", "b", "  ", "-", "na", "é"]
LEXICONS = [
    [("abo", ""), ("ida", ""), ("é na", "x"), ("x", "abo")],  # cascades through a phrase
    [("b", ""), ("a x", "q"), ("i  na", "u"), ("daq", "x b"), ("x b", "é na")],  # separators meet where a word goes
    [("x", "é"), ("da é na", "b"), ("é na", ""), ("abo-x", "i"), ("b", "x x")],
    [("na ", "o"), ("-x", ""), ("abo", "-x")],  # terms that begin or end with a separator
]


@pytest.mark.parametrize("pairs", LEXICONS)
def test_phrases_and_cascades_equal_plain_folds(spark, pairs):
    """Fold, neutral text and counts of random texts against plain Python."""
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    df = spark.createDataFrame(texts, "id int, text string")
    lex, terms = lexicon_of(spark, pairs), [t for t, _ in pairs]
    m = N.masked_table(df, "text", lex, lexicon_of(spark, pairs[::-1]), [terms[0]]).collect()
    assert len(m) == len(texts)
    for r in m:
        t = texts[r.id][1]
        assert r.text_all_male == py_fold(t, pairs), t
        assert r.text_all_female == py_fold(t, pairs[::-1]), t
        assert r.text_all_neutral == py_neutral(t, terms), t
        exp = {k: v for k, v in py_counts(t, terms).items() if v}
        assert dict(r.count_table) == exp and r.count_prons == exp.get(terms[0], 0), t


def test_two_hundred_thousand_names(spark):
    """The lexicon is a table: no Python in the plan, nothing of it collected."""
    lex = spark.range(200_000).selectExpr("concat('navn', lower(hex(id)), 'q') as term", "'' as repl", "id as pos")
    df = spark.createDataFrame([(i, f"hr navn{i * 97:x}qsen og navn{i:x} gik") for i in range(50)], "id int, text string")
    out = N.rewrite(df, "text", lex, "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
    assert sorted(r.t for r in out.collect()) == sorted(f"hr sen og navn{i:x} gik" for i in range(50))
    counts = N.term_counts(df, "id", "text", lex.select("term"))
    assert counts.count() == 50 and counts.agg({"n": "max"}).first()[0] == 1


def test_multiword_names_and_cascades(spark):
    def fold(text, terms):
        df = spark.createDataFrame([(text,)], "text string")
        return N.rewrite(df, "text", lexicon_of(spark, terms), "t").first().t

    assert fold("anne marie og karen gik", [("anne marie", ""), ("karen", "")]) == " og  gik"
    assert fold("iaboda kvindelig", [("kvinde", "mand"), ("abo", ""), ("ida", "")]) == " mandlig"
    assert fold("xanne marieb anne-lise", [("anne marie", ""), ("xb", "q"), ("anne-lise", "")]) == "q "
    assert fold("aaa aaaa", [("aa", "a")]) == "aa aaa"
    names = [("abo", ""), ("ida", ""), ("é na", "x"), ("x", "abo")]
    rng = random.Random(4)
    texts = ["".join(rng.choice(["i", "abo", "da", " ", "é na", "x", "b"]) for _ in range(25)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in N.rewrite(df, "text", lexicon_of(spark, names), "t").collect():
        assert r.t == py_fold(texts[r.id], names), texts[r.id]


def test_scan_nulls_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5, "c"), (1, "hun", 5, "c"), (1, "", 5, "c")], "id int, text string, n int, count_table string")
    lex = lexicon_of(spark, [("hun", "han")])
    m = N.masked_table(df, "text", lex, lexicon_of(spark, [("han", "hun")]), ["hun"]).collect()
    assert sorted([(r.text_all_male, r.count_total, r.n) for r in m], key=str) == [("", 0, 5), ("han", 1, 5), (None, 0, 5)]
    assert N.masked_table(df.limit(0), "text", lex, lex, ["hun"]).count() == 0
    assert N.rewrite(df, "text", lex.limit(0), "t").count() == 3


def test_names_hit_the_documents(spark):
    from genderlens.plans.term_queries import cleaned_docs, names
    from tests.conftest import SF001
    lists = [r.name for r in names(spark, SF001).collect()]
    docs = [r.text for r in cleaned_docs(spark, SF001).collect()]
    assert any(" " in n for n in lists)
    assert sum(any(n in d for n in lists) for d in docs) >= 0.2 * len(docs)


def test_word_path_falls_back_on_other_characters(spark):
    pairs = [("hun", "han"), ("spider-man", "spider-woman"), ("woman", "man")]
    texts = [(0, "hun spider-man"), (1, "hun \u0001 hunden"), (2, None), (3, "woman")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = add_masks(df, "text", {"t": pairs}, [t for t, _ in pairs]).collect()
    assert [r.t for r in got] == [None if t is None else py_fold(t, pairs) for _, t in texts]


def test_empty_lexicon_is_identity(spark):
    df = spark.createDataFrame([(1, "hun og han"), (2, "")], "id int, text string")
    assert [r.t for r in df.select(mask_text("text", []).alias("t")).orderBy("t").collect()] == ["", "hun og han"]


def test_stream_equals_batch(spark):
    from genderlens.streaming.stream import document_stream, masked_stream, run_available
    from tests.conftest import SF001
    from genderlens.plans.term_queries import cleaned_docs  # noqa: F401
    from genderlens.sources.tables import read_table
    out = run_available(masked_stream(document_stream(spark, SF001)), "test")
    first = spark.read.parquet(out).count()
    # a restart under the same name resumes: nothing is read twice
    assert run_available(masked_stream(document_stream(spark, SF001)), "test") == out
    assert spark.read.parquet(out).count() == first
    streamed = {r.ID: (r.count_total, r.text_all_male, r.text_all_neutral)
                for r in spark.read.parquet(out).collect()}
    batch = {r.ID: (r.count_total, r.text_all_male, r.text_all_neutral)
             for r in masked_stream(read_table(spark, SF001, "documents")).collect()}
    assert streamed == batch and len(batch) > 0


def test_masked_table_with_names(spark):
    fem, mal = ["anna", "karen"], ["bo", "mads"]
    names = spark.createDataFrame([(n, "female", i) for i, n in enumerate(fem)]
                                  + [(n, "male", 10 + i) for i, n in enumerate(mal)],
                                  "name string, gender string, ord long")
    rng = random.Random(13)
    texts = []
    for i, t in random_texts(120, seed=21):
        extra = " ".join(rng.choice(fem + mal + ["x"]) for _ in range(rng.randint(0, 4)))
        texts.append((i, t + " " + extra))
    df = spark.createDataFrame(texts, "id int, text string")
    m = N.masked_table(df, "text", lx.lexicon_frame(spark, "f2m", names), lx.lexicon_frame(spark, "m2f", names),
                       lx.PRONOUNS).collect()
    f2m, m2f = lx.f2m_pairs(fem), lx.m2f_pairs(mal)
    uni = lx.term_universe(fem, mal)
    assert len(m) == len(texts)
    for r in m:
        t = texts[r.id][1]
        assert r.text_all_male == py_fold(t, f2m)
        assert r.text_all_female == py_fold(t, m2f)
        assert r.text_all_neutral == py_neutral(t, uni)
        exp = {k: v for k, v in py_counts(t, uni).items() if v}
        assert dict(r.count_table) == exp and r.count_total == sum(exp.values())
