"""LM scoring, whitening and hard negatives against plain brute force, and
their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from genderlens.llm import hard_negatives, ppm, queries, whitening
from tests.conftest import SF001


# ---- prediction by partial matching ----------------------------------------------

def plain_bytes(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", lower.encode())) + b"\n"


def plain_model(texts, order):
    """Per level: context -> symbol -> count, shorter ones by update exclusion."""
    levels = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        x = b"\n" * order + t
        for i in range(order, len(x)):
            levels[order][x[i - order:i]][x[i]] += 1
    for k in range(order - 1, -1, -1):
        for c, symbols in levels[k + 1].items():
            for s in symbols:
                levels[k][c[1:]][s] += 1
    return levels


def plain_score(levels, t, order):
    x, total = b"\n" * order + t, 0.0
    for i in range(order, len(x)):
        gone = set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in levels[k].get(x[i - k:i], {}).items() if s not in gone}
            if not left:
                continue
            all_ = 2 * sum(left.values())
            if x[i] in left:
                total += math.log10((2 * left[x[i]] - 1) / all_)
                break
            total += math.log10(len(left) / all_)
            gone |= set(left)
        else:
            total -= math.log10(252 - len(gone))
    return total


def check_scores(got, rows, order):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    texts = [plain_bytes(t) for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    levels = plain_model(train, order)
    counts = Counter(w for t in train for w in t[:-1].split(b" ") if w)
    counts[b"\n"] = len(train)
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    want = defaultdict(list)
    for (i, _), t, h in zip(rows, texts, held):
        tokens = [w for w in t[:-1].split(b" ") if w] + [b"\n"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want[i].append((h, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, plain_score(levels, t, order)))
    have = defaultdict(list)
    for r in got:
        have[r.id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert have.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(have[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4], i
            assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9), i


@pytest.mark.parametrize("order", [0, 2, 5])
def test_ppm_equals_plain_scores(spark, order):
    rng = random.Random(order)
    words = ["the", "THEN", "other", "é", "mañana", "x", "zoo9", "a-b"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n\r\x0b\x0c "), (63, "😀 new word"), (64, "Q" * 50), (65, "the then"), (65, "the then"), (None, "null id"), (None, None)]
    df = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id bigint, text string, score double, chunk int").repartition(3)
    check_scores(ppm.scored(df, order=order).collect(), rows, order)


def test_ppm_whole_long_texts_and_small_chunks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") * rng.randint(1, 4) for _ in range(n))) for i, n in enumerate([4000, 1, 50, 3000, 0, 700])]
    rows.append((9, "x" * 5000))
    monkeypatch.setattr(ppm, "PIECE", 257)
    monkeypatch.setattr(ppm, "CHUNK", 4000)
    x = plain_bytes(rows[0][1])
    assert np.concatenate(list(ppm.slices(x))).tolist() == ppm.grams([x]).tolist()
    assert [w for ws in ppm.word_lists(x) for w in ws] == x[:-1].split(b" ")
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    check_scores(ppm.scored(df).collect(), rows, 5)


def test_ppm_probabilities_sum_to_one(spark):
    rows = [(1, "abab abc"), (3, "bca"), (4, "")]  # all three train
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    levels = plain_model([plain_bytes(t) for _, t in rows], 2)
    symbols = [s for s in range(256) if not 9 <= s <= 13] + [10]
    for prefix in (b"", b"a", b"ab", b"zz", b"a "):
        assert sum(10 ** (plain_score(levels, prefix + bytes([s]), 2) - plain_score(levels, prefix, 2)) for s in symbols) == pytest.approx(1)
    assert len(ppm.scored(df, order=2).collect()) == 3


def test_ppm_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ppm.scored(empty).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "some text") for i in held]
    got = ppm.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in got)
    assert all(r.score == pytest.approx(-10 * math.log10(252)) for r in got)


def test_longer_contexts_code_held_out_texts_better(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    totals = {}
    for order in (0, 4):
        got = ppm.scored(docs, order=order)
        r = got.where("held_out").agg(F.sum("score").alias("s"), F.count("*").alias("n")).first()
        totals[order] = r["s"]
    size = sum(len(plain_bytes(r.text)) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert -size * math.log10(252) < totals[0] < totals[4] < -size * 0.3


def test_ppm_query_equals_plain_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    check_scores(queries.op12_lm_score(spark, SF001).withColumnRenamed("doc_id", "id").collect(), rows, 5)


# ---- whitening -------------------------------------------------------------------

def check_whitening(got, rows, wanted=8, rel=1e-8):
    """``rows``: (id, vector) of one length, all sound."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - s for c, s in zip(r, sums)] for r in x]
    c = np.array(d, dtype=object).astype(float) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = int((value[:wanted] > 1e-12 * value.sum()).sum())
    assert len(got) == n * k
    have = defaultdict(list)
    for r in got:
        have[r.id].append(r)
    for i in {i for i, _ in rows}:
        exact = sorted(sum(v * v for v in d[j]) for j, (o, _) in enumerate(rows) if o == i for _ in range(k))
        assert sorted(int(r.deviation_exact) for r in have[i]) == exact
        assert all(r.deviation == (int(r.deviation_exact) if r.deviation_exact < 2 ** 63 else None) and r.n == n for r in have[i])
    for comp in range(1, k + 1):
        mine = [r for r in got if r.component == comp]
        assert len({r.explained for r in mine}) == 1 and mine[0].explained == pytest.approx(value[comp - 1] / value.sum(), rel=1e-9)
        assert all(r.identity_error < 1e-9 for r in mine)
        true = c @ vector[:, comp - 1] / math.sqrt(value[comp - 1])
        pairs = sorted(((i is None, i or 0, abs(w)) for (i, _), w in zip(rows, true)))
        assert [p[2] for p in sorted(((r.id is None, r.id or 0, abs(r.whitened)) for r in mine))] == pytest.approx([p[2] for p in pairs], rel=1e-5, abs=rel)
        if len({i for i, _ in rows}) == n:  # one sign for all rows
            by = {r.id: r.whitened for r in mine}
            w = np.array([by[i] for i, _ in rows])
            assert min(abs(w - true).max(), abs(w + true).max()) < 1e-7


def vectors(spark, rows, extra=True):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id bigint, embedding array<double>, component int, n string")


def test_whitening_query_equals_plain_eigenvectors(spark):
    got = queries.op11_whitening(spark, SF001).withColumnRenamed("vec_id", "id").collect()
    check_whitening(got, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()])


def test_whitening_by_the_filter(spark):
    """Forty dimensions and a block of ten: the polynomial has to work."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 40)) * np.linspace(3, 1, 40) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check_whitening(whitening.whitened(vectors(spark, rows).repartition(5), block=10).collect(), rows)


def test_leading_vectors_of_hard_spectra():
    rng = np.random.default_rng(2)
    for value in (np.linspace(2, 1, 60), np.r_[np.full(30, 5.0), np.full(30, 1.0)], 1 + 1e-5 * np.arange(60.0), np.r_[9.0, np.zeros(59)], 0.5 ** np.arange(60)):
        basis = np.linalg.qr(rng.standard_normal((60, 60)))[0]
        v = (basis * value) @ basis.T
        got, q = whitening.leading(lambda m, v=v: v @ m, 60, 8, block=12)
        assert got == pytest.approx(np.sort(value)[::-1][:8], abs=1e-10)
        assert np.abs(v @ q - q * got).max() < 1e-10 * value.max()
        assert np.abs(q.T @ q - np.eye(8)).max() < 1e-12


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (None, [1.0, -2.0, 0.5]), (4, [0.0, -0.0, 7.0]), (5, [-1.5, 2.0, 1e-3])]
    bad = [(6, None), (7, [None, 1.0, 2.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, []), (11, [-inf, 0.0, 1.0])]
    check_whitening(whitening.whitened(vectors(spark, good + bad)).collect(), good)
    assert whitening.whitened(vectors(spark, bad)).count() == 0
    assert whitening.whitened(vectors(spark, []).limit(0)).count() == 0
    assert whitening.whitened(vectors(spark, good[:2])).count() == 0  # no variance
    two = good + [(20, [1.0]), (21, [3.0])]  # lengths apart
    got = whitening.whitened(vectors(spark, two)).collect()
    check_whitening([r for r in got if r.id not in (20, 21)], good)
    assert sorted(abs(r.whitened) for r in got if r.id in (20, 21)) == pytest.approx([1, 1])
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    got = whitening.whitened(vectors(spark, huge)).collect()
    assert got and all(math.isfinite(r.whitened) for r in got) and any(r.deviation is None for r in got)


# ---- hard negatives --------------------------------------------------------------

def plain_negatives(rows, anchors, positives=5, negatives=3):
    """``rows``: (id, label, vector) that take part; ``anchors``: places."""
    dim = max(len(v) for _, _, v in rows)
    x = [[math.floor(256 * c) for c in v] + [0] * (dim - len(v)) for _, _, v in rows]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a in anchors:
        scored = [(sum(p * q for p, q in zip(x[a], x[b])), rows[b][0], rows[b][1]) for b in range(len(rows)) if b != a]
        for p, pid, _ in sorted((s for s in scored if s[2] == rows[a][1]), key=order)[:positives]:
            fit = [s for s in scored if s[2] != rows[a][1] and 50 * p <= 100 * s[0] <= 95 * p]
            for rank, (s, i, _) in enumerate(sorted(fit, key=order)[:negatives], 1):
                out.append((rows[a][0], pid, rank, i, p, s))
    return out


def key(t):
    return tuple((v is None, v or 0) for v in t)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()), key=key)


def table_of(spark, rows):
    return spark.createDataFrame([(i, y, v, 1, 2) for i, y, v in rows], "vec_id bigint, label int, embedding array<double>, rank int, key int")


@pytest.mark.parametrize("group", [4096, 7])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, group):
    """Groups of seven rows: heaps of many tasks merge, labels have many groups."""
    rng = np.random.default_rng(group)
    base = rng.standard_normal((4, 9))
    rows = [(i, int(y), (base[rng.integers(4)] + 0.7 * rng.standard_normal(9)).round(1).tolist()) for i, y in enumerate(rng.choice([1, 1, 1, 2, 3], 150))]
    rows += [(20, 1, rows[20][2]), (None, 1, rows[1][2]), (None, 2, rows[10][2]), (31, 2, [0.5, 1.5]), (32, 2, []), (40, 9, [1.0] * 9)]
    monkeypatch.setattr(hard_negatives, "LEAST_GROUP", group)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", group)
    monkeypatch.setattr(hard_negatives, "ANCHORS", group)
    bad = [(50, None, [1.0] * 9), (60, 1, None), (70, 1, [None] + [1.0] * 8), (80, 1, [float("nan")] * 9), (90, 2, [float("inf")] * 9)]
    want = sorted(plain_negatives(rows, [j for j, r in enumerate(rows) if r[0] is not None and r[0] % 10 == 0]), key=key)
    got = mined(table_of(spark, rows + bad).repartition(3))
    assert len(want) > 50 and got == want


def test_hard_negatives_ties_signs_and_empty(spark):
    rows = [(i, i % 2, [1.0, 0.0]) for i in range(40)]
    assert mined(table_of(spark, rows)) == []  # a negative as near as the positive lies above its window
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.95, 3.0]), (3, 2, [0.5, 0.0]), (4, 2, [0.5, 9.0]), (5, 2, [0.49, 0.0]), (6, 2, [0.951, 0.0]), (7, 2, [0.5, 1.0]),
            (10, 1, [-1.0, 0.0])]
    assert mined(table_of(spark, rows)) == sorted(plain_negatives(rows, [0, 8]), key=key)
    assert mined(table_of(spark, []).limit(0)) == [] and mined(table_of(spark, rows[:1])) == []


def test_hard_negatives_query_equals_brute_force(spark):
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, SF001).collect()), key=key)
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert got == sorted(plain_negatives(rows, [j for j, r in enumerate(rows) if r[0] % 50 == 0]), key=key)


def test_strassen_is_exact():
    rng = np.random.default_rng(5)
    for p, q, r in [(0, 3, 2), (1, 1, 1), (33, 70, 41), (64, 64, 64), (100, 33, 65), (129, 127, 131)]:
        for top in (10, 1 << 20, 1 << 27):
            a, b = rng.integers(-top, top, (p, q)), rng.integers(-top, top, (q, r))
            assert (hard_negatives.strassen(a, b, leaf=8) == a @ b).all()
