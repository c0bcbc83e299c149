"""Epoch-wise training against a plain numpy loop, its resume and its stop."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from genderlens.operators import epochs as E
from genderlens.sources import csv as C
from genderlens.sources import files

SETTINGS = E.Settings(lr=0.1, epochs=5, batches=3, warmup=0.2, metric_rows=8)


def texts(n, seed):
    rng = random.Random(seed)
    good, bad, some = ["god", "fin", "flot"], ["dårlig", "trist"], ["film", "og", "den", "er"]
    out = []
    for i in range(n):
        y = rng.randint(0, 1)
        out.append((i, " ".join(rng.choice((good if y else bad) + some * 2) for _ in range(rng.randint(0, 9))), y))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, y, "clash", 3) for i, t, y in rows], "ID long, text string, label int, word string, part int")


def plain_features(text):
    n = Counter(re.findall(r"\w+", text or ""))
    norm = math.sqrt(sum(c * c for c in n.values()))
    return {w: c / norm for w, c in n.items()} | {"": 1.0}


def weighted(pred, y):
    p = r = f = 0.0
    for c in (0, 1):
        sup, tp, pp = sum(y == c), sum((y == c) & (pred == c)), sum(pred == c)
        p += sup * (tp / pp if pp else 0)
        r += tp
        f += sup * (2 * tp / (pp + sup) if pp + sup else 0)
    return f / len(y), r / len(y), p / len(y)


def plain_loop(trainer, s, epochs):
    """The same training with dense arrays; batches as the trainer dealt them."""
    rows = {r.row: r for r in trainer.rows.collect()}
    xs = defaultdict(dict)
    for r in trainer.x.collect():
        xs[r.row][r.word] = r.x
    words = sorted({w for x in xs.values() for w in x})
    at = {w: i for i, w in enumerate(words)}
    dense = {k: np.array([x.get(w, 0.0) for w in words]) for k, x in xs.items()}
    w, m, v = (np.zeros(len(words)) for _ in range(3))
    fade_all = np.array([0.0 if x == "" else 1.0 for x in words])
    step, out = 0, []

    def figures(scored):
        by = defaultdict(list)
        for r, z in scored:
            by[r.part, r.chunk].append((z, r.label))
        each = []
        for pairs in by.values():
            z, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            pred = (z > 0).astype(int)
            loss = np.mean(np.logaddexp(0, np.where(y == 1, -z, z)))
            each.append((loss, np.mean(pred == y), *weighted(pred, y)))
        return np.mean(each, axis=0).tolist() if each else [None] * 5

    for _ in range(epochs):
        seen = []
        for part in range(s.batches):
            mine = [r for r in rows.values() if r.part == part]
            z = {r.row: float(dense[r.row] @ w) for r in mine}
            seen += [(r, z[r.row]) for r in mine]
            g = sum(((1 / (1 + math.exp(-z[r.row])) - r.label) / r.size * dense[r.row] for r in mine), np.zeros(len(words)))
            g = g * min(1.0, s.clip / (np.linalg.norm(g) + 1e-6))
            lr, t = E.rate(s, step), step + 1
            m = s.beta1 * m + (1 - s.beta1) * g
            v = s.beta2 * v + (1 - s.beta2) * g * g
            w = w * (1 - lr * s.decay * fade_all) - lr * (m / (1 - s.beta1 ** t)) / (np.sqrt(v / (1 - s.beta2 ** t)) + s.eps)
            step += 1
        val = [(r, float(dense[r.row] @ w)) for r in rows.values() if r.part == -1]
        out.append(figures(seen) + figures(val))
    assert at[""] == 0
    return out


def test_features(spark):
    rows = spark.createDataFrame([(0, "Den den fin_1"), (1, None), (2, ""), (3, "æ ø, æ")], "row long, text string")
    got = defaultdict(dict)
    for r in E.features(rows, "row", "text").collect():
        got[r.row][r.word] = r.x
    for i, t in [(0, "Den den fin_1"), (1, None), (2, ""), (3, "æ ø, æ")]:
        assert got[i] == pytest.approx(plain_features(t))


def test_rate_rises_and_falls():
    s = E.Settings(lr=1.0, epochs=5, batches=2, warmup=0.2)
    assert [round(E.rate(s, i), 3) for i in range(10)] == [0.0, 0.5, 1.0, 0.875, 0.75, 0.625, 0.5, 0.375, 0.25, 0.125]


def test_training_equals_a_plain_loop(spark):
    path = C.scratch_path(spark, "epochs")
    rows = texts(120, 1)
    odd = [(200, None, 1), (201, "", 0), (202, "uden mærke", None), (203, "andet", 7), (1, "god god", 1), (None, "fin", 1)]
    t = E.Trainer(frame(spark, rows[:80] + odd), frame(spark, rows[80:]), path, SETTINGS)
    got = [tuple(r)[1:] for r in t.run(3).orderBy("epoch").collect()]
    want = plain_loop(t, SETTINGS, len(got))
    assert len(got) >= 2
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    assert got[-1][0] < got[0][0]  # it learns


def test_training_resumes_after_the_last_written_epoch(spark):
    rows = texts(60, 2)
    train, val = frame(spark, rows[:40]), frame(spark, rows[40:])
    one, two = C.scratch_path(spark, "a"), C.scratch_path(spark, "b")
    s = E.Settings(lr=0.1, epochs=3, batches=2, patience=9)
    whole = E.train(train, val, one, s).orderBy("epoch").collect()
    assert [r.epoch for r in E.Trainer(train, val, two, s).run(1).collect()] == [1]
    # the second epoch left a model but no statistics: it is trained again
    spark.range(1).selectExpr("'x' as word", "1d as w", "0d as m", "0d as v").write.parquet(f"{two}/model/epoch=2")
    assert E.Trainer(train, val, two, s).done() == 1
    again = E.train(train, val, two, s).orderBy("epoch").collect()
    assert [r.epoch for r in again] == [1, 2, 3]
    for a, b in zip(whole, again, strict=True):
        assert tuple(a) == pytest.approx(tuple(b))
    before = files.names(spark, f"{two}/stats")
    E.train(train, val, two, s)
    assert files.names(spark, f"{two}/stats") == before  # nothing left to do


def test_training_stops_early_and_takes_empty_tables(spark):
    rows = texts(40, 3)
    noise = [(i, t, random.Random(i).randint(0, 1)) for i, t, _ in rows]
    s = E.Settings(lr=1.0, epochs=7, batches=1, patience=2, warmup=0.0)
    t = E.Trainer(frame(spark, rows[:30]), frame(spark, [(i, x, 1 - y) for i, x, y in rows[:30]]), C.scratch_path(spark, "stop"), s)
    got = t.run().orderBy("epoch").collect()
    best, waited = math.inf, 0
    for i, r in enumerate(got):  # fitted to wrong labels: the rule fires at the last epoch and not before
        better = r.val_loss < best - s.delta
        best, waited = (r.val_loss, 0) if better else (best, waited + 1)
        assert (waited >= s.patience) == (i == len(got) - 1)
    assert len(got) < s.epochs
    assert E.train(frame(spark, []).limit(0), frame(spark, noise), C.scratch_path(spark, "none"), s).count() == 0
    alone = E.Trainer(frame(spark, rows[:10]), frame(spark, []).limit(0), C.scratch_path(spark, "noval"), s).run(1).collect()
    assert len(alone) == 1 and alone[0].val_loss is None
    model = t.model(1)
    pred = E.predict(model, frame(spark, rows)).collect()
    assert len(pred) == 40 and np.mean([p.pred == y for p, (_, _, y) in zip(sorted(pred, key=lambda r: r.ID), rows)]) > 0.6


def test_search_records_each_trial_once(spark):
    rows = texts(50, 5)
    train, val, path = frame(spark, rows[:35]), frame(spark, rows[35:]), C.scratch_path(spark, "search")
    trials = E.draws(2, epochs=(1, 2))
    assert trials == E.draws(2, epochs=(1, 2)) and len({t.lr for t in trials}) == 2
    E.search(train, val, path, trials[:1])
    got = E.search(train, val, path, trials).orderBy("trial").collect()
    assert [r.trial for r in got] == [0, 1]
    for r, s in zip(got, trials, strict=True):
        assert r.warmup == s.warmup and r.params["lr"] == str(s.lr) and r.params["epochs"] == str(s.epochs)
        stats = E.Trainer(train, val, f"{path}/trial={r.trial}", s).stats().collect()
        assert r.best_val_loss == pytest.approx(min(x.val_loss for x in stats))


def test_logistic_search_does_not_depend_on_the_layout(spark):
    from genderlens.operators import ml
    df = frame(spark, texts(80, 6))
    one, many = (ml.search_params(spark, df.repartition(n), n_trials=2).orderBy("trial").collect() for n in (1, 5))
    assert [r.best_val_loss for r in one] == pytest.approx([r.best_val_loss for r in many], rel=1e-6)
    assert [r.maxIter for r in one] == [r.maxIter for r in many]
