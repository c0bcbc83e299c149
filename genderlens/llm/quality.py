"""Quality classifier: naive-Bayes support vectors.

Features are indicators of n-grams: words, and one- to three-word n-grams of
word shapes (runs of lower case, capitals and digits are one sign each,
punctuation stays, a word that repeats one of the two before it is marked),
shares of a shape among the words, and bins of length and vocabulary. They
are hashed into ``2 ** BITS`` slots. Each indicator is scaled by the class
log-count ratio of its slot, rows have unit scale, and a linear hinge-loss
model is fitted by dual coordinate descent; a logistic curve fitted on rows
held back from the descent turns margins into scores.

The model is fitted on a bounded sample of labelled rows (``sample`` rows, in
the order of a hash of the id); scoring covers every row, whole texts, without
a shuffle.

Defined results: a null text counts as empty; an empty text is scored by its
length bin and the constant; repeated rows are scored alike; labels that are
null or not 0/1 are not learned from; without labels of both classes every
score is the share of label 1 (0.5 without labels); an empty table gives an
empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, utf8_chunks

BITS = 18
SAMPLE = 6000
_R = 0x5851F42D4C957F2D | 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: its shape sign (0 for white space) and its lower case."""
    sign, low = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    sign[ord("a"):ord("z") + 1] = ord("x")
    sign[ord("A"):ord("Z") + 1] = ord("X")
    sign[ord("0"):ord("9") + 1] = ord("0")
    sign[128:] = ord("x")
    sign[[32, *range(9, 14)]] = 0
    low[ord("A"):ord("Z") + 1] += 32
    return sign, low


SIGN, LOWER = _classes()


def _span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever the span stands."""
    up = _powers(_R, codes.size + 1)
    down = _powers(pow(_R, -1, 1 << 64), codes.size + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + _U(1)) * up[:-1], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * down[starts]
    return h ^ (h >> _U(31))


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, slot)`` of every indicator that is set, each once, in the
    order of the documents."""
    n_docs = len(bounds) - 1
    sign = SIGN[data]
    edge = np.zeros(data.size + 1, bool)
    edge[bounds] = True
    full = sign != 0
    prior = np.concatenate(([False], full[:-1])) if data.size else full
    start = np.flatnonzero(full & (~prior | edge[:-1]))
    after = np.concatenate((full[1:], [False])) if data.size else full
    end = np.flatnonzero(full & (~after | edge[1:])) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    words = np.bincount(doc, minlength=n_docs)
    word = _span_hash(LOWER[data], start, end)
    change = full & (np.concatenate(([True], sign[1:] != sign[:-1])) if data.size else full)
    change[start] = True
    seen = np.concatenate(([0], np.cumsum(change)))
    shape = _span_hash(sign[change], seen[start], seen[end])
    for back in (1, 2):
        again = np.zeros(word.size, bool)
        again[back:] = (word[back:] == word[:-back]) & (doc[back:] == doc[:-back])
        shape = np.where(again, shape * _MIX + _U(back), shape)
    keys, docs = [word * _MIX + _U(1), shape * _MIX + _U(2)], [doc, doc]
    gram = shape
    for back in (1, 2):
        gram = gram[1:] * _MIX + shape[back:]
        inside = doc[back:] == doc[:-back]
        docs.append(doc[back:][inside])
        keys.append(gram[inside] * _MIX + _U(2 + back))
    # shares of a shape among the words of its document
    order = np.lexsort((shape, doc))
    new = np.concatenate(([True], (shape[order][1:] != shape[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if doc.size else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [doc.size])))
    of = doc[order][first]
    share = (8 * count) // np.maximum(words[of], 1)
    keys.append(((shape[order][first] * _MIX + _U(5)) + share.astype(np.uint64)) * _MIX)
    docs.append(of)
    # length and vocabulary bins of each document
    pair = np.unique((doc.astype(np.uint64) << _U(40)) | (word & _U((1 << 40) - 1)))
    vocabulary = np.bincount((pair >> _U(40)).astype(np.int64), minlength=n_docs)
    every = np.arange(n_docs)
    keys.append((np.log2(words + 1.0).astype(np.uint64) + _U(1000)) * _MIX)
    keys.append(((10 * vocabulary) // np.maximum(words, 1)).astype(np.uint64) * _MIX + _U(7))
    docs += [every, every]
    slot = np.concatenate(keys)
    slot = (slot ^ (slot >> _U(29))) * _MIX >> _U(64 - BITS)
    both = np.unique((np.concatenate(docs).astype(np.uint64) << _U(BITS)) | slot)
    return (both >> _U(BITS)).astype(np.int64), (both & _U((1 << BITS) - 1)).astype(np.int64)


def margins(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray, constant: float) -> np.ndarray:
    """Margin of each document under slot ``weights``."""
    n = len(bounds) - 1
    doc, slot = features(data, bounds)
    total = np.bincount(doc, weights=weights[slot], minlength=n)
    size = np.bincount(doc, minlength=n)
    return total / np.sqrt(np.maximum(size, 1)) + constant


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of each slot's share of the indicators of class 1
    to that of class 0."""
    n = 1 << BITS
    side = [np.ones(n) + sum((np.bincount(r, minlength=n) for r, l in zip(rows, y, strict=True) if l == c), np.zeros(n)) for c in (1, 0)]
    return np.log(side[0] / side[0].sum()) - np.log(side[1] / side[1].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, epochs: int = 12, cost: float = 1.0,
                 seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model over scaled unit rows by dual coordinate
    descent; classes weigh alike. Returns slot weights and the constant."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    top = cost * 0.5 / np.maximum(share[y], 1e-9)
    xs = [ratios[r] / np.sqrt(max(1, r.size)) for r in rows]
    q = np.array([float(x @ x) + 1.0 for x in xs])
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            r, x = rows[i], xs[i]
            slope = sign[i] * (float(w[r] @ x) + b) - 1.0
            new = min(max(alpha[i] - slope / q[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * x
                b += step
                alpha[i] = new
    return w * ratios, b


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1 | margin) by Newton steps on smoothed targets."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-6 * a, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1e-6, b)


def learn(sample: DataFrame) -> dict:
    """Fit the model on ``sample(text, label, back)``; rows with ``back``
    only fit the logistic curve. The sample's indicators come to the driver:
    its size must be bounded by the caller."""
    def run(batches):
        for b in batches:
            rows: list[np.ndarray] = []
            for _, data, bounds in utf8_chunks(b.column(0)):
                doc, slot = features(data, bounds)
                rows += np.split(slot.astype(np.int32), np.searchsorted(doc, np.arange(1, len(bounds) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), b.column(1), b.column(2)],
                                             names=["slots", "label", "back"])

    got = sample.select("text", F.col("label").cast("int").alias("label"), "back").mapInArrow(
        run, "slots binary, label int, back boolean").collect()
    got.sort(key=lambda r: bytes(r["slots"]))  # the order of the rows must not matter
    y = np.array([r["label"] for r in got], np.int64)
    back = np.array([r["back"] for r in got], bool)
    rows = [np.frombuffer(r["slots"], np.int32) for r in got]
    fit = [r for r, b in zip(rows, back, strict=True) if not b]
    y_fit = y[~back] if y.size else y
    if not y.size or len(set(y_fit.tolist())) < 2:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if y.size else 0.5
        return {"weights": np.zeros(1 << BITS, np.float32), "constant": 0.0, "curve": (1.0, float(np.log(p / (1 - p))))}
    ratios = log_count_ratios(fit, y_fit)
    weights, constant = dual_descent(fit, y_fit, ratios)
    use = back if len(set(y[back].tolist())) == 2 else ~back
    m = np.array([weights[r].sum() / np.sqrt(max(1, r.size)) + constant for r, u in zip(rows, use, strict=True) if u])
    return {"weights": weights.astype(np.float32), "constant": constant, "curve": logistic_curve(m, y[use])}


def scored(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with its columns and a score between 0 and 1."""
    keep = [c for c in docs.columns if c != score_col]
    at = keep.index(text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the data

    def run(batches):
        m = shared.value
        a, c = m["curve"]
        for b in batches:
            out = [np.zeros(0)]
            for _, data, bounds in utf8_chunks(b.column(at)):
                z = a * margins(data, bounds, m["weights"], m["constant"]) + c
                out.append(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], names=[*keep, score_col])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep).mapInArrow(run, f"{types}, `{score_col}` double")


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed, size: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, label, back)``: at most ``size`` labelled rows, those with the
    smallest hash of the id; a fifth of them, by another hash, is held back.
    The chosen ids are at most ``size`` rows and are broadcast, so texts are
    not shuffled."""
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    lab = lab.where("label in (0, 1) and __id is not null").where(allowed(F.col("__id")))
    chosen = lab.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("__id"), F.lit(1)), "__id").limit(size)
    own = docs.select(F.col(id_col).alias("__own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = own.join(F.broadcast(chosen), F.col("__own") == F.col("__id"))
    return joined.select("text", "label", (F.pmod(F.xxhash64(F.col("__id"), F.lit(2)), F.lit(5)) == 0).alias("back"))


def crc_fold(modulus: int, held: int):
    """A predicate that keeps ids outside the held-out fold."""
    return lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus != held


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7, modulus: int = 4,
             held: int = 2, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from
    ``threshold`` on). Fits the model first (one job)."""
    model = learn(labelled_sample(docs, labels, label_col, crc_fold(modulus, held), sample, id_col, text_col))
    out = scored(docs, model, text_col)
    return out.withColumns({"held_out": crc_rest(id_col, modulus) == held,
                            "predicted": (F.col("score") >= threshold).cast("int")})
