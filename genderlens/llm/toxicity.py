"""Toxicity scores: gradient-boosted trees over dense features, calibrated by
isotonic regression.

Features of a whole text: density, weight and variety of lexicon words, how
near second-person words stand to them, capitals, punctuation, and tokens that
hide a word (digits or signs for letters, signs between letters, stretched or
spaced letters). The lexicon is a short fixed list plus words learned from
the labelled sample: those whose document counts in toxic and other texts
differ beyond chance (likelihood-ratio statistic), and word beginnings that
do so when several words of a text share them, as inflected insults do.

The model is fitted on a bounded sample of labelled rows (``sample`` rows in
the order of a hash of the id); a fifth of them is held back for the isotonic
curve. Scoring covers every row, whole texts, without a shuffle.

Defined results: a null text counts as empty; an empty text is scored like
any other; repeated rows are scored alike; labels that are null or not 0/1
are not learned from; without labels of both classes every score is the
share of label 1 (0 without labels); an empty table gives an empty result."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, cut, small
from .quality import crc_fold, labelled_sample

SAMPLE = 20_000
LEXICON_WORDS = 3000
#: Likelihood-ratio statistic from which a word enters the lexicon.
SURE = 20.0
#: The same for word beginnings, and their lengths.
SURE_STEM = 15.0
STEMS = (4, 6)
NEAR = 5

# Insults and second-person words.
INSULTS = (
    "asshole bastard bitch clown cretin cunt degenerate dickhead disgusting dumbass fool freak fuck fucking garbage "
    "idiot idiotic imbecile jerk loser lowlife moron moronic motherfucker pathetic pig prick retard scum scumbag "
    "shit slut stupid trash twat vermin whore worthless "
    "arschloch abschaum blödmann depp dummkopf hurensohn schlampe scheiße trottel vollidiot wichser "
    "connard connasse crétin débile enculé merde ordure pute salaud salope "
    "basura cabrón estúpido gilipollas imbécil mierda pendejo puta").split()
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deiner ihr euch euer "
    "tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

WORD = re.compile(r"\w+")
MIXED = re.compile(r"[^\W\d_]+(?:[@$!|*0134579.\-_+~]+[^\W\d_]+)+")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
STRETCHED = re.compile(r"(\w)\1{2,}")
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "9": "g", "@": "a", "$": "s",
                       "!": "i", "|": "l", ".": None, "-": None, "_": None, "+": None, "~": None})

FEATURES = ("hit_density", "weight_density", "variety", "log_hits", "top_weight", "second_person", "near_share",
            "near_density", "capitals", "capital_words", "exclamations", "questions", "punctuation", "hidden",
            "hidden_hits", "stem_density", "stem_variety", "log_words")


def unhidden(token: str, lexicon: dict[str, float]) -> float:
    """Weight of the lexicon word that ``token`` hides, 0 if none."""
    t = token.lower().translate(SIGNS)
    for x in (t, STRETCHED.sub(r"\1", t), STRETCHED.sub(r"\1\1", t), t.replace("*", "")):
        if x in lexicon:
            return lexicon[x]
    if "*" in t and t.strip("*") and len(t) > 2:
        shape = re.compile(t.replace("*", r"\w") + r"\Z")
        return max((w for word, w in lexicon.items() if shape.match(word)), default=0.0)
    return 0.0


def stems_of(words: set[str]) -> set[str]:
    """Beginnings (marked by a final hyphen) that two or more of the words
    share; a word is longer than its beginning."""
    count = Counter(w[:n] for w in words for n in STEMS if len(w) > n)
    return {x + "-" for x, c in count.items() if c > 1}


def describe(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n = max(len(words), 1)
    hits = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    hidden = MIXED.findall(text) + SPACED.findall(text)
    found = [w for t in hidden if (w := unhidden(t.replace(" ", ""), lexicon))]
    if STRETCHED.search(low):
        for i, w in enumerate(words):
            if w not in lexicon and len(w) > 3 and STRETCHED.search(w):
                hidden.append(w)
                if x := unhidden(w, lexicon):
                    found.append(x)
    a, b = STEMS
    stemmed = [w for w in words if w[:b] + "-" in lexicon or w[:a] + "-" in lexicon]
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and persons:
        at = np.array(persons)
        spot = np.array([i for i, _ in hits])
        j = np.searchsorted(at, spot)
        gap = np.minimum(np.abs(at[np.minimum(j, at.size - 1)] - spot), np.abs(at[np.maximum(j - 1, 0)] - spot))
        near = int((gap <= NEAR).sum())
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(int(raw.sum()), 1)
    capitals = int(raw[65:91].sum())
    total = sum(w for _, w in hits) + sum(found)
    count = len(hits) + len(found)
    shout = sum(1 for t in text.split() if len(t) > 1 and t.isupper()) if capitals else 0
    return [count / n, total / n, len({words[i] for i, _ in hits}) / n, math.log1p(count),
            max([w for _, w in hits] + found, default=0.0), len(persons) / n, near / max(len(hits), 1), near / n,
            capitals / size, shout / n, int(raw[33]) / n, int(raw[63]) / n,
            int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / size,
            len(hidden) / n, len(found) / n, len(stemmed) / n, len(set(stemmed)) / n, math.log1p(len(words))]


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """Weights of the fixed list and of the words that tell the labels of
    ``sample(text, label)`` apart. Words are counted once per document and
    pre-aggregated per batch; at most ``LEXICON_WORDS`` reach the driver."""
    def run(batches):
        for b in small(batches, 0):
            sides = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                sides[label].update(words | stems_of(words))
            words = list(sides[0].keys() | sides[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([sides[1][w] for w in words], pa.int64()),
                                              pa.array([sides[0][w] for w in words], pa.int64())], names=["word", "toxic", "other"])

    size = sample.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    lexicon = {w: 3.0 for w in INSULTS}
    n_t, n_o = int(size["t"] or 0), int(size["n"] - (size["t"] or 0))
    if not n_t or not n_o:
        return lexicon
    counts = sample.select("text", "label").mapInArrow(run, "word string, toxic bigint, other bigint")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).where("t > 2")
    share = F.lit(n_t / (n_t + n_o))
    n = F.col("t") + F.col("o")
    sure = 2 * (F.col("t") * F.log(F.col("t") / (n * share))
                + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / (n * (1 - share)))).otherwise(0.0))
    weight = F.log((F.col("t") + 0.5) / n_t) - F.log((F.col("o") + 0.5) / n_o)
    enough = F.when(F.col("word").endswith("-"), SURE_STEM).otherwise(SURE)
    best = counts.select("word", sure.alias("sure"), weight.alias("weight")).where((F.col("sure") >= enough) & (F.col("weight") > 1))
    for r in best.orderBy(F.desc("sure"), "word").limit(LEXICON_WORDS).collect():
        lexicon[r["word"]] = float(r["weight"])
    return lexicon


def featured(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text", out: str = "__features") -> DataFrame:
    """``docs`` with its columns and the dense feature vector."""
    keep = [c for c in docs.columns if c != out]
    at = keep.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_WORDS and the fixed list

    def run(batches):
        lex = shared.value
        for b in small(batches, at):
            rows = [describe(t, lex) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*keep, out])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    made = docs.select(*keep).mapInArrow(run, f"{types}, `{out}` array<double>")
    return made.withColumn(out, array_to_vector(F.col(out)))


class Model:
    """Lexicon, trees and curve; ``trees`` is None without two classes."""

    def __init__(self, lexicon, trees, curve, share):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def score(self, docs: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` with its columns and a score between 0 and 1."""
        keep = [F.col(f"`{c}`") for c in docs.columns if c != score_col]
        if self.trees is None:
            return docs.select(*keep, F.lit(self.share).alias(score_col))
        made = self.curve.transform(_raw(self.trees.transform(featured(docs, self.lexicon, text_col))))
        # the curve alone is a step function: the raw score orders its ties
        score = 0.98 * F.col("__iso") + 0.02 * F.col("__raw")
        return made.select(*keep, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias(score_col))


def _raw(df: DataFrame) -> DataFrame:
    return df.withColumn("__raw", vector_to_array("__probability")[1])


def learn(sample: DataFrame, trees: int = 20, depth: int = 4) -> Model:
    """Fit on ``sample(text, label, back)``; rows with ``back`` fit only the
    isotonic curve. The size must be bounded by the caller."""
    fit = cut(sample)
    share = fit.agg(F.avg("label").alias("p")).first()["p"] or 0.0
    lexicon = learned_lexicon(fit.where("not back"))
    classes = fit.where("not back").select("label").distinct().count()
    if classes < 2:
        return Model(lexicon, None, None, float(share))
    rows = cut(featured(fit, lexicon).select("__features", F.col("label").cast("double").alias("label"), "back"))
    boosted = GBTClassifier(featuresCol="__features", labelCol="label", predictionCol="__predicted", maxIter=trees,
                            maxDepth=depth, stepSize=0.2, minInstancesPerNode=3, seed=17)
    boosted.setProbabilityCol("__probability").setRawPredictionCol("__margin")
    model = boosted.fit(rows.where("not back").drop("back").coalesce(8))
    back = rows.where("back")
    back = back if back.select("label").distinct().count() == 2 else rows
    iso = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__iso")
    return Model(lexicon, model, iso.fit(_raw(model.transform(back)).select("__raw", "label")), float(share))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.5, modulus: int = 5,
             held: int = 0, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from
    ``threshold`` on). Fits the model first (several jobs)."""
    model = learn(labelled_sample(docs, labels, label_col, crc_fold(modulus, held), sample, id_col, text_col))
    out = model.score(docs, text_col)
    return out.withColumns({"held_out": crc_rest(id_col, modulus) == held,
                            "predicted": (F.col("score") >= threshold).cast("int")})
