"""Sentiment classifiers per training condition (M1, M10): multinomial naive
Bayes as plain aggregations and joins, and a Spark ML pipeline.

Naive Bayes is fitted for all conditions at once by counting (condition, word)
per class with partial aggregation, and scores a text by joining its counted
words with the word weights. Nothing but the result leaves the cluster; the
tables of weights are written once and broadcast only if small. Rows without
a label are not training data. A condition with rows of one class only
predicts that class; one without rows predicts nothing.

The transformer fine-tuning of the study is re-aimed at a distributed Spark
ML pipeline (tokenise -> hashed term frequencies -> IDF -> logistic
regression). Fitting runs as Spark jobs (tree aggregation of gradients);
only model coefficients and the 10 search scores reach the driver."""

from __future__ import annotations

import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import argmax
from ..functions.text import W, word_runs
from ..session import sized
from .splits import split

TOKEN = W + "+"


def bayes_weights(train: DataFrame, key: str, alphas: list[float], text: str = "text",
                  label: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(key, word, w array)`` and ``(key, prior, d0, d1)`` for labels 0/1;
    one weight per smoothing value. Runs jobs; both are written tables."""
    rows = train.where(F.col(label).isin(0, 1))
    one, none = F.col(label) == 1, F.col(label) == 0
    counts = rows.select(key, label, F.explode(word_runs(text)).alias("word")).groupBy(key, "word").agg(
        F.count(F.when(one, 1)).alias("n1"), F.count(F.when(none, 1)).alias("n0"))
    counts = sized(counts)
    total = counts.groupBy(key).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"), F.count("*").alias("v"))
    x = counts.join(total, key)

    def weight(a):
        side = [F.log((F.col(f"n{c}") + F.lit(a)) / (F.col(f"t{c}") + F.lit(a) * F.col("v"))) for c in (1, 0)]
        return side[0] - side[1]

    weights = sized(x.select(key, "word", F.array(*[weight(a) for a in alphas]).alias("w")))
    priors = rows.groupBy(key).agg(F.count(F.when(one, 1)).alias("d1"), F.count(F.when(none, 1)).alias("d0"))
    return weights, sized(priors.withColumn("prior", F.when((F.col("d1") > 0) & (F.col("d0") > 0), F.log(F.col("d1") / F.col("d0")))))


def bayes_scores(weights: DataFrame, priors: DataFrame, key: str, texts: DataFrame, ids: list[str], text: str = "text",
                 n: int = 1) -> DataFrame:
    """``(key, *ids, score array)``: log odds of label 1 for every text under
    every condition. Words are counted per text before the join."""
    words = texts.select(*ids, F.explode(word_runs(text)).alias("word")).groupBy(*ids, "word").agg(F.count("*").alias("n"))
    hits = words.join(weights, "word").groupBy(key, *ids).agg(
        *[F.sum(F.col("n") * F.col("w")[i]).alias(f"s{i}") for i in range(n)])
    every = _with_conditions(texts.select(*ids), priors)
    out = every.join(hits, [key, *ids], "left")
    score = F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + F.coalesce("prior", F.lit(0.0)) for i in range(n)])
    return out.select(key, *ids, "d0", "d1", score.alias("score"))


def _with_conditions(ids: DataFrame, priors: DataFrame) -> DataFrame:
    """Each text once per condition; the conditions are a handful of rows,
    held as one array."""
    held = priors.agg(F.collect_list(F.struct(*priors.columns)).alias("c")).withColumn("__one", F.lit(1))
    x = ids.withColumn("__one", F.lit(1)).join(F.broadcast(held), "__one")
    return x.select(*ids.columns, F.inline("c"))


def bayes_predict(train: DataFrame, key: str, texts: DataFrame, ids: list[str], alpha: float = 1.0) -> DataFrame:
    """``(key, *ids, pred)``: label 1 if its log odds are above zero (label 0
    on ties), the only class if the condition has one."""
    weights, priors = bayes_weights(train, key, [alpha])
    s = bayes_scores(weights, priors, key, texts, ids)
    pred = F.when(F.col("d0") == 0, 1).when(F.col("d1") == 0, 0).otherwise((F.col("score")[0] > 0).cast("int"))
    return s.select(key, *ids, pred.cast("int").alias("pred"))


def smoothing_draws(n_trials: int = 10, seed: int = 123) -> list[float]:
    """Seeded log-uniform draws of the smoothing value."""
    rng = random.Random(seed)
    return [round(math.exp(rng.uniform(math.log(1e-2), math.log(10.0))), 6) for _ in range(n_trials)]


def bayes_search(split: DataFrame, alphas: list[float], id_col: str = "ID") -> DataFrame:
    """One row per trial (trial, alpha, val_loss): mean log-loss on
    the 'test' rows of ``split`` (ID, text, label, split) after a fit on the
    others. All trials share one count and one scoring pass."""
    x = split.withColumn("__fit", F.lit("fit")).where(F.col("label").isin(0, 1))
    val = x.where(F.col("split") == "test")
    weights, priors = bayes_weights(x.where(F.col("split") == "train"), "__fit", alphas)
    s = bayes_scores(weights, priors, "__fit", val.select(id_col, "text"), [id_col], n=len(alphas)).join(
        val.select(id_col, "label"), id_col)

    def loss(z):
        m = F.when(F.col("label") == 1, z).otherwise(-z)
        return F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))

    means = s.agg(*[F.round(F.avg(loss(F.col("score")[i])), 6).alias(f"l{i}") for i in range(len(alphas))])
    rows = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(a).alias("alpha"), F.col(f"l{i}").alias("val_loss"))
                     for i, a in enumerate(alphas)])
    return means.select(F.inline(rows))


def sentiment_pipeline(num_features: int = 1 << 14, reg_param: float = 0.01, max_iter: int = 20,
                       text: str = "text", label: str = "label") -> Pipeline:
    tok = RegexTokenizer(inputCol=text, outputCol="tokens", pattern=TOKEN, gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    idf = IDF(inputCol="tf", outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg_param, maxIter=max_iter)
    return Pipeline(stages=[tok, tf, idf, lr])


def fit(train: DataFrame, **params) -> PipelineModel:
    """Fit on rows with a label (null labels are not training data)."""
    data = train.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    return sentiment_pipeline(**params).fit(data)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``pred`` (argmax of the raw scores, first index on ties)."""
    out = model.transform(df.withColumn("text", F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn("pred", argmax(vector_to_array("rawPrediction"))).drop(
        "tokens", "tf", "features", "rawPrediction", "probability", "prediction")


def train_conditions(train_sets: dict[str, DataFrame], **params) -> dict[str, PipelineModel]:
    """M1: one model per training condition (a loop over conditions, each
    fit a distributed job)."""
    return {name: fit(df, **params) for name, df in train_sets.items()}


def random_param_maps(pipeline: Pipeline, n_trials: int = 10, seed: int = 123):
    """``n_trials`` seeded draws over regularisation (log-uniform),
    feature-space size and iteration budget."""
    lr, tf = pipeline.getStages()[3], pipeline.getStages()[1]
    rng = random.Random(seed)
    maps = []
    for _ in range(n_trials):
        maps.append({lr.regParam: math.exp(rng.uniform(math.log(1e-4), math.log(1.0))),
                     tf.numFeatures: rng.choice([1 << 12, 1 << 14]),
                     lr.maxIter: rng.randint(2, 15)})
    return maps


def search_params(spark: SparkSession, train: DataFrame, n_trials: int = 10, seed: int = 123, id_col: str = "ID") -> DataFrame:
    """Seeded random search minimising validation log-loss; returns
    one row per trial. The 70/30 split goes by the key hash, so the result does
    not depend on how the rows are laid out."""
    data = train.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    data = sized(split(data, id_col, 0.3, seed))
    pipe = sentiment_pipeline()
    tok, tf, idf, lr = pipe.getStages()
    data = sized(tok.transform(data).select("tokens", "label", "split"))  # cut once for all trials
    fitted, held = data.where("split = 'train'"), data.where("split = 'test'")
    trial = Pipeline(stages=[tf, idf, lr])
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="logLoss")
    rows = []
    for i, m in enumerate(random_param_maps(pipe, n_trials, seed)):
        loss = ev.evaluate(trial.fit(fitted, m).transform(held))
        rows.append((i, float(m[lr.regParam]), int(m[tf.numFeatures]), int(m[lr.maxIter]), float(loss)))
    return spark.createDataFrame(rows, "trial int, regParam double, numFeatures int, maxIter int, "
                                       "best_val_loss double")
