"""Model training, search and end-to-end bias (M1, M10, whole study).

Naive Bayes has oracles: DuckDB counts and scores the same way. The Spark ML
pipeline (``*_logistic``) cannot be said in SQL; its rows are tested for their
shape."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.cleaning import label_encode
from ..operators import bias as B
from ..operators import epochs as E
from ..operators import metrics as M
from ..operators import ml
from ..operators import splits as S
from ..session import checkpoint_dir, sized
from .metric_queries import binary_sql
from .registry import register
from .split_queries import (DELETION_SQL, LABELLED_SQL, MASKED_SPLIT_SQL, SWAP_RESULT, augmented_from, key_sql, labelled_clean,
                            masked_split, swap_ctes, ws_sql)
from .clean_queries import clean_text_sql
from .term_queries import W_SQL
from ..sources import fixtures as fx

CONDITIONS = ["original", "neutral", "mix"]


def _condition_frames(spark, sf):
    ms = sized(masked_split(spark, sf).select("ID", "Sentiment", "split", "Review_cleaned", "text_all_male", "text_all_female",
                                              "text_all_neutral"))
    conds = S.condition_sets(ms).withColumn("label", label_encode("Sentiment"))
    mix = S.mix_set(ms).withColumn("label", label_encode("Sentiment"))
    train = {"original": conds.filter(F.col("condition") == "original_train"),
             "neutral": conds.filter(F.col("condition") == "neutral_train"),
             "mix": mix}
    tests = {"male": conds.filter(F.col("condition") == "all_male_test"),
             "female": conds.filter(F.col("condition") == "all_female_test")}
    return train, tests


def scored(spark, sf):
    """Predictions of every condition's model on both counterfactual test
    sets: (Model, Gender, ID, pred, label)."""
    train, tests = _condition_frames(spark, sf)
    models = ml.train_conditions(train, num_features=1 << 14, reg_param=0.01, max_iter=20)
    out = None
    for name, model in models.items():
        for gender, test in tests.items():
            p = ml.predict(model, test).select(F.lit(name).alias("Model"), F.lit(gender).alias("Gender"),
                                                "ID", "pred", "label")
            out = p if out is None else out.unionByName(p)
    return out


@register("train_conditions_logistic")
def q_train_conditions_logistic(spark, sf):
    return scored(spark, sf)


@register("search_params_logistic")
def q_search_params_logistic(spark, sf):
    return ml.search_params(spark, labelled_clean(spark, sf), n_trials=10, seed=123)


# ----------------------------------------------------------- naive Bayes
def nb_sql(train: str, texts: str, key: str, ids: str, alpha: float, name: str = "nb") -> str:
    """CTEs that end in ``{name}_pred(key, ids, pred)``."""
    on = " AND ".join(f"e.{c.strip()} = h.{c.strip()}" for c in [key, *ids.split(",")])
    return f"""{name}_tok AS (SELECT {key}, label, unnest(regexp_extract_all(text, '{W_SQL}+')) AS word FROM {train} WHERE label IN (0, 1)),
{name}_cnt AS (SELECT {key}, word, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0
               FROM {name}_tok GROUP BY {key}, word),
{name}_tot AS (SELECT {key}, sum(n1) AS t1, sum(n0) AS t0, count(*) AS v FROM {name}_cnt GROUP BY {key}),
{name}_w AS (SELECT c.{key}, word, ln((n1 + {alpha}::DOUBLE) / (t1 + {alpha}::DOUBLE * v)) - ln((n0 + {alpha}::DOUBLE) / (t0 + {alpha}::DOUBLE * v)) AS w
             FROM {name}_cnt c JOIN {name}_tot t ON c.{key} = t.{key}),
{name}_doc AS (SELECT {key}, count(*) FILTER (WHERE label = 1) AS d1, count(*) FILTER (WHERE label = 0) AS d0
               FROM {train} WHERE label IN (0, 1) GROUP BY {key}),
{name}_words AS (SELECT {ids}, unnest(regexp_extract_all(text, '{W_SQL}+')) AS word FROM {texts}),
{name}_hits AS (SELECT w.{key}, {ids}, sum(w.w) AS s FROM {name}_words x JOIN {name}_w w ON w.word = x.word GROUP BY w.{key}, {ids}),
{name}_pred AS (SELECT e.*, h.s, CASE WHEN d0 = 0 THEN 1 WHEN d1 = 0 THEN 0
                  ELSE (coalesce(h.s, 0) + ln(d1 / d0::DOUBLE) > 0)::INTEGER END::INTEGER AS pred
  FROM (SELECT t.*, d.* FROM {texts} t CROSS JOIN {name}_doc d) e LEFT JOIN {name}_hits h ON {on})"""


NB_SETS_SQL = MASKED_SPLIT_SQL + """,
mlab AS (SELECT *, CASE Sentiment WHEN 'pos' THEN 1 WHEN 'neg' THEN 0 END AS label FROM msplit),
nb_train AS (
  SELECT 'original' AS Model, Review_cleaned AS text, label FROM mlab WHERE split = 'train'
  UNION ALL SELECT 'neutral', text_all_neutral, label FROM mlab WHERE split = 'train'
  UNION ALL SELECT 'mix', text_all_male, label FROM mlab WHERE split = 'train'
  UNION ALL SELECT 'mix', text_all_female, label FROM mlab WHERE split = 'train'),
nb_test AS (
  SELECT 'male' AS Gender, ID, text_all_male AS text, label FROM mlab WHERE split = 'test'
  UNION ALL SELECT 'female', ID, text_all_female, label FROM mlab WHERE split = 'test'),
""" + nb_sql("nb_train", "nb_test", "Model", "Gender, ID", 1.0)


def nb_scored(spark, sf):
    """Naive-Bayes predictions of every condition's model on both
    counterfactual test sets: (Model, Gender, ID, pred, label). The masked
    texts are written once, as training and tests both read them."""
    ms = sized(masked_split(spark, sf).select("ID", "Sentiment", "split", "Review_cleaned", "text_all_male", "text_all_female",
                                              "text_all_neutral"))
    label = label_encode("Sentiment").alias("label")
    sets = S.condition_sets(ms).select("condition", "ID", "text", label)
    train = sets.where(F.col("condition").isin("original_train", "neutral_train")).select(
        F.regexp_replace("condition", "_train$", "").alias("Model"), "text", "label").unionByName(
        S.mix_set(ms).select(F.lit("mix").alias("Model"), "text", label))
    tests = sets.where(F.col("condition").isin("all_male_test", "all_female_test")).select(
        F.regexp_extract("condition", "^all_(.*)_test$", 1).alias("Gender"), "ID", "text", "label")
    pred = ml.bayes_predict(train, "Model", tests, ["Gender", "ID"])
    return pred.join(tests.select("Gender", "ID", "label"), ["Gender", "ID"]).select("Model", "Gender", "ID", "pred", "label")


@register("train_conditions", f"WITH {NB_SETS_SQL}\nSELECT Model, Gender, ID, pred, label FROM nb_pred")
def q_train_conditions(spark, sf):
    return nb_scored(spark, sf)


@register("bias_end_to_end", f"""WITH {NB_SETS_SQL},
pairs AS (SELECT Model, ID, max(pred) FILTER (WHERE Gender = 'male') - max(pred) FILTER (WHERE Gender = 'female') AS bias
          FROM nb_pred GROUP BY Model, ID),
b AS (SELECT Model, round(avg(bias::DOUBLE), 9) AS Total_Bias, round(avg(abs(bias)::DOUBLE), 9) AS Abs_Bias,
             round(avg((bias > 0)::INTEGER::DOUBLE), 9) AS Effect_Size FROM pairs GROUP BY Model),
m AS ({binary_sql('nb_pred', 'Model, Gender')})
SELECT m.*, b.Total_Bias, b.Abs_Bias, b.Effect_Size FROM m JOIN b ON m.Model = b.Model""")
def q_bias_end_to_end(spark, sf):
    preds = sized(nb_scored(spark, sf))  # scored once, read by both aggregates
    metrics = M.binary_metrics(preds, ["Model", "Gender"])
    bias = B.bias_summary(B.sample_bias(preds, ["Model"]), ["Model"])
    return metrics.join(bias, "Model")


# -------------------------------------------- the study's training composition
CHAIN_SQL = LABELLED_SQL + ",\n" + fx.PARAPHRASE_SQL + f""",
lab AS (SELECT ID, {clean_text_sql('text')} AS t, label FROM labelled),
ls AS (SELECT ID, t, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {key_sql('ID')}, ID) - 1
              < ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM lab),
head AS (SELECT ID, t, label FROM ls WHERE split = 'train' ORDER BY {key_sql('ID')}, ID LIMIT 250),
b AS (SELECT h.ID, h.t, h.label, p.paraphrase, {ws_sql('h.t')} AS ws FROM head h LEFT JOIN paraphrase p ON h.ID = p.ID),
{swap_ctes()},
chain_train AS (
  SELECT 'chain' AS Model, t AS text, label FROM ls WHERE split = 'train'
  UNION ALL SELECT 'chain', paraphrase, label FROM b WHERE paraphrase IS NOT NULL AND length(t) <= 5000
  UNION ALL SELECT 'chain', {DELETION_SQL}, label FROM b
  UNION ALL SELECT 'chain', sw.stext, b.label FROM (SELECT ID, {SWAP_RESULT} AS stext FROM w5) sw JOIN b ON b.ID = sw.ID),
chain_val AS (SELECT ID, t AS text, label FROM ls WHERE split = 'test'),
""" + nb_sql("chain_train", "chain_val", "Model", "ID", 1.0, "ch")


def training_chain(spark, sf):
    """Q2 -> Q5 -> Q8 -> Q9 -> M1: stratified split, augmentation of the first
    250 training rows, appended and shuffled, a fit, and predictions on the
    held-out rows."""
    ls = sized(S.stratified_split(labelled_clean(spark, sf), "label", "ID"))
    train = ls.where(F.col("split") == "train")
    extra = augmented_from(spark, sf, S.head_subset(train.select("ID", "text", "label"), "ID", 250))
    rows = train.select("ID", F.lit("orig").alias("kind"), "text", "label").unionByName(extra)
    rows = S.seeded_shuffle(rows, F.concat_ws(":", F.col("ID").cast("string"), "kind"))
    val = ls.where(F.col("split") == "test").select("ID", "text", "label")
    pred = ml.bayes_predict(rows.select(F.lit("chain").alias("Model"), "text", "label"), "Model", val.select("ID", "text"), ["ID"])
    return pred.join(val.select("ID", "label"), "ID")


@register("training_chain", f"WITH {CHAIN_SQL}\nSELECT Model, ID, pred, label FROM ch_pred")
def q_training_chain(spark, sf):
    return training_chain(spark, sf).select("Model", "ID", "pred", "label")


@register("training_chain_metrics", f"WITH {CHAIN_SQL},\nm AS ({binary_sql('ch_pred', 'Model')})\nSELECT * FROM m")
def q_training_chain_metrics(spark, sf):
    return M.binary_metrics(training_chain(spark, sf), ["Model"])


EPOCHS = E.Settings(epochs=6, batches=2)


@register("training_epochs")
def q_training_epochs(spark, sf):
    """M1 with M7-M9: training and validation figures of every epoch up to the
    early stop, on the stratified split of the labelled texts."""
    ls = sized(S.stratified_split(labelled_clean(spark, sf), "label", "ID"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/training-{uuid.uuid4().hex}"
    got = E.train(ls.where(F.col("split") == "train"), ls.where(F.col("split") == "test"), path, EPOCHS)
    return got.select("epoch", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


#: Trials of a search.
TRIALS = 10


@register("trial_records")
def q_trial_records(spark, sf):
    """The search's ten trials of the epoch-wise trainer, of 2 to 15
    epochs each, recorded by an append each; settings as a sorted list of
    name=value."""
    ls = sized(S.stratified_split(labelled_clean(spark, sf), "label", "ID"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    got = E.search(ls.where(F.col("split") == "train"), ls.where(F.col("split") == "test"), path, E.draws(TRIALS))
    entries = F.array_sort(F.map_entries("params"))
    return got.select("trial", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("params"),
                      F.round("best_val_loss", 6).alias("best_val_loss"), "warmup")


ALPHAS = ml.smoothing_draws()


def _search_sql() -> str:
    fits = ",\n".join(nb_sql("st", "sv", "Model", "ID", a, f"a{i}") for i, a in enumerate(ALPHAS))
    losses = "\nUNION ALL ".join(
        f"SELECT {i} AS trial, {a}::DOUBLE AS alpha, round(avg(greatest(-m, 0.0) + ln(1 + exp(-abs(m)))), 6) AS val_loss FROM "
        f"(SELECT CASE WHEN label = 1 THEN 1 ELSE -1 END * (coalesce(s, 0) + ln(d1 / d0::DOUBLE)) AS m FROM a{i}_pred)"
        for i, a in enumerate(ALPHAS))
    return f"""WITH {LABELLED_SQL},
lab AS (SELECT ID, {clean_text_sql('text')} AS text, label FROM labelled),
ls AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {key_sql('ID')}, ID) - 1
              < ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM lab),
st AS (SELECT 'fit' AS Model, text, label FROM ls WHERE split = 'train'),
sv AS (SELECT ID, text, label FROM ls WHERE split = 'test'),
{fits}
{losses}"""


@register("search_params", _search_sql())
def q_search_params(spark, sf):
    ls = sized(S.stratified_split(labelled_clean(spark, sf), "label", "ID"))
    return ml.bayes_search(ls, ALPHAS)
