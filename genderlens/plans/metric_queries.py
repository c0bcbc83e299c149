"""Prediction, metric, training-statistics and bias queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias as B
from ..operators import metrics as M
from ..sources import fixtures as fx
from .registry import register

KEYS = ["Model", "Gender"]


def _ratio(n, d):
    return f"coalesce(({n})::DOUBLE / nullif({d}, 0), 0.0)"


def _cnt(cond):
    return f"count(*) FILTER (WHERE {cond})"


MODEL_TYPE_SQL = "CASE WHEN Model = 'pretrained' THEN 'Pretrained' ELSE Model END"


def model_type(c="Model"):
    return F.when(F.col(c) == "pretrained", "Pretrained").otherwise(F.col(c))


@register("argmax_predict", fx.with_views("SELECT ID, Model, Gender, pred FROM pred_pairs", "pred_pairs"))
def q_argmax(spark, sf):
    return M.predict(fx.logit_pairs(spark, sf)).select("ID", "Model", "Gender", "pred")


def binary_sql(table: str, keys: str) -> str:
    """M3 over ``table(keys, pred, label)``."""
    return f"""SELECT {keys}, round({_ratio('correct', 'n')}, 9) AS Accuracy, round({_ratio('tp', 'pp')}, 9) AS Precision,
       round({_ratio('tp', 'pos')}, 9) AS Recall, round({_ratio('2 * tp', 'pp + pos')}, 9) AS "F1 Score"
FROM (SELECT {keys}, count(*) AS n, {_cnt('pred = 1 AND label = 1')} AS tp, {_cnt('pred = 1')} AS pp,
             {_cnt('label = 1')} AS pos, {_cnt('pred = label')} AS correct FROM {table} GROUP BY {keys})"""


BINARY_SQL = fx.with_views(f"""
SELECT {MODEL_TYPE_SQL} AS Model_type, Gender, Model,
       round({_ratio('correct', 'n')}, 9) AS Accuracy,
       round({_ratio('tp', 'pp')}, 9) AS Precision,
       round({_ratio('tp', 'pos')}, 9) AS Recall,
       round({_ratio('2 * tp', 'pp + pos')}, 9) AS "F1 Score"
FROM (SELECT Model, Gender, count(*) AS n, {_cnt('pred = 1 AND label = 1')} AS tp,
             {_cnt('pred = 1')} AS pp, {_cnt('label = 1')} AS pos, {_cnt('pred = label')} AS correct
      FROM pred_pairs GROUP BY Model, Gender)""", "pred_pairs")


def binary_metrics_df(spark, sf):
    m = M.binary_metrics(fx.pred_pairs(spark, sf), KEYS)
    return m.select(model_type().alias("Model_type"), "Gender", "Model",
                    "Accuracy", "Precision", "Recall", "F1 Score")


register("binary_metrics", BINARY_SQL)(binary_metrics_df)


def _weighted_sql(prefix=""):
    out = []
    for name, num, den in (("precision", "tp{c}", "pp{c}"), ("recall", "tp{c}", "sup{c}"),
                           ("f1", "2 * tp{c}", "pp{c} + sup{c}")):
        terms = " + ".join(f"sup{c} * {_ratio(num.format(c=c), den.format(c=c))}" for c in (0, 1))
        out.append(f"({terms}) / n AS {prefix}{name}")
    return ", ".join(out)


def _weighted_counts():
    return ", ".join(f"{_cnt(f'label = {c}')} AS sup{c}, {_cnt(f'pred = {c} AND label = {c}')} AS tp{c}, "
                     f"{_cnt(f'pred = {c}')} AS pp{c}" for c in (0, 1))


@register("weighted_metrics", fx.with_views(f"""
SELECT Model, Gender, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
FROM (SELECT Model, Gender, {_weighted_sql()}
      FROM (SELECT Model, Gender, count(*) AS n, {_weighted_counts()} FROM pred_pairs GROUP BY Model, Gender))""",
    "pred_pairs"))
def q_weighted(spark, sf):
    return M.weighted_metrics(fx.pred_pairs(spark, sf), KEYS)


@register("accuracy", fx.with_views(
    "SELECT Model, Gender, round(avg((pred = label)::INTEGER::DOUBLE), 9) AS accuracy "
    "FROM pred_pairs GROUP BY Model, Gender", "pred_pairs"))
def q_accuracy(spark, sf):
    return M.accuracy(fx.pred_pairs(spark, sf), KEYS)


CE_SQL = ("(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) "
          "- logits[label + 1])")


@register("cross_entropy", fx.with_views(f"""
SELECT Model, Gender, round(avg(ce), 9) AS loss FROM (
  SELECT Model, Gender, ID // 16 AS batch, avg({CE_SQL}) AS ce FROM logit_pairs GROUP BY 1, 2, 3)
GROUP BY Model, Gender""", "logit_pairs"))
def q_cross_entropy(spark, sf):
    lp = fx.logit_pairs(spark, sf).withColumn("batch", F.floor(F.col("ID") / 16))
    return M.mean_cross_entropy(lp, KEYS)


def _epoch_inner(keys: str, where: str = "TRUE") -> str:
    return f"""SELECT {keys}, epoch, round(avg(loss), 9) AS loss, round(avg(accuracy), 9) AS accuracy,
       round(avg(f1), 9) AS f1, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision
FROM (SELECT {keys}, epoch, batch, ce_avg AS loss, ok_avg AS accuracy, {_weighted_sql()}
      FROM (SELECT {keys}, epoch, batch, count(*) AS n, avg(ce) AS ce_avg,
                   avg((pred = label)::INTEGER::DOUBLE) AS ok_avg, {_weighted_counts()}
            FROM (SELECT *, {CE_SQL} AS ce, (list_position(logits, list_max(logits)) - 1) AS pred,
                         ID % 5 AS epoch, ID // 16 AS batch FROM logit_pairs WHERE {where})
            GROUP BY {keys}, epoch, batch))
GROUP BY {keys}, epoch"""


def _lp_epochs(spark, sf):
    return (fx.logit_pairs(spark, sf).withColumn("epoch", F.col("ID") % 5)
            .withColumn("batch", F.floor(F.col("ID") / 16)))


@register("epoch_metrics", fx.with_views(_epoch_inner("Model, Gender"), "logit_pairs"))
def q_epoch_metrics(spark, sf):
    return M.epoch_metrics(_lp_epochs(spark, sf), KEYS)


_STAT_COLS = ["loss", "accuracy", "f1", "recall", "precision"]


TRAINING_STATS_SQL = fx.with_views(f"""
SELECT coalesce(t.Model, v.Model) AS Model, coalesce(t.epoch, v.epoch) AS epoch,
       {', '.join(f't.{c} AS train_{c}' for c in _STAT_COLS)},
       {', '.join(f'v.{c} AS val_{c}' for c in _STAT_COLS)}
FROM ({_epoch_inner('Model', 'ID % 10 < 7')}) t
FULL JOIN ({_epoch_inner('Model', 'ID % 10 >= 7')}) v ON t.Model = v.Model AND t.epoch = v.epoch""",
    "logit_pairs")


@register("training_stats", TRAINING_STATS_SQL)
def q_training_stats(spark, sf):
    lp = _lp_epochs(spark, sf)
    train = M.epoch_metrics(lp.filter(F.col("ID") % 10 < 7), ["Model"])
    val = M.epoch_metrics(lp.filter(F.col("ID") % 10 >= 7), ["Model"])
    return M.training_stats(train, val, ["Model"])


def _early_stop_sql(direction: str, patience: int = 2, delta: float = 0.001) -> str:
    better = f"t.val_loss > r.best + {delta}" if direction == "max" else f"t.val_loss < r.best - {delta}"
    return "WITH RECURSIVE " + fx.TRIALS_SQL + f""",
t AS (SELECT trial, epoch, val_loss, row_number() OVER (PARTITION BY trial ORDER BY epoch) AS i FROM trials),
r AS (
  SELECT trial, i, val_loss AS best, 0 AS cnt, NULL::BIGINT AS stop, epoch::BIGINT AS best_at FROM t WHERE i = 1
  UNION ALL
  SELECT t.trial, t.i,
    CASE WHEN r.stop IS NOT NULL THEN r.best WHEN {better} THEN t.val_loss ELSE r.best END,
    CASE WHEN r.stop IS NOT NULL THEN r.cnt WHEN {better} THEN 0 ELSE r.cnt + 1 END,
    CASE WHEN r.stop IS NOT NULL THEN r.stop WHEN NOT ({better}) AND r.cnt + 1 >= {patience}
         THEN t.epoch::BIGINT END,
    CASE WHEN r.stop IS NOT NULL THEN r.best_at WHEN {better} THEN t.epoch::BIGINT ELSE r.best_at END
  FROM r JOIN t ON t.trial = r.trial AND t.i = r.i + 1)
SELECT r.trial, r.stop AS stop_epoch, r.best_at AS best_epoch, round(r.best, 9) AS best_score
FROM r JOIN (SELECT trial, max(i) AS i FROM t GROUP BY trial) last ON r.trial = last.trial AND r.i = last.i"""


@register("early_stop", _early_stop_sql("max"))
def q_early_stop(spark, sf):
    return M.early_stop(fx.trials(spark, sf), ["trial"], "epoch", "val_loss", 2, 0.001, "max")


@register("early_stop_min", _early_stop_sql("min"))
def q_early_stop_min(spark, sf):
    return M.early_stop(fx.trials(spark, sf), ["trial"], "epoch", "val_loss", 2, 0.001, "min")


@register("best_so_far", fx.with_views(
    "SELECT trial, epoch, min(val_loss) OVER (PARTITION BY trial ORDER BY epoch "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM trials", "trials"))
def q_best_so_far(spark, sf):
    return M.best_so_far(fx.trials(spark, sf)).select("trial", "epoch", "best_so_far")


@register("best_trial", fx.with_views(
    "SELECT trial, best_val_loss FROM (SELECT trial, min(val_loss) AS best_val_loss FROM trials GROUP BY trial) "
    "ORDER BY best_val_loss, trial LIMIT 1", "trials"))
def q_best_trial(spark, sf):
    return M.best_trial(fx.trials(spark, sf))


_METRIC_COLS = ["Accuracy", "Precision", "Recall", "F1 Score"]


@register("results_long", f"""WITH m AS ({BINARY_SQL})
""" + "\nUNION ALL ".join(
    f"SELECT Model_type, Gender, Model, '{c}' AS metric, \"{c}\" AS value FROM m" for c in _METRIC_COLS))
def q_results_long(spark, sf):
    return M.results_long(binary_metrics_df(spark, sf), ["Model_type", "Gender", "Model"], _METRIC_COLS)


def _pred_list_sql(chunk: int) -> str:
    return fx.with_views(f"""
SELECT {MODEL_TYPE_SQL} AS Model_type, Gender, Model, ID // {chunk} AS chunk,
       '[' || string_agg('np.int64(' || pred || ')', ', ' ORDER BY ID) || ']' AS Predictions,
       '[' || string_agg('np.int64(' || label || ')', ', ' ORDER BY ID) || ']' AS "True Labels"
FROM pred_pairs GROUP BY Model, Gender, ID // {chunk}""", "pred_pairs")


PRED_LIST_SQL = _pred_list_sql(1024)


def pred_lists_df(spark, sf, chunk: int = 1024):
    lists = M.prediction_lists(fx.pred_pairs(spark, sf), KEYS, chunk=chunk)
    return lists.select(model_type().alias("Model_type"), "Gender", "Model", "chunk", "Predictions", "True Labels")


register("predictions_list", PRED_LIST_SQL)(pred_lists_df)


@register("parse_pred_list", f"""WITH l AS ({PRED_LIST_SQL}),
p AS (SELECT Model, Gender, chunk,
             list_transform(regexp_extract_all(replace(Predictions, 'np.int64', ''), '[0-9]+'), lambda x: x::INTEGER) AS a
      FROM l)
SELECT Model, Gender, chunk, len(a)::INTEGER AS n_preds, list_sum(a)::INTEGER AS n_pos FROM p""")
def q_parse_pred_list(spark, sf):
    from ..functions.scoring import parse_int_list
    a = parse_int_list("Predictions")
    return pred_lists_df(spark, sf).select(
        "Model", "Gender", "chunk", F.size(a).alias("n_preds"),
        F.aggregate(a, F.lit(0), lambda s, x: s + x).alias("n_pos"))


SAMPLE_BIAS_SQL = fx.with_views("""
SELECT Model, ID, male_pred, female_pred, (male_pred - female_pred)::INTEGER AS bias FROM (
  SELECT Model, ID, max(pred) FILTER (WHERE Gender = 'male') AS male_pred,
         max(pred) FILTER (WHERE Gender = 'female') AS female_pred
  FROM pred_pairs GROUP BY Model, ID)
WHERE male_pred IS NOT NULL AND female_pred IS NOT NULL""", "pred_pairs")


@register("sample_bias", SAMPLE_BIAS_SQL)
def q_sample_bias(spark, sf):
    return B.sample_bias(fx.pred_pairs(spark, sf), ["Model"]).select(
        "Model", "ID", "male_pred", "female_pred", "bias")


BIAS_SUMMARY_SQL = f"""WITH s AS ({SAMPLE_BIAS_SQL})
SELECT Model, round(avg(bias::DOUBLE), 9) AS Total_Bias, round(avg(abs(bias)::DOUBLE), 9) AS Abs_Bias,
       round(avg((bias > 0)::INTEGER::DOUBLE), 9) AS Effect_Size
FROM s GROUP BY Model"""


@register("bias_summary", BIAS_SUMMARY_SQL)
def q_bias_summary(spark, sf):
    return B.bias_summary(B.sample_bias(fx.pred_pairs(spark, sf), ["Model"]), ["Model"])


@register("bias_all_models", BIAS_SUMMARY_SQL.replace(
    "FROM s GROUP BY Model", "FROM s WHERE Model IN ('pretrained', 'original', 'neutral', 'mix') GROUP BY Model"))
def q_bias_all_models(spark, sf):
    return B.bias_all_models(fx.pred_pairs(spark, sf), fx.MODELS)
