"""Classification metrics, training statistics and early stopping.

Every metric is a grouped aggregation of confusion counts, so one pass with
map-side partial aggregation computes all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import argmax, cross_entropy, safe_ratio

DIGITS = 9


def predict(logits: DataFrame, col: str = "logits") -> DataFrame:
    """M2: argmax class per row."""
    return logits.withColumn("pred", argmax(col))


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    p, y = F.col("pred"), F.col("label")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        _count_if((p == 1) & (y == 1)).alias("tp"),
        _count_if(p == 1).alias("pp"),
        _count_if(y == 1).alias("pos"),
        _count_if(p == y).alias("correct"))


def binary_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """M3: accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    c = confusion(preds, keys)
    return c.select(
        *keys,
        F.round(safe_ratio("correct", "n"), DIGITS).alias("Accuracy"),
        F.round(safe_ratio("tp", "pp"), DIGITS).alias("Precision"),
        F.round(safe_ratio("tp", "pos"), DIGITS).alias("Recall"),
        F.round(safe_ratio(F.col("tp") * 2, F.col("pp") + F.col("pos")), DIGITS).alias("F1 Score"))


def _weighted_exprs(prefix: str = ""):
    """Support-weighted precision / recall / F1 over classes {0, 1}."""
    p, y = F.col("pred"), F.col("label")
    n = F.count(F.lit(1))
    parts = {"precision": [], "recall": [], "f1": []}
    for c in (0, 1):
        sup = _count_if(y == c)
        tp = _count_if((p == c) & (y == c))
        pp = _count_if(p == c)
        parts["precision"].append(sup * safe_ratio(tp, pp))
        parts["recall"].append(sup * safe_ratio(tp, sup))
        parts["f1"].append(sup * safe_ratio(tp * 2, pp + sup))
    return [((parts[k][0] + parts[k][1]) / n).alias(prefix + k) for k in ("precision", "recall", "f1")]


def weighted_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """M4: weighted precision, recall (= accuracy) and F1."""
    out = preds.groupBy(*keys).agg(*_weighted_exprs())
    return out.select(*keys, *[F.round(F.col(c), DIGITS).alias(c) for c in ("precision", "recall", "f1")])


def accuracy(preds: DataFrame, keys: list[str]) -> DataFrame:
    """M5: share of correct predictions."""
    return preds.groupBy(*keys).agg(
        F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), DIGITS).alias("accuracy"))


def mean_cross_entropy(logits: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """M6: mean over batches of the batch-mean cross-entropy."""
    per_batch = (logits.withColumn("ce", cross_entropy("logits", "label"))
                 .groupBy(*keys, batch).agg(F.avg("ce").alias("ce")))
    return per_batch.groupBy(*keys).agg(F.round(F.avg("ce"), DIGITS).alias("loss"))


def epoch_metrics(logits: DataFrame, keys: list[str], epoch: str = "epoch",
                  batch: str = "batch") -> DataFrame:
    """M7: per (keys, epoch), the unweighted mean over batches of the batch
    loss, accuracy and weighted F1 / recall / precision."""
    x = logits.withColumn("pred", argmax("logits")).withColumn("ce", cross_entropy("logits", "label"))
    per_batch = x.groupBy(*keys, epoch, batch).agg(
        F.avg("ce").alias("loss"),
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
        *_weighted_exprs())
    cols = ["loss", "accuracy", "f1", "recall", "precision"]
    return per_batch.groupBy(*keys, epoch).agg(*[F.round(F.avg(c), DIGITS).alias(c) for c in cols])


def training_stats(train: DataFrame, val: DataFrame, keys: list[str], epoch: str = "epoch") -> DataFrame:
    """M8: one row per epoch with training and validation metrics side by side."""
    cols = ["loss", "accuracy", "f1", "recall", "precision"]
    t = train.select(*keys, epoch, *[F.col(c).alias(f"train_{c}") for c in cols])
    v = val.select(*keys, epoch, *[F.col(c).alias(f"val_{c}") for c in cols])
    return t.join(v, keys + [epoch], "full")


def early_stop(scores: DataFrame, group: list[str], order: str, value: str,
               patience: int = 2, delta: float = 0.001, direction: str = "max") -> DataFrame:
    """M9: first position where early stopping fires, per group.

    A score improves when it beats best + delta ('max', the reference's
    reading) or best - delta ('min', for losses); ``patience`` epochs
    without improvement stop the run. Each group's series is folded with a
    higher-order ``aggregate``. Input: one row per (group, epoch), so a
    group's list is bounded by the number of epochs (aggregate raw rows per
    epoch first)."""
    seq = scores.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        .alias("s"))
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("cnt"),
                    F.lit(None).cast("long").alias("stop"), F.lit(None).cast("long").alias("best_at"))

    def step(acc, x):
        v = x["v"]
        better = (v > acc["best"] + delta) if direction == "max" else (v < acc["best"] - delta)
        improve = acc["best"].isNull() | better
        frozen = acc["stop"].isNotNull()
        cnt = F.when(improve, 0).otherwise(acc["cnt"] + 1)
        return F.when(frozen, acc).otherwise(F.struct(
            F.when(improve, v).otherwise(acc["best"]).alias("best"),
            cnt.alias("cnt"),
            F.when(~improve & (cnt >= patience), x["o"].cast("long")).alias("stop"),
            F.when(improve, x["o"].cast("long")).otherwise(acc["best_at"]).alias("best_at")))

    r = seq.select(*group, F.aggregate("s", init, step).alias("r"))
    return r.select(*group, F.col("r.stop").alias("stop_epoch"), F.col("r.best_at").alias("best_epoch"),
                    F.round(F.col("r.best"), DIGITS).alias("best_score"))


def best_so_far(trials: DataFrame, group: str = "trial", order: str = "epoch",
                value: str = "val_loss") -> DataFrame:
    """Running minimum per trial (window partitioned by trial)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.min(value).over(w))


def best_trial(trials: DataFrame, group: str = "trial", value: str = "val_loss") -> DataFrame:
    """Best loss per trial, then the trial with the lowest one."""
    per = trials.groupBy(group).agg(F.min(value).alias("best_val_loss"))
    return per.agg(F.min_by(group, F.struct("best_val_loss", group)).alias(group),
                   F.min("best_val_loss").alias("best_val_loss"))


def results_long(metrics: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Metric columns -> (keys, metric, value) rows."""
    return metrics.unpivot(keys, cols, "metric", "value")


def prediction_lists(preds: DataFrame, keys: list[str], id_col: str = "ID",
                     chunk: int = 1024) -> DataFrame:
    """Predictions and true labels as stringified lists ordered by ID.

    ``chunk`` is the number of consecutive IDs per row: the published table
    has one list per model and gender, which no table of unbounded size can
    hold in one row. With ``chunk`` above the largest ID there is one row
    per key, as published."""
    def listed(field):
        items = F.transform("s", lambda x: F.concat(F.lit("np.int64("), x[field].cast("string"), F.lit(")")))
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))

    c = F.floor(F.col(id_col) / chunk).alias("chunk")
    return (preds.groupBy(*keys, c)
            .agg(F.array_sort(F.collect_list(F.struct(id_col, "pred", "label"))).alias("s"))
            .select(*keys, "chunk", listed("pred").alias("Predictions"), listed("label").alias("True Labels")))
