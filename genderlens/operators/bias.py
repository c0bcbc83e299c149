"""Paired counterfactual bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def sample_bias(preds: DataFrame, keys: list[str], id_col: str = "ID",
                male: str = "male", female: str = "female") -> DataFrame:
    """male_pred - female_pred per sample, pairing the two versions of
    a sample by ID. A single aggregation on (keys, ID) pairs them (one
    shuffle, no join); samples missing either version are dropped."""
    g = F.col("Gender")
    pairs = preds.filter(g.isin(male, female)).groupBy(*keys, id_col).agg(
        F.max(F.when(g == male, F.col("pred"))).alias("male_pred"),
        F.max(F.when(g == female, F.col("pred"))).alias("female_pred"))
    return (pairs.filter(F.col("male_pred").isNotNull() & F.col("female_pred").isNotNull())
            .withColumn("bias", (F.col("male_pred") - F.col("female_pred")).cast("int")))


def bias_summary(bias: DataFrame, keys: list[str]) -> DataFrame:
    """Total_Bias = mean, Abs_Bias = mean |b|, Effect_Size = share b > 0."""
    b = F.col("bias")
    return bias.groupBy(*keys).agg(
        F.round(F.avg(b.cast("double")), DIGITS).alias("Total_Bias"),
        F.round(F.avg(F.abs(b).cast("double")), DIGITS).alias("Abs_Bias"),
        F.round(F.avg((b > 0).cast("double")), DIGITS).alias("Effect_Size"))


def bias_all_models(preds: DataFrame, models: list[str]) -> DataFrame:
    """Bias summary for the listed models (one group-by, no loop)."""
    return bias_summary(sample_bias(preds.filter(F.col("Model").isin(*models)), ["Model"]), ["Model"])
