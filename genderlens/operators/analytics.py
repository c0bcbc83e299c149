"""Corpus and result analytics (P1-P5): rating summary, Gaussian KDE by
binning, wide-to-long reshaping, categorical order and rounded labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def order_statistics(df: DataFrame, col: str, ranks: list[int], bins: int = 1024) -> list[float]:
    """The values at 0-based ``ranks`` of a numeric column (nulls and NaN
    ignored), exact, by a bucket search: every round counts the rows left in
    ``bins`` equal intervals and goes on in the one that holds the rank, until
    that holds one value only. A round is one aggregation that brings at most
    ``bins`` rows to the driver; a double is pinned down in a few rounds however
    many rows or ties there are."""
    x = df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    out = []
    for rank in ranks:
        low, high, left, inside = None, None, rank, x
        while low is None or low != high:
            if low is None:
                ends = x.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
                low, high = ends["low"], ends["high"]
            width = (high - low) / bins
            if math.isinf(width) or math.isnan(width):  # the ends are infinite or too far apart: by sign first
                at = F.when(F.col("v") == -math.inf, 0).when(F.col("v") < 0, 1).when(F.col("v") < math.inf, 2).otherwise(3)
            elif low + width == low or high - width == high:  # a few neighbouring doubles
                at = F.col("v")
            else:
                at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
            rows = inside.groupBy(at.alias("at")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).collect()
            for r in sorted(rows, key=lambda r: r["low"]):
                low, high = r["low"], r["high"]
                if left < r["n"]:
                    break
                left -= r["n"]
            inside = x.where((F.col("v") >= low) & (F.col("v") <= high))
        out.append(low)
    return out


def _counted(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")


def rating_summary(df: DataFrame, col: str = "Rating") -> DataFrame:
    """Mean, exact median, sample std and mean +/- 1 SD (nulls and NaN
    ignored) of a column of any kind, discrete or continuous. Runs jobs."""
    s = _counted(df, col).agg(F.count("v").cast("long").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    n = s.first()["n"]
    middle = order_statistics(df, col, sorted({(n - 1) // 2, n // 2})) if n else []
    median = F.lit(sum(middle) / len(middle) if middle else None).cast("double")
    return s.select("n", *[F.round(c, DIGITS).alias(n) for c, n in (
        (F.col("mean"), "mean"), (median, "median"), (F.col("std"), "std"),
        (F.col("mean") - F.col("std"), "mean_minus_sd"), (F.col("mean") + F.col("std"), "mean_plus_sd"))])


def rating_kde(df: DataFrame, col: str = "Rating", lo: float = 0.0, hi: float = 7.0,
               step: float = 0.25, fineness: float = 1 / 64) -> DataFrame:
    """Gaussian KDE (Scott bandwidth std * n^-1/5) evaluated on a grid.

    Values are reduced to weights on the nodes of a fine lattice by linear
    binning: a value between two nodes is shared by them in proportion, with
    partial sums in every task. The lattice step is the power of two at most
    ``fineness`` bandwidths wide, so values on such nodes (whole and half
    ratings) are exact, and others are off by the order of its square. The
    kernel sums then cost nodes x grid, independent of the row count. Runs a job
    (count and spread). Without two different values there is no density."""
    steps = int(round((hi - lo) / step))
    x = _counted(df, col)
    s = x.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("std")).first()
    n, std = s["n"], s["std"] or 0.0
    bw = std * float(n) ** -0.2 if n else 0.0
    if bw <= 0 or math.isnan(bw):
        return df.sparkSession.createDataFrame([], "x double, density double")
    delta = 2.0 ** math.floor(math.log2(bw * fineness))
    node = F.floor(F.col("v") / delta)
    share = F.col("v") / delta - node
    both = F.array(F.struct(node.alias("node"), (F.lit(1.0) - share).alias("c")), F.struct((node + 1).alias("node"), share.alias("c")))
    bins = x.select(F.inline(both)).where("c > 0").groupBy("node").agg(F.sum("c").alias("c"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.lit(lo) + i * F.lit(step))
    pts = bins.select((F.col("node") * F.lit(delta)).alias("r"), "c", F.explode(grid).alias("x"))
    k = F.col("c") * F.exp(F.lit(-0.5) * ((F.col("x") - F.col("r")) / F.lit(bw)) ** 2)
    return (pts.groupBy("x").agg((F.sum(k) / F.lit(n * bw * math.sqrt(2 * math.pi))).alias("density"))
            .select(F.round("x", 2).alias("x"), F.round("density", DIGITS).alias("density")))


def unpivot_bias(summary: DataFrame) -> DataFrame:
    """Total_Bias and Abs_Bias -> (Model, Bias_Type, Bias_Value)."""
    return summary.unpivot(["Model"], ["Total_Bias", "Abs_Bias"], "Bias_Type", "Bias_Value")


def model_order(df: DataFrame, order: list[str], col: str = "Model") -> DataFrame:
    """Categorical sort key (1-based place in ``order``; 0 if absent)."""
    return df.withColumn("model_rank",
                         F.array_position(F.array(*[F.lit(m) for m in order]), F.col(col)).cast("int"))


def rounded_labels(summary: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    """P5: values rounded for labels (half-up)."""
    return summary.select(*[F.round(c, digits).alias(f"{c}_label") for c in cols])
