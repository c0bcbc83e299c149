"""Metrics and bias rebuilt from the confusion counts behind the published
result files must reproduce the published values."""

from pyspark.sql import functions as F

from genderlens.operators.bias import bias_summary
from genderlens.operators.metrics import binary_metrics

N, POS = 814, 408
# (model, gender): (predicted positive, true positive)
COUNTS = {
    ("pretrained", "female"): (277, 133), ("pretrained", "male"): (814, 408),
    ("original", "female"): (814, 408), ("original", "male"): (814, 408),
    ("neutral", "female"): (0, 0), ("neutral", "male"): (0, 0),
    ("mix", "female"): (413, 290), ("mix", "male"): (759, 375),
}
# Published (accuracy, precision, recall, F1), 4 decimals.
PUBLISHED = {
    ("pretrained", "female"): (0.4853, 0.4801, 0.3260, 0.3883),
    ("pretrained", "male"): (0.5012, 0.5012, 1.0, 0.6678),
    ("original", "female"): (0.5012, 0.5012, 1.0, 0.6678),
    ("original", "male"): (0.5012, 0.5012, 1.0, 0.6678),
    ("neutral", "female"): (0.4988, 0.0, 0.0, 0.0),
    ("neutral", "male"): (0.4988, 0.0, 0.0, 0.0),
    ("mix", "female"): (0.7039, 0.7022, 0.7108, 0.7065),
    ("mix", "male"): (0.4877, 0.4941, 0.9191, 0.6427),
}


def rows_for(pp, tp):
    # IDs 0..407 are positive; true positives first, then false positives
    rows = []
    fp = pp - tp
    for i in range(N):
        label = 1 if i < POS else 0
        if label == 1:
            pred = 1 if i < tp else 0
        else:
            pred = 1 if i - POS < fp else 0
        rows.append((i, label, pred))
    return rows


def predictions(spark, paired_mix=False):
    data = []
    for (m, g), (pp, tp) in COUNTS.items():
        for i, label, pred in rows_for(pp, tp):
            data.append((m, g, i, label, pred))
    return spark.createDataFrame(data, "Model string, Gender string, ID int, label int, pred int")


def test_binary_metrics_match_published(spark):
    got = {(r.Model, r.Gender): (r.Accuracy, r.Precision, r.Recall, r["F1 Score"])
           for r in binary_metrics(predictions(spark), ["Model", "Gender"]).collect()}
    for k, exp in PUBLISHED.items():
        assert tuple(round(v, 4) for v in got[k]) == exp, k


def test_total_bias_matches_published(spark):
    from genderlens.operators.bias import sample_bias
    b = bias_summary(sample_bias(predictions(spark), ["Model"]), ["Model"])
    got = {r.Model: r.Total_Bias for r in b.collect()}
    assert round(got["pretrained"], 4) == 0.6597
    assert got["original"] == 0.0 and got["neutral"] == 0.0
    assert round(got["mix"], 4) == 0.4251


def test_bias_summary_from_paired_counts(spark):
    # mix: +368 / -22 paired samples out of 814 -> abs 390/814, effect 368/814
    bias = [1] * 368 + [-1] * 22 + [0] * (814 - 390)
    df = spark.createDataFrame([("mix", b) for b in bias], "Model string, bias int")
    r = bias_summary(df, ["Model"]).collect()[0]
    assert round(r.Total_Bias, 4) == 0.4251
    assert round(r.Abs_Bias, 4) == 0.4791
    assert round(r.Effect_Size, 4) == 0.4521
