"""CSV sources and sinks keep values byte for byte."""

from pyspark.sql import functions as F

from genderlens.sources import csv as C

VALUES = ["", " lead", "trail ", "multi\nline\r\nend", 'quote "x", comma', None, "æøå"]


def test_csv_roundtrip_exact(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id long, v string")
    path = C.scratch_path(spark, "t")
    C.write_csv(df, path)
    back = {r.id: r.v for r in C.read_csv(spark, path, "id long, v string").collect()}
    assert back == dict(enumerate(VALUES))


def test_append_and_embedded_headers(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "Model string, x double")
    path = C.scratch_path(spark, "app")
    C.write_csv(df, path, mode="append")
    C.write_csv(df, path, mode="append")
    assert C.read_csv(spark, path, "Model string, x double").count() == 4
    lines = spark.createDataFrame([(0, "Model,x"), (1, "a,1.5"), (2, "Model,x"), (3, "b,2.0")],
                                  "o int, line string")
    p2 = C.scratch_path(spark, "emb")
    C.write_lines_in_order(lines, "line", ["o"], p2)
    raw = C.read_csv(spark, p2, "Model string, x string")
    kept = C.drop_embedded_headers(raw, "Model").select("Model", F.col("x").cast("double").alias("x"))
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 1.5), ("b", 2.0)]


def test_with_index(spark):
    df = spark.createDataFrame([("mix", 4), ("pretrained", 1)], "Model string, model_rank int")
    out = {r.Model: r["index"] for r in C.with_index(df, "model_rank").collect()}
    assert out == {"mix": 3, "pretrained": 0}
