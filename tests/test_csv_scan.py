"""Split scan, rejected rows and replayable appends of CSV tables."""

import random

import pytest

from genderlens.operators.ranking import dense_id, file_order_id
from genderlens.sources import csv as C
from genderlens.sources import csv_scan as CS

SCHEMA = "id long, v string, w string"


def put(spark, name, text):
    """One file of exactly these bytes."""
    from genderlens.sources import files
    path = f"{C.scratch_path(spark, name)}/data.csv"
    assert files.write_once(spark, path, text)
    return path


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 1,500 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def random_rows(n, seed):
    rng = random.Random(seed)
    bits = ["a", '"', '""', ",", "\n", "\r\n", " ", "æ", "\\", "x" * 30, "\n\n", "'", '","', '"\n']
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))), rng.choice([None, "", "w", "l\n"])) for i in range(n)]


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_split_scan_equals_the_multiline_reader(spark, small_ranges, limit):
    rows = random_rows(400, 1) + [(1000, 'long "quoted"\n' * 100, "over many ranges"), (1001, '"', '\n')]
    path = C.scratch_path(spark, "split")
    C.write_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        good, bad = CS.scan(spark, path, SCHEMA)
        got = good.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert bad.count() == 0
    assert len({r.start for r in got}) > 8  # many tasks read the one file
    assert sorted((r.id, r.v, r.w) for r in got) == sorted(rows, key=lambda r: r[0])
    whole = C.read_csv(spark, path, SCHEMA).collect()
    assert sorted(map(tuple, whole)) == sorted((r.id, r.v, r.w) for r in got)
    assert [r.id for r in sorted(got, key=lambda r: (r.file, r.start, r.place))] == [r[0] for r in rows]  # positions follow the file


def test_records_of_odd_files(spark, small_ranges):
    def of(text):
        return [r.record for r in CS.records(spark, put(spark, "odd", text)).orderBy("start", "place").collect()]

    assert of("") == []
    assert of("\n\n\n") == []
    assert of("a,b") == ["a,b"]
    assert of('a,"b\nc"\n\nd') == ['a,"b\nc"', "d"]
    assert of('a\r\n"x\r\ny"\r\n') == ["a", '"x\r\ny"']
    assert of('a\n"never closed\n' + "line\n" * 900) == ["a", '"never closed\n' + "line\n" * 899 + "line"]
    assert of("line\n" * 900) == ["line"] * 900


def test_rejects_and_headers(spark):
    plain = put(spark, "p", 'id,v,w\n1,a,b\n2,only\nx,a,b\n4,"a\nb",c,d\n5,,\n6,"q""q",\\N\n')
    turned = put(spark, "t", "w,id,v\nW,7,V\nW,8\n")
    other = put(spark, "o", "id,name,w\n9,a,b\n")
    rows, bad = CS.scan(spark, [plain, turned, other], SCHEMA)
    assert sorted((r.id, r.v, r.w) for r in rows.collect()) == [(1, "a", "b"), (5, None, None), (6, 'q"q', None), (7, "V", "W")]
    assert sorted((r.reason, r.record) for r in bad.collect()) == sorted(
        [("fields", "2,only"), ("id", "x,a,b"), ("fields", '4,"a\nb",c,d'), ("fields", "W,8"), ("header", "9,a,b")])
    none, bad = CS.scan(spark, put(spark, "h", "id,v,w\n"), SCHEMA)
    assert none.count() == bad.count() == 0
    headless, bad = CS.scan(spark, put(spark, "n", "1,a,b\n2,c\n"), SCHEMA, header=False)
    assert [r.id for r in headless.collect()] == [1] and [r.record for r in bad.collect()] == ["2,c"]


def test_replayed_appends(spark):
    path = C.scratch_path(spark, "runs")
    schema = "a long"
    assert CS.read_runs(spark, path, schema).count() == 0
    df = spark.range(3).withColumnRenamed("id", "a")
    assert CS.append_run(df, path, "one") and not CS.append_run(df, path, "one")
    C.write_csv(df, f"{path}/run=two/dead")  # an attempt without a commit
    assert sorted(r.a for r in CS.read_runs(spark, path, schema).collect()) == [0, 1, 2]
    assert CS.append_run(df, path, "two")
    assert sorted(r.a for r in CS.read_runs(spark, path, schema).collect()) == [0, 0, 1, 1, 2, 2]
    assert len(CS.committed(spark, path)) == 2


def test_ids_in_file_order(spark):
    rows = [(i // 3, "same" if i % 5 else None) for i in range(300)]
    path = f"{C.scratch_path(spark, 'order')}.parquet"
    df = spark.createDataFrame(rows, "k long, v string")
    df.repartitionByRange(6, "k").sortWithinPartitions("k").write.parquet(path)
    got = sorted((r.ID, r.k) for r in file_order_id(spark.read.parquet(path)).collect())
    assert [i for i, _ in got] == list(range(300)) and [k for _, k in got] == [r[0] for r in rows]
    some = file_order_id(spark.read.parquet(path).where("k % 7 = 0")).collect()
    assert sorted(r.ID for r in some) == list(range(len(some))) and len(some) == 45
    assert [r.k for r in sorted(some, key=lambda r: r.ID)] == sorted(r.k for r in some)
    assert file_order_id(spark.read.parquet(path).where("k < 0")).count() == 0


def test_dense_id_keeps_rows_of_equal_keys(spark):
    rows = [(i % 4 if i % 6 else None, i) for i in range(60)] + [(1, 1), (1, 1), (None, 0)]
    df = spark.createDataFrame(rows, "k long, t long")
    got = dense_id(df, "k", "ID", tie="t").collect()
    assert sorted(r.ID for r in got) == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.k, r.t) for r in sorted(got, key=lambda r: r.ID)] == want
    assert sorted(r.ID for r in dense_id(df.select("k"), "k").collect()) == list(range(len(rows)))
