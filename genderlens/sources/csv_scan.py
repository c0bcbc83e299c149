"""Split scan of quoted CSV, rejected rows, and appends that can be replayed
(S1, S4, S5).

A quoted field may hold line ends, so a byte range of a file cannot tell alone
where a record ends. It can count its quotes: a line end closes a record
exactly if the number of quotes before it is even (a quote inside a field is
written twice, which keeps the count's parity). The scan reads a file in the
byte ranges of Spark's text source, in two passes:

1. every range counts its quotes; the running sum over the ranges of a file
   (one row each) gives the state in which each range begins;
2. every range cuts its lines into records from that state. Records that lie
   inside a range are done; the open end of one range and the open beginning
   of the next ones (two pieces a range at most) are put together by a
   group-by on the piece's record.

So one file of any size is read by as many tasks as it has ranges, and no row
but the cut ones is shuffled. Every record has a position (file, range, place
in the range), which also numbers the rows in the order of the files.

Defined results: an empty file or table gives no rows; blank lines between
records are skipped; line ends inside quotes are kept byte for byte, a carriage
return before a closing line end is not part of the record; an unclosed quote
makes the rest of its file one record. Quotes must be doubled inside fields
(no escape character), as ``csv.write_csv`` writes them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.joins import broadcasts
from ..session import sized, small_batches
from . import files
from .csv import CSV_OPTS, read_csv, write_csv

QUOTE = '"'
SLICE_BYTES = 1 << 22


# ---- records -----------------------------------------------------------------------

def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with their file and byte range, in order within a task."""
    x = spark.read.option("lineSep", "\n").text(path)
    return x.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
                    F.monotonically_increasing_id().alias("at"))


def _ranges(b: pa.RecordBatch):
    """``(file, start, rows)`` of the ranges in a batch of lines."""
    key = pc.binary_join_element_wise(b.column(0), pc.cast(b.column(1), pa.string()), "\n").dictionary_encode()
    at = key.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.slice(i, j - i)


def _count_quotes(batches):
    for b in batches:
        for file, start, rows in _ranges(b):
            n = pc.sum(pc.count_substring(rows.column(2), QUOTE)).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), pa.array([n], pa.int64())], names=["file", "start", "quotes"])


class RangeCutter:
    """Cuts the lines of one byte range into records. ``open_``: whether the
    range begins inside quotes."""

    def __init__(self, open_: bool):
        self.open, self.held, self.place, self.first = open_, [], 0, open_

    def add(self, lines: pa.Array):
        """``(place, kind, text)`` of the records that end in ``lines``; kind
        1 is the end of a record that began in an earlier range."""
        odd = pc.bit_wise_and(pc.count_substring(lines, QUOTE), 1).to_numpy(zero_copy_only=False)
        inside = (np.cumsum(odd) + self.open) % 2  # after each line
        ends = np.flatnonzero(inside == 0)
        place, kind, text, at = [], [], [], 0
        if not self.held and not self.open and ends.size == len(lines):  # one line each
            n = len(lines)
            out = np.arange(self.place, self.place + n), np.zeros(n, np.int32), lines
            self.place += n
            return out
        values = lines.to_pylist()
        for e in ends.tolist():
            record = [*self.held, *values[at:e + 1]]
            text.append(record[0] if len(record) == 1 else "\n".join(record))
            place.append(self.place)
            kind.append(1 if self.first else 0)
            self.held, at, self.first = [], e + 1, False
            self.place += 1
        self.held += values[at:]
        self.open = bool(inside[-1]) if inside.size else self.open
        return np.array(place, np.int64), np.array(kind, np.int32), pa.array(text, pa.string())

    def rest(self):
        """The open end: kind 2 begins a record, 3 is the middle of one."""
        if not self.held:
            return None
        return np.array([self.place]), np.array([3 if self.first else 2], np.int32), pa.array(["\n".join(self.held)], pa.string())


def _cut_records(batches):
    """Rows (file, start, value, inside) -> (file, start, place, kind, value)."""
    now, cutter = None, None

    def emit(out):
        place, kind, text = out
        n = len(place)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.string()), pa.array(np.full(n, now[1], np.int64)), pa.array(place, pa.int64()),
                                           pa.array(kind, pa.int32()), text], names=["file", "start", "place", "kind", "value"])

    for b in small_batches(batches, 2, SLICE_BYTES):
        for file, start, rows in _ranges(b):
            if (file, start) != now:
                if cutter and (rest := cutter.rest()):
                    yield emit(rest)
                now, cutter = (file, start), RangeCutter(rows.column(3)[0].as_py())
            out = cutter.add(rows.column(2))
            if len(out[0]):
                yield emit(out)
    if cutter and (rest := cutter.rest()):
        yield emit(rest)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, start, place, record)`` of every CSV record below ``path``.
    Runs the counting pass."""
    lines = _lines(spark, path)
    counted = sized(lines.drop("at").mapInArrow(_count_quotes, "file string, start bigint, quotes bigint").groupBy("file", "start").agg(F.sum("quotes").alias("quotes")))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    state = sized(counted.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside")))
    held = broadcasts(state)
    cut = lines.join(state, ["file", "start"], "left")
    if not held:  # shuffled: each range in order again
        cut = cut.repartition("file", "start").sortWithinPartitions("file", "start", "at")
    inside = F.coalesce("inside", F.raise_error(F.lit("byte ranges changed between the passes: fix spark.sql.files.minPartitionNum")).cast("boolean"))
    cut = cut.select("file", "start", "value", inside.alias("inside"))
    cut = cut.mapInArrow(_cut_records, "file string, start bigint, place bigint, kind int, value string")
    whole = cut.where("kind = 0").select("file", "start", "place", F.col("value").alias("record"))
    pieces = sized(cut.where("kind > 0"))  # two a range at most
    w = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    begun = pieces.withColumn("g", F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(w))
    joined = begun.groupBy("file", "g").agg(F.sort_array(F.collect_list(F.struct("start", "place", "value"))).alias("s"))  # one record
    joined = joined.select("file", F.col("s")[0]["start"].alias("start"), F.col("s")[0]["place"].alias("place"),
                           F.array_join(F.transform("s", lambda x: x["value"]), "\n").alias("record"))
    every = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return every.where("record <> ''")


# ---- typed rows --------------------------------------------------------------------

def _as_schema(spark: SparkSession, schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema


def _parse(record: str, fields: int) -> Column:
    """The fields as strings ``c0, c1, ...`` and ``bad``: the record, if it
    does not have that many."""
    opts = {k: v for k, v in CSV_OPTS.items() if k != "header"} | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "maxCharsPerColumn": "-1"}
    return F.from_csv(F.col(record), ", ".join([*(f"c{i} string" for i in range(fields)), "bad string"]), opts)


def scan(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Typed rows of CSV files, and what was rejected.

    The first result has the columns of ``schema`` and the position ``file,
    start, place``. Each file's header is held against the schema: the same
    names in another order are followed by name; other names reject every
    record of that file. The second result is ``(file, start, place, reason,
    record)``: ``header``, ``fields`` (a record with another number of fields) or
    the name of the first column whose value does not have its type. No record
    is lost or turned into nulls: each is in exactly one of the two, apart from
    the headers. Runs jobs."""
    kind = _as_schema(spark, schema)
    names, n = kind.fieldNames(), len(kind)
    x = records(spark, path).withColumn("f", _parse("record", n))
    values = F.array(*[F.col(f"f.c{i}") for i in range(n)])
    if header:
        first = x.where(F.col("start") == 0).groupBy("file").agg(F.min("place").alias("place")).withColumn("start", F.lit(0).cast("bigint"))
        heads = sized(x.join(first, ["file", "start", "place"]).select("file", "start", "place", F.when(F.col("f.bad").isNull(), values).alias("head")))
        x = x.join(heads.select("file", "start", "place"), ["file", "start", "place"], "left_anti").join(heads.select("file", "head"), "file", "left")
        wanted = F.array(*[F.lit(c) for c in names])
        fits = F.coalesce(F.array_sort("head") == F.array_sort(wanted), F.lit(False))
        v = [F.element_at(values, F.array_position("head", c).cast("int")) for c in names]
    else:
        fits, v = F.lit(True), [F.col(f"f.c{i}") for i in range(n)]
    at = ["file", "start", "place"]
    good = fits & F.col("f.bad").isNull()
    x = x.select(*at, "record", fits.alias("__fits"), F.col("f.bad").isNull().alias("__whole"),
                 *[F.when(good, c).alias(f"__v{i}") for i, c in enumerate(v)])
    typed = [F.col(f"__v{i}").try_cast(f.dataType) for i, f in enumerate(kind.fields)]
    wrong = [F.when(F.col(f"__v{i}").isNotNull() & t.isNull(), F.lit(f.name)) for i, (f, t) in enumerate(zip(kind.fields, typed))]
    reason = F.coalesce(F.when(~F.col("__fits"), F.lit("header")), F.when(~F.col("__whole"), F.lit("fields")), *wrong)
    x = x.withColumn("__reason", reason)
    rows = x.where("__reason is null").select(*at, *[t.alias(f.name) for f, t in zip(kind.fields, typed)])
    return rows, x.where("__reason is not null").select(*at, F.col("__reason").alias("reason"), "record")


# ---- appends -----------------------------------------------------------------------

def append_run(df: DataFrame, path: str, run: str) -> bool:
    """Add ``df`` to a CSV table under a run id, once. The part files go to
    a folder of this attempt, and the run counts from the moment its entry in
    the manifest is there. A run that is already committed writes nothing and
    returns False; an attempt that died has no entry and is never read."""
    spark = df.sparkSession
    entry = f"{path}/_manifest/{run}"
    if files.exists(spark, entry):
        return False
    attempt = f"run={run}/{spark._jvm.java.util.UUID.randomUUID()}"
    write_csv(df, f"{path}/{attempt}")
    return files.write_once(spark, entry, attempt)


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of the committed runs (one small file each in the manifest)."""
    found = [n for n in files.names(spark, f"{path}/_manifest") if not n.endswith(".draft")]
    return [f"{path}/{files.read_text(spark, f'{path}/_manifest/{n}')}" for n in found]


def read_runs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed runs."""
    folders = committed(spark, path)
    return read_csv(spark, folders, schema) if folders else spark.createDataFrame([], schema)
