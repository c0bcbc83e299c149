"""Exact dense ranks without a single-partition window.

A global ``row_number() OVER (ORDER BY k)`` moves every row into one task.
Here rows are first cut into order-compatible buckets (sorting by bucket and
then by the key gives the global order). Each bucket is ranked by a window
partitioned by the bucket, and a bucket's offset is the number of rows in
all earlier buckets. The offsets table has one row per bucket (and group), so
its size is bounded by the bucket count.

Null keys, buckets and groups are ranked like any other, after all values;
an empty table gives an empty result. Building the result of
``rank_by_numeric`` runs one job (quantiles)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_known, sized


def default_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, parts * 4)


def _last(c: Column | str) -> Column:
    """Sort order of a plain column with nulls at the end."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def rank_with_buckets(df: DataFrame, bucket: list[Column | str], order: list[Column | str],
                      out: str = "rank", group: list[str] | None = None,
                      max_buckets: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order`` (ascending,
    nulls last; plain columns).

    ``bucket``: columns whose ordering is a coarsening of ``order``.
    ``group``: optional partition columns; ranks restart per group (the
    group columns must lead ``bucket``). ``order`` must be a total order."""
    names = [f"__b{i}" for i in range(len(bucket))]
    x = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(bucket, names)])
    x = x.withColumn("__local", F.row_number().over(Window.partitionBy(*names).orderBy(*map(_last, order))) - 1)
    lead = len(group or [])
    counts = x.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    # bounded: one row per bucket of a group
    w = (Window.partitionBy(*names[:lead]) if lead else Window).orderBy(*map(_last, names[lead:]))
    before = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(n).alias(f"__o{n}") for n in names], F.coalesce(before, F.lit(0)).alias("__off"))
    if max_buckets is not None:
        offsets = broadcast_known(offsets, max_buckets)
    same = None
    for n in names:
        c = F.col(n).eqNullSafe(F.col(f"__o{n}"))
        same = c if same is None else same & c
    return (x.join(offsets, same)
            .withColumn(out, (F.col("__off") + F.col("__local")).cast("long"))
            .drop("__local", "__off", *names, *[f"__o{n}" for n in names]))


def rank_by_uniform(df: DataFrame, u: Column, tie: list[Column | str], out: str = "rank",
                    group: list[str] | None = None, buckets: int | None = None,
                    group_card: int | None = None) -> DataFrame:
    """Rank by a uniform [0,1) key (a hash), ties broken by ``tie``. Equal-width
    buckets of the uniform are balanced, so no sampling is needed."""
    b = buckets or default_buckets(df)
    x = df.withColumn("__u", u)
    bucket = [F.col(g) for g in (group or [])] + [F.floor(F.col("__u") * b).cast("int")]
    # offsets have one row per (group, bucket), and one more for null keys
    nb = b + 1 if not group else ((b + 1) * group_card if group_card else None)
    return rank_with_buckets(x, bucket, [F.col("__u"), *tie], out, group, max_buckets=nb).drop("__u")


def rank_by_numeric(df: DataFrame, key: str, out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Rank by a unique numeric key, null keys last (in no set order among
    themselves). Bucket bounds come from approximate quantiles (a bounded
    list of ``buckets`` numbers, like a range partitioner's sample) whose
    error is a quarter of a bucket, so buckets stay balanced for any key
    layout and any number of them."""
    from pyspark.ml.feature import Bucketizer

    b = buckets or default_buckets(df)
    bounds = sorted(set(df.approxQuantile(key, [i / b for i in range(1, b)], 1 / (4 * b)))) if b > 1 else []
    x = df.withColumn("__key", F.col(key).cast("double"))
    if bounds:  # Bucketizer: binary search over the bounds, JVM-side; null keys get the last bucket
        x = Bucketizer(splits=[float("-inf"), *map(float, bounds), float("inf")], inputCol="__key",
                       outputCol="__bucket", handleInvalid="keep").transform(x)
    else:
        x = x.withColumn("__bucket", F.lit(0))
    return rank_with_buckets(x, ["__bucket"], [F.col(key)], out, max_buckets=b + 2).drop("__key", "__bucket")


def dense_id(df: DataFrame, order_key: str, out: str = "ID", tie: str | None = None) -> DataFrame:
    """0..n-1 in the order of ``order_key``, rows without a key last; equal
    keys and rows without one go by the column ``tie`` (without one in the order
    in which they lie).

    Where the key is unique only the key column is ranked (and written once,
    so Spark knows its size); the ids are joined back, so wide rows move only
    if the table of ids is too large to broadcast. Where keys repeat the rows
    themselves are ranked by ranges of (key, tie), and every row keeps exactly
    one id. Rows without a key are ranked by ranges of ``tie``, or numbered
    where they lie, so any share of them is dealt over the tasks. Runs jobs."""
    known, rest = df.where(F.col(order_key).isNotNull()), df.where(F.col(order_key).isNull())
    ids = sized(known.select(order_key))
    n = ids.count()
    if ids.groupBy(order_key).count().where("count > 1").isEmpty():
        ids = sized(rank_by_numeric(ids, order_key, out))
        first = ids if df.columns == [order_key] else known.join(ids, order_key)
    else:
        first = rank_by_order(known, [F.col(order_key)] + ([_last(tie)] if tie else []), out)
    last = _number(sized(rest.withColumn("__at", F.monotonically_increasing_id())), out) if tie is None \
        else rank_by_order(rest, [_last(tie)], out)
    last = last.select(*df.columns, (F.col(out) + F.lit(n)).alias(out))
    return first.select(*df.columns, out).unionByName(last)


def rank_by_order(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Rank by any total order: one range shuffle into ``default_buckets``
    partitions (Spark samples the bounds, so a dominant frequency or prefix
    is split like anything else), a sort inside each, and per-partition
    offsets from a table of one row per partition. Runs a job; meant for
    narrow tables."""
    b = default_buckets(df)
    laid = df.repartitionByRange(b, *order).sortWithinPartitions(*order)
    return _number(sized(laid.withColumn("__at", F.monotonically_increasing_id())), out, b)


def file_order_id(scan: DataFrame, out: str = "ID") -> DataFrame:
    """C3 without a key: 0..n-1 in the order of the files (by path) and of the
    rows in them. ``scan`` is read from files and may be filtered.

    A row's position is (file, byte range, place in the range); only the
    ranges, one row each, are counted and summed up, so no row of ``scan`` is
    shuffled, and repeated rows or keys are rows like any other. Runs a job."""
    x = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                    F.monotonically_increasing_id().alias("__at"))
    ranges = sized(x.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")))
    in_file = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("__file").agg(F.sum("__n").alias("__n"))
    sizes = sizes.select("__file", F.coalesce(F.sum("__n").over(  # one row a file
        Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    offsets = ranges.withColumn("__off", F.coalesce(F.sum("__n").over(in_file), F.lit(0))).join(sizes, "__file").select(
        "__file", "__start", (F.col("__before") + F.col("__off") - F.col("__first")).alias("__shift"))
    shift = F.coalesce("__shift", F.raise_error(F.lit("byte ranges changed between the passes: fix spark.sql.files.minPartitionNum")).cast("bigint"))
    return x.join(offsets, ["__file", "__start"], "left").withColumn(out, (F.col("__at") + shift).cast("long")).drop("__file", "__start", "__at", "__shift")


def _number(laid: DataFrame, out: str, parts: int | None = None) -> DataFrame:
    """Ranks from the written ``__at``: partition number (of at most
    ``parts``) and place in it."""
    part = F.shiftright("__at", 33)
    counts = laid.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__off"))
    if parts is not None:
        offsets = broadcast_known(offsets, parts)
    rank = F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("__part", part).join(offsets, "__part").withColumn(out, rank.cast("long")).drop("__at", "__part", "__off")
