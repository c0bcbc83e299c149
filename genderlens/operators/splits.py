"""Seeded splits, condition datasets, shuffles and batches (Q1-Q5, Q9, Q11).

Seeded randomness is a key hash (``md5(id:seed)``), so results do not
depend on partitioning or on re-execution after a lost executor. Exact
split sizes come from a cut key found on narrow columns (rows are not
shuffled); full orders (shuffle, batches) use the bucketed dense rank
(``ranking``), never a single-partition window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions.rand import hash_uniform
from ..session import sized
from .joins import head_of, join_hot
from .ranking import default_buckets, rank_by_uniform


def order_key(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed))))


def key_uniform(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return hash_uniform(c.cast("string"), F.lit(str(seed)))


def seeded_rank(df: DataFrame, id_col: str, seed: int, out: str = "rank",
                group: list[str] | None = None, group_card: int | None = None) -> DataFrame:
    """0-based position in the seeded order (md5(id:seed), then id)."""
    return rank_by_uniform(df, key_uniform(id_col, seed), [order_key(id_col, seed), F.col(id_col)],
                           out, group=group, group_card=group_card)


def _cut_keys(df: DataFrame, id_col: str, seed: int, n_test: dict, buckets: int) -> dict:
    """The (key, id) of the row at 0-based seeded position ``n_test[0] - 1``.
    Only narrow columns are read: per-bucket counts locate the bucket holding
    the cut, and only that bucket's rows are ranked."""
    x = df.select(F.lit(0).alias("__g"), F.col(id_col).alias("__id"),
                  F.floor(key_uniform(id_col, seed) * buckets).cast("int").alias("__b"),
                  order_key(id_col, seed).alias("__k"))
    counts = {}
    for r in x.groupBy("__g", "__b").count().collect():  # <= buckets x groups rows
        counts.setdefault(r["__g"], []).append((r["__b"], r["count"]))
    target = {}
    for g, need in n_test.items():
        if need <= 0:
            continue
        seen = 0
        for bkt, c in sorted(counts.get(g, [])):
            if seen + c >= need:
                target[g] = (bkt, need - 1 - seen)
                break
            seen += c
    if not target:
        return {}
    cond, want = None, None
    for g, (bkt, pos) in target.items():
        c = F.col("__g").eqNullSafe(F.lit(g)) & (F.col("__b") == bkt)
        cond = c if cond is None else (cond | c)
        wc = F.col("__g").eqNullSafe(F.lit(g)) & (F.col("__r") == pos)
        want = wc if want is None else (want | wc)
    # rank only the rows of the target bucket(s); only the cut rows (one
    # per group) reach the driver
    w = Window.partitionBy("__g").orderBy("__k", "__id")
    picked = (x.filter(cond).withColumn("__r", F.row_number().over(w) - 1)
              .filter(want).select("__g", "__k", "__id").collect())
    return {r["__g"]: (r["__k"], r["__id"]) for r in picked}


def _buckets(df: DataFrame, n: int, buckets: int | None) -> int:
    """Enough hash buckets that one holds at most ~2M rows on average."""
    return buckets or max(default_buckets(df), math.ceil(n / 2_000_000))


def _assign(df: DataFrame, id_col: str, seed: int, cuts: dict) -> DataFrame:
    k, i = order_key(id_col, seed), F.col(id_col)
    test = F.lit(False)
    for kt, it in cuts.values():
        test = (k < F.lit(kt)) | ((k == F.lit(kt)) & (i <= F.lit(it)))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def split(df: DataFrame, id_col: str = "ID", test_size: float = 0.3, seed: int = 123,
          buckets: int | None = None) -> DataFrame:
    """Q1: exact split, test = the first ceil(test_size * n) rows of the
    seeded order (md5(id:seed), then id).

    The rows themselves are never shuffled: narrow passes find the cut key
    (see ``_cut_keys``) and each row is labelled by comparing with it."""
    n = df.count()
    cuts = _cut_keys(df, id_col, seed, {0: math.ceil(test_size * n)}, _buckets(df, n, buckets))
    return _assign(df, id_col, seed, cuts)


def stratified_split(df: DataFrame, label: str, id_col: str = "ID", test_size: float = 0.3,
                     seed: int = 123, buckets: int | None = None) -> DataFrame:
    """Q2: the same per label: test = first ceil(test_size * n_label) rows of
    each label's seeded order, for any number of labels (null is one).

    All cuts are found at once on tables. Narrow rows are counted by label
    and hash bucket; a running sum over a label's buckets names the bucket that
    holds its cut, only the rows of these buckets are ranked, and the cut keys
    (a row per label) are joined to the rows. A dominant label has many buckets,
    and its cut is broadcast with those of the other frequent labels. Runs
    jobs; nothing is collected but the row count."""
    b = _buckets(df, df.count(), buckets)
    g = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    x = df.select(g.alias("__g"), F.col(id_col).alias("__id"), F.floor(key_uniform(id_col, seed) * b).cast("int").alias("__b"),
                  order_key(id_col, seed).alias("__k"))
    counts = sized(x.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__c")))
    sizes = sized(counts.groupBy("__g").agg(F.sum("__c").alias("n")))
    run = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``b`` rows
    need = F.ceil(F.lit(test_size) * F.col("n"))
    seen = counts.withColumn("__s", F.sum("__c").over(run)).join(sizes.select("__g", need.alias("__need")), "__g")
    target = sized(seen.where((F.col("__s") >= F.col("__need")) & (F.col("__s") - F.col("__c") < F.col("__need")))
                   .select("__g", "__b", (F.col("__need") - (F.col("__s") - F.col("__c"))).alias("__at")))
    w = Window.partitionBy("__g").orderBy("__k", "__id")  # one bucket of a label
    cuts = sized(x.join(target, ["__g", "__b"]).withColumn("__r", F.row_number().over(w)).where("__r = __at")
                 .select("__g", F.col("__k").alias("__kt"), F.col("__id").alias("__it")))
    y = df.withColumn("__g", g)
    y = join_hot(y, cuts, "__g", lambda: head_of(sizes, "__g"), "left")
    k, i = order_key(id_col, seed), F.col(id_col)
    test = F.coalesce((k < F.col("__kt")) | ((k == F.col("__kt")) & (i <= F.col("__it"))), F.lit(False))
    return y.select(*df.columns, F.when(test, "test").otherwise("train").alias("split"))


def _by_split(masked: DataFrame, tag: str, train: list, test: list) -> DataFrame:
    """One pass: each row emits a row per (name, text column) of its split."""
    def rows(sets):
        kind = f"array<struct<{tag}:string,text:string>>"
        return F.array(*[F.struct(F.lit(n).alias(tag), F.col(c).alias("text")) for n, c in sets]).cast(kind)

    chosen = F.when(F.col("split") == "train", rows(train)).when(F.col("split") == "test", rows(test))
    x = masked.select("ID", "Sentiment", F.explode(chosen).alias("__x"))
    return x.select("ID", F.col(f"__x.{tag}").alias(tag), F.col("__x.text").alias("text"), "Sentiment")


def condition_sets(masked: DataFrame) -> DataFrame:
    """Q3: original / neutral training sets and all-male / all-female test
    sets as one long table (condition, ID, text, Sentiment), from one scan."""
    return _by_split(masked, "condition", [("original_train", "Review_cleaned"), ("neutral_train", "text_all_neutral")],
                     [("all_male_test", "text_all_male"), ("all_female_test", "text_all_female")]).select(
                         "condition", "ID", "text", "Sentiment")


def mix_set(masked: DataFrame) -> DataFrame:
    """Q4: male and female rewrites of the same training rows (IDs repeat;
    ``variant`` tells them apart), from one scan."""
    return _by_split(masked, "variant", [("male", "text_all_male"), ("female", "text_all_female")], [])


def head_subset(df: DataFrame, id_col: str = "ID", k: int = 250, seed: int = 123) -> DataFrame:
    """Q5: the first k rows of the seeded order (a top-k, so the limit is the
    feature; Spark plans it as a bounded TakeOrderedAndProject)."""
    return df.orderBy(order_key(id_col, seed), F.col(id_col)).limit(k)


def seeded_shuffle(df: DataFrame, key: Column, seed: int = 123, out: str = "order") -> DataFrame:
    """Q9: seeded shuffle order of any table; ``key`` must be unique per row."""
    x = df.withColumn("__k", key.cast("string"))
    return rank_by_uniform(x, hash_uniform(F.col("__k"), F.lit(str(seed))),
                           [F.md5(F.concat_ws(":", F.col("__k"), F.lit(str(seed)))), F.col("__k")],
                           out).drop("__k")


def batches(df: DataFrame, order: str, size: int = 16, out: str = "batch") -> DataFrame:
    """Q11: consecutive batches of ``size`` along a dense order."""
    return df.withColumn(out, F.floor(F.col(order) / size).cast("long"))
