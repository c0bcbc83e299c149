"""Joins whose keys repeat as words do: a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that a head may have.
HEAD = 1000
#: Most hashes that a filter holds: 8 bytes each, and as much again for their table.
HASHES = 1 << 20


def known_bytes(df: DataFrame) -> int:
    """The planner's size of a table that was written and read back."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcasts(df: DataFrame) -> bool:
    """Whether the planner broadcasts the written table ``df`` by its size."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= known_bytes(df) <= limit


def head_of(counted: DataFrame, key: str, n: str = "n", head: int = HEAD) -> DataFrame:
    """The keys of ``counted(key, n)`` with more than one ``head``-th of all
    rows: fewer than ``head`` keys, whatever the table."""
    total = counted.agg(F.sum(n).alias("n")).first()["n"] or 0
    return counted.where(F.col(n) * head > total).select(key)


def most_frequent(counted: DataFrame, key: str, rows: int, n: str = "n") -> DataFrame:
    """At most ``rows`` keys of ``counted(key, n)``: all that are more frequent
    than some number. Only the distinct numbers, whose sum is at most that of
    all rows, come to the driver."""
    taken, least = 0, None
    for x in counted.groupBy(n).agg(F.count("*").alias("keys")).orderBy(F.col(n).desc()).toLocalIterator():
        taken += x["keys"]
        if taken > rows:
            break
        least = x[n]
    return counted.where(F.col(n) >= least).select(key) if least is not None else counted.select(key).limit(0)


def only_met(df: DataFrame, left: list[Column | str], table: DataFrame, right: list[Column | str]) -> DataFrame:
    """The rows of ``df`` that may have a partner in the written ``table``:
    ``left`` equals ``right``. Rows stay where they are: hashes of the table's
    keys are broadcast, ``HASHES`` at most, as beyond that many rows they are
    cut short and let more pass. An exact join has to follow."""
    short = table.count() > HASHES

    def hashed(columns):
        h = F.xxhash64(*columns)
        return (F.pmod(h, F.lit(HASHES)) if short else h).alias("__hash")

    keys = table.select(hashed(right)).distinct()
    return df.select("*", hashed(left)).join(F.broadcast(keys), "__hash", "left_semi").drop("__hash")


def join_hot(pairs: DataFrame, table: DataFrame, key: str, top: DataFrame | Callable[[], DataFrame], how: str = "inner") -> DataFrame:
    """``pairs`` joined (inner or left) with ``table`` (a written table, unique
    in ``key``).

    A table that the planner broadcasts is joined as it is. Beyond that size
    the head of the keys (``top``: fewer than ``HEAD`` rows, or what makes them)
    is broadcast with its rows of ``table``, and only the tail is shuffled, of
    which no key has more than one ``HEAD``-th of the rows. Either way no task
    depends on how often a key occurs."""
    if broadcasts(table):
        return pairs.join(table, key, how)
    top = F.broadcast(top() if callable(top) else top)
    hot = F.broadcast(table.join(top, key, "left_semi"))
    return pairs.join(top, key, "left_semi").join(hot, key, how).unionByName(pairs.join(top, key, "left_anti").join(table, key, how))


def join_known(pairs: DataFrame, hot: DataFrame, tail: DataFrame | None, key: str, how: str = "inner") -> DataFrame:
    """``pairs`` joined (inner or left) with a table that is given as its ``hot``
    rows, whose number has a static bound, and its ``tail`` (None: there is
    none). The hot rows are broadcast, and only pairs of other keys are
    shuffled."""
    known = pairs.join(F.broadcast(hot), key, how if tail is None else "inner")
    if tail is None:
        return known
    return known.unionByName(pairs.join(F.broadcast(hot.select(key)), key, "left_anti").join(tail, key, how))
