"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are cut into pieces of at most ``capacity`` words. A bin holds no
two pieces of one source and no two pieces of one duplicate cluster (with
``clustered``: the SimHash near-duplicate group, joined with the copies up to
case and white space). Pieces come in order of falling size (then id and piece); open bins are ordered by
residual space, and each bin carries a bitmap of its sources and one of its
duplicate clusters. The successor search starts at the smallest residual that
holds the piece and goes on until the tightest compatible bin is found (the
oldest among equals); if there is none, a bin is opened. Full pieces fill a
bin alone.

Documents are dealt to shards of about ``shard_rows`` rows by a hash of the
id, and each shard is packed as one group, so shards are even whatever the
sources are; only narrow rows are shuffled. At most one partly filled tail per
shard is lost against one global packing.

Defined results: a null text counts as empty; a document without words is
one piece of no words and is placed like any other; null sources conflict
with each other like equal ones; a null cluster conflicts with nothing;
repeated rows are packed each (their ids and clusters are equal, so into
different bins); an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, cut, small

CAPACITY = 2048
SHARD_ROWS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


class Bins:
    """Open bins of one shard, ordered by residual space."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.sources: list[int] = []  # bitmap per bin
        self.clusters: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual, oldest first
        self.having: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # by residual: bins that have a source
        self.used = 0  # bitmap of the residuals that have bins

    def place(self, size: int, source: int, cluster: int | None) -> int:
        """Bin for a piece; ``source`` and ``cluster`` are bit numbers."""
        s, c = 1 << source, 0 if cluster is None else 1 << cluster
        left = self.used >> size
        r = size
        while left:
            skip = (left & -left).bit_length() - 1
            r += skip
            left >>= skip
            bins = self.at[r]
            if self.having[r].get(source, 0) < len(bins):  # else all of them have the source
                for i, b in enumerate(bins):
                    if not self.sources[b] & s and not self.clusters[b] & c:
                        self._take(r, i)
                        return self._put(b, r - size, source, s, c)
            r += 1
            left >>= 1
        self.sources.append(0)
        self.clusters.append(0)
        self.count += 1
        return self._put(self.count - 1, self.capacity - size, source, s, c)

    def _take(self, r: int, i: int) -> None:
        b = self.at[r].pop(i)
        for x in _bits(self.sources[b]):
            self.having[r][x] -= 1
        if not self.at[r]:
            self.used &= ~(1 << r)

    def _put(self, b: int, r: int, source: int, s: int, c: int) -> int:
        self.sources[b] |= s
        self.clusters[b] |= c
        bins = self.at[r]
        i = len(bins)
        while i and bins[i - 1] > b:
            i -= 1
        bins.insert(i, b)
        for x in _bits(self.sources[b]):
            self.having[r][x] = self.having[r].get(x, 0) + 1
        self.used |= 1 << r
        return b


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def pack_rows(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack ``rows(id, source, cluster, size)``; returns
    ``(id, piece, first_word, n_words, bin)``."""
    source_bit = {s: i for i, s in enumerate(sorted(rows["source"].unique()))}
    known = rows["cluster"].dropna()
    twice = known.value_counts()
    cluster_bit = {c: i for i, c in enumerate(sorted(twice[twice > 1].index))}  # a lone one conflicts with nothing
    bins, out, parts = Bins(capacity), [], []
    for i, source, cluster, size in rows[["id", "source", "cluster", "size"]].itertuples(index=False):
        whole, rest = divmod(int(size), capacity)
        n = whole + (rest > 0 or whole == 0)
        bit = None if pd.isna(cluster) else cluster_bit.get(cluster)
        parts += [(capacity if k < whole else rest, i, k, source_bit[source], bit) for k in range(n)]
    parts.sort(key=lambda p: (-p[0], p[1] is None, p[1] if p[1] is not None else 0, p[2], p[3]))
    for size, i, k, source, bit in parts:
        out.append((i, k, k * capacity, size, bins.place(size, source, bit)))
    return pd.DataFrame(out, columns=["id", "piece", "first_word", "n_words", "bin"])


def word_count(text):
    """Number of words of a text column (runs that are not ASCII white
    space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def exact_cluster(text):
    """Cluster of equal texts up to case and white space; null if empty."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))
    return F.when(flat != "", F.xxhash64(flat))


def clustered(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(id_col, source_col, size, cluster)``, one row per row of ``docs``:
    words, and a name of the near-duplicate group (SimHash links and equality
    up to case and white space, closed over both; null without words). Reads
    the texts once. Runs jobs."""
    def run(batches):
        for b in small(batches, 2):
            size, exact, fp = [], [], []
            for t in b.column(2).to_pylist():
                parts = simhash.word_bytes(t)
                flat = b" ".join(parts)
                if not flat.isascii():  # A-Z are lower-case already
                    flat = flat.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
                size.append(len(parts))
                exact.append(xxhash.xxh64_intdigest(flat) if parts else None)
                fp.append(simhash.of_words(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(exact, pa.uint64()).view(pa.int64()),
                 pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "source", "size", "exact", "fp"])

    marked = cut(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
                 .mapInArrow(run, "id bigint, source string, size bigint, exact bigint, fp bigint"))
    known = cut(marked.where("exact is not null").select("exact", "fp").distinct())
    several = known.groupBy("exact").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")  # copies that differ beyond A-Z
    copies = known.join(several, "exact").select("a", F.col("fp").alias("b"))
    root = cut(components(simhash.links(known.select("fp").distinct()).unionByName(copies)))
    named = marked.join(root.withColumnRenamed("node", "fp"), "fp", "left")
    return named.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size",
                        F.when(F.col("exact").isNotNull(), F.coalesce("component", "fp")).alias("cluster"))


def pack_apart(docs: DataFrame, **options) -> DataFrame:
    """``pack`` with the near-duplicate groups of ``docs`` as clusters."""
    return pack(cut(clustered(docs)), size=F.col("size"), cluster=F.col("cluster"), **options)


def pack(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size=None, cluster=None,
         text_col: str = "text", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(id bigint, piece int, first_word bigint, n_words bigint, bin
    bigint)``, one row per piece. ``size`` and ``cluster`` are column
    expressions; by default words and copies of the text. Runs one count."""
    size = word_count(F.col(text_col)) if size is None else size
    cluster = exact_cluster(F.col(text_col)) if cluster is None else cluster
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                         F.col(source_col).isNull().alias("none"), cluster.alias("cluster"), size.alias("size"))
    narrow = narrow.withColumn("source", F.concat(F.when(F.col("none"), "0").otherwise("1"), "source")).drop("none")
    shards = max(1, -(-docs.select(id_col).count() // shard_rows))
    dealt = narrow.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype({"id": "Int64", "cluster": "Int64"}).astype({"id": object, "cluster": object}).where(lambda d: d.notna(), None)
        got = pack_rows(rows, capacity)
        got["bin"] += int(rows["shard"].iloc[0]) << 32
        return got

    return dealt.groupBy("shard").applyInPandas(run, "id bigint, piece int, first_word bigint, n_words bigint, bin bigint")
