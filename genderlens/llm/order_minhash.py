"""Order MinHash fingerprints of whole texts.

Every k-mer of code points gets its occurrence number (the second "abcde" of
a text differs from the first), so the items of a text are distinct. For each
of ``BINS`` hash functions the ``PICKED`` items with the smallest hashes are
selected, put back in text order, and the tuple of their k-mers is hashed into
one signature element: moving text about changes elements even where the set
of k-mers does not. The hash functions are one permutation cut into bins
(one-permutation hashing): an item's 64-bit hash names its bin by the top
bits and its rank in the bin by the rest, so the cost does not grow with the
number of bins.

Likeness of two fingerprints: equal elements over the bins that are used by
at least one of them; two empty texts have likeness 1. A text shorter than k
is one k-mer. Equal texts have equal fingerprints.

The successor order (next document by descending id, the first after the
last) is dealt over range buckets of the id: each bucket holds its documents
and a guest copy of the first document of the next bucket, so every text is
shuffled once and no window spans the table.

Defined results: a null text counts as empty; a null id sorts after all
others; rows of equal id are ordered by text (descending); a single document
is its own successor; an empty table gives an empty result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_buckets, small


K = 8
BINS = 64
PICKED = 2
EMPTY = np.uint32(0)
PLACE = 26
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of a public mixing function)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each k-mer of code points (uint32), in text order."""
    n = codes.size
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h *= np.uint64(_BASE)
        h += codes[i:n - k + 1 + i]
    return mix(h)


def ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper bits of ``h`` in order, ties by position, and the positions.
    ``PLACE`` low bits are given up for the position, whatever the length."""
    low = np.uint64((1 << PLACE) - 1)
    if h.size > int(low):
        pos = np.argsort(h & ~low, kind="stable")
        return (h & ~low)[pos], pos
    tagged = np.sort((h & ~low) | np.arange(h.size, dtype=np.uint64))
    return tagged & ~low, (tagged & low).astype(np.int64)


def signature(codes: np.ndarray, k: int = K) -> np.ndarray:
    """``BINS`` uint32 elements; ``EMPTY`` marks a bin without an item."""
    out = np.full(BINS, EMPTY, np.uint32)
    h = kmers(codes, k)
    if not h.size:
        return out
    # occurrence numbers: order by hash and, within it, by position
    base, pos = ordered(h)
    first = np.concatenate(([True], base[1:] != base[:-1]))
    starts = np.flatnonzero(first)
    number = np.arange(h.size) - np.repeat(starts, np.diff(np.concatenate((starts, [h.size]))))
    items = mix(base + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    # the smallest items of each bin; ``pos`` goes along
    back = np.empty(h.size, np.uint64)
    back[pos] = items
    ranked, pos = ordered(back)
    bins = (ranked >> np.uint64(64 - 6)).astype(np.int64)
    begin = np.searchsorted(bins, np.arange(BINS))
    end = np.searchsorted(bins, np.arange(BINS), side="right")
    used = np.flatnonzero(end > begin)
    picks = np.full((used.size, PICKED), -1, np.int64)
    for j in range(PICKED):
        has = begin[used] + j < end[used]
        picks[has, j] = pos[begin[used][has] + j]
    picks.sort(axis=1)  # back in text order; missing ones (-1) first
    acc = np.zeros(used.size, np.uint64)
    for j in range(PICKED):
        at = picks[:, j]
        acc = mix(acc * np.uint64(_BASE) + np.where(at >= 0, h[at] | np.uint64(1), np.uint64(0)))
    out[used] = np.maximum((acc >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    return out


def codes_of(text: str | None) -> np.ndarray:
    """Code points of a text; an empty array for null."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal elements over bins used by either fingerprint."""
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    return float(((a == b) & used).sum()) / n if n else 1.0


def hex_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``(id, fingerprint)`` per row; nothing is shuffled."""
    def run(batches):
        for b in small(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hex_of(signature(codes_of(t), k)) for t in b.column(1).to_pylist()], pa.string())],
                names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")


def in_succession(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 10_000) -> tuple[DataFrame, int]:
    """``(bucket, id, text, guest)`` and the number of buckets: documents
    dealt to range buckets of the id (bucket 0 has the largest ids), and in
    each bucket as a guest the first document that follows its last one. Runs
    narrow jobs on the ids."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, min(-(-d.select("id").count() // rows_per_bucket), 50_000))
    bounds = sorted(set(d.select("id").approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    up = range_buckets(d, "id", bounds, "bucket")  # null ids come last, after the smallest ids
    dealt = up.withColumn("bucket", F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(len(bounds) - F.col("bucket")))
    # one row per bucket: its first document's (id, text digest)
    buckets = len(bounds) + 2
    heads = dealt.groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()
    if not heads:
        return dealt.withColumn("guest", F.lit(False)), buckets
    rows = [(heads[(i + 1) % len(heads)]["id"], heads[i]["bucket"]) for i in range(len(heads))]
    hosts = spark.createDataFrame(rows, "gid bigint, gbucket int")  # a row per bucket: bounded by ``n``
    guests = dealt.join(F.broadcast(hosts), F.col("id").eqNullSafe(F.col("gid")))
    # rows that repeat the head's id: the one that sorts first
    guests = guests.groupBy("gbucket", "id").agg(F.max("text").alias("text"))
    return dealt.withColumn("guest", F.lit(False)).unionByName(
        guests.select(F.col("gbucket").alias("bucket"), "id", "text", F.lit(True).alias("guest"))), buckets


def successor_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last half
    replaced by the start of the next document) and the likeness of its
    fingerprint to both (see the module's contract)."""
    def run(batches):
        ahead = None  # (bucket, id, text, codes, signature, guest) that waits for its successor
        for b in small(batches, 2):
            out = []
            for bucket, i, text, guest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = codes_of(text)
                now = (bucket, i, codes, signature(codes, k), guest)
                if ahead is not None and ahead[0] == bucket:
                    out.append(row(ahead, now))
                ahead = now
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def row(cur, nxt):
        codes, sig = cur[2], cur[3]
        half = codes.size // 2
        edited = np.concatenate((codes[:codes.size - half], nxt[2][:half]))
        other = signature(edited, k)
        raw = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return {"doc_id": cur[1], "n_chars": codes.size, "edited_sha256": hashlib.sha256(raw).hexdigest(),
                "fingerprint": hex_of(sig), "edited_fingerprint": hex_of(other),
                "near_edited": likeness(sig, other), "near_next": likeness(sig, nxt[3])}

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    dealt, buckets = in_succession(docs, id_col, text_col)
    # a bucket is a partition: hashed, some tasks would get several of them
    laid = dealt.repartitionById(buckets, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("id").desc_nulls_last(), F.coalesce("text", F.lit("")).desc())
    return laid.select("bucket", "id", "text", "guest").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
