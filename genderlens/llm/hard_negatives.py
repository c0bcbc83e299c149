"""Hard-negative mining by exact integer products.

Components are scaled and floored to int64. Anchors and candidates are cut
into tiles, and a tile pair is multiplied by Strassen's recursion: operands
are padded with zeros to even sides and seven half-size products replace
eight, down to ``LEAF``. All additions are integer additions. They may wrap
around inside the recursion, which is harmless modulo 2**64 because the scores
themselves fit.

Two passes share that product. The first one meets anchors with candidates of
their label and keeps a heap of the best ``positives`` per anchor; the second
one meets them with all candidates, masks the own label, and keeps a heap of
the best ``negatives`` per anchor and window, where a positive's score sets
the window. A heap is a set of rows of bounded number per anchor, and merging
heaps is taking the best rows of their union, so tiles, groups and tasks merge
in any order.

Anchors are dealt into groups of at most about ``ANCHORS`` rows and candidates
into groups of at most about ``CANDIDATES``, by a hash of the row's number;
every anchor group meets every candidate group (of its label in the first
pass) in one task each. A label may hold any share of the rows: it only has
more groups.

Defined results: rows with a null label or vector, or with a null or
non-finite component take no part; a null id is never an anchor unless the
caller says so, and comes last among equal scores; repeated rows are rows of
their own, only the anchor's very row is left out; vectors of different
lengths are padded with zeros, an empty one scores 0 with every other;
scaled components saturate at 2**27, so that products of up to 511
components stay in int64; an empty table or a label without partners gives no
rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_known
from .common import cut, sound

ANCHORS = 8192
CANDIDATES = 65536
LEAST_GROUP = 4096
LEAF = 32
TILE_ROWS, TILE_COLS = 512, 4096
NONE = np.iinfo(np.int64).min
CAP = float(1 << 27)


# ---- the product -------------------------------------------------------------------

def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` modulo 2**64. Where no sum can reach 2**53 the doubles of
    the linear-algebra library give the same integers faster."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    top = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if top < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product ``a @ b``, exact modulo 2**64."""
    p, q, r = a.shape[0], a.shape[1], b.shape[1]
    if min(p, q, r) <= leaf:
        return leaf_product(a, b)
    if p % 2 or q % 2:
        a = np.pad(a, ((0, p % 2), (0, q % 2)))
    if q % 2 or r % 2:
        b = np.pad(b, ((0, q % 2), (0, r % 2)))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), np.int64)
    out[:i, :k] = m1 + m4 - m5 + m7
    out[:i, k:] = m3 + m5
    out[i:, :k] = m2 + m4
    out[i:, k:] = m1 - m2 + m3 + m6
    return out[:p, :r]


# ---- heaps ------------------------------------------------------------------------

def best(row: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` entries of every row by falling score, then place."""
    order = np.lexsort((place, -score, row))
    row, score, place = row[order], score[order], place[order]
    first = np.searchsorted(row, row)
    keep = np.arange(row.size) - first < k
    return row[keep], score[keep], place[keep]


def tops(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best`` of a matrix whose entries ``NONE`` do not count."""
    hit = scores > NONE
    if scores.shape[1] > k:
        hit &= scores >= np.partition(scores, -k, axis=1)[:, -k][:, None]
    row, col = np.nonzero(hit)
    return best(row, scores[row, col], col, k)


def merge(heap, more, k: int):
    """The heap of two heaps' union."""
    if heap is None:
        return more
    return best(*(np.concatenate(x) for x in zip(heap, more, strict=True)), k)


# ---- tasks ------------------------------------------------------------------------

def pack(scale: float):
    """Vectors as int64 bytes, floored after scaling."""
    def run(batches):
        for b in batches:
            v = b.column(b.schema.names.index("v"))
            start = np.asarray(v.offsets, np.int64)
            flat = np.asarray(v.values, np.float64)[start[0]:start[-1]]
            start = start - start[0]
            x = np.clip(np.floor(flat * scale), -CAP, CAP).astype(np.int64)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(start * 8), pa.py_buffer(x)])
            cols = [*(b.column(c) for c in ("id", "label", "anchor")), data.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "anchor", "x"])
    return run


def matrix(column, dim: int | None = None) -> np.ndarray:
    """The packed rows as a matrix, padded with zeros to ``dim``."""
    rows = [np.frombuffer(x, np.int64) for x in column.to_pylist()]
    dim = max((len(r) for r in rows), default=0) if dim is None else dim
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _sides(left: pa.Table, right: pa.Table):
    """Both matrices and the candidates by id, null ids last."""
    right = right.take(pa.array(np.lexsort((right.column("key").to_numpy(), right.column("id").fill_null(0).to_numpy(),
                                            right.column("id").is_null().to_numpy()))))
    a, b = matrix(left.column("x")), matrix(right.column("x"))
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (a, b))
    return a, b, right


def _scores(a: np.ndarray, b: np.ndarray):
    """(first anchor, first candidate, scores) tile by tile."""
    for i in range(0, len(a), TILE_ROWS):
        for j in range(0, len(b), TILE_COLS):
            yield i, j, strassen(a[i:i + TILE_ROWS], b[j:j + TILE_COLS].T)


def best_positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heap = None
        if left.num_rows and right.num_rows:
            a, b, right = _sides(left, right)
            own, keys = left.column("key").to_numpy(), right.column("key").to_numpy()
            for i, j, s in _scores(a, b):
                s[own[i:i + TILE_ROWS, None] == keys[None, j:j + TILE_COLS]] = NONE
                row, score, place = tops(s, k)
                heap = merge(heap, (row + i, score, place + j), k)
        row, score, place = heap if heap is not None else (np.zeros(0, np.int64),) * 3
        return pa.table({"key": left.column("key").take(pa.array(row)), "score": pa.array(score), "id": right.column("id").take(pa.array(place))})
    return run


def best_in_windows(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heap, width = None, 1
        if left.num_rows and right.num_rows:
            a, b, right = _sides(left, right)
            wanted = [left.column(c).to_pylist() for c in ("low", "high")]
            width = max(map(len, wanted[0]))
            low, high = np.zeros((len(a), width), np.int64), np.full((len(a), width), -1, np.int64)  # empty where an anchor has fewer
            for m, lists in zip((low, high), wanted, strict=True):
                for i, x in enumerate(lists):
                    m[i, :len(x)] = x
            mine, theirs = left.column("label").to_numpy(), right.column("label").to_numpy()
            for i, j, s in _scores(a, b):
                s[mine[i:i + TILE_ROWS, None] == theirs[None, j:j + TILE_COLS]] = NONE
                for w in range(width):
                    lo, hi = low[i:i + TILE_ROWS, w, None], high[i:i + TILE_ROWS, w, None]
                    row, score, place = tops(np.where((s >= lo) & (s <= hi), s, NONE), k)
                    heap = merge(heap, ((row + i) * width + w, score, place + j), k)
        row, score, place = heap if heap is not None else (np.zeros(0, np.int64),) * 3
        return pa.table({"key": left.column("key").take(pa.array(row // width)), "place": pa.array(row % width + 1, pa.int32()),
                         "score": pa.array(score), "id": right.column("id").take(pa.array(place))})
    return run


def _first(found: DataFrame, by: list[str], k: int, out: str) -> DataFrame:
    """Merge the heaps of all groups: at most ``k`` rows came from each."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def _part(groups, seed: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(seed)), groups).cast("int")


def _apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own: both sides of a cogroup come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _each(groups) -> Column:
    return F.explode(F.sequence(F.lit(0), (groups - 1).cast("int")))


def hard_negatives(table: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for the rows where ``anchor`` holds, their best rows of
    the same label, and for each of these the best rows of other labels whose
    score lies from ``low`` to ``high`` percent of the positive's. Runs jobs
    (packed rows and positives are written to the shared folder)."""
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("label").isNotNull() & sound("v"))
    packed = cut(rows.mapInArrow(pack(scale), "id bigint, label bigint, anchor boolean, x binary")
                 .withColumn("key", F.monotonically_increasing_id()))
    counted = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("anchor").cast("bigint")), F.lit(0)).alias("a")).first()
    tasks = 2 * table.sparkSession.sparkContext.defaultParallelism
    size = min(CANDIDATES, max(LEAST_GROUP, -(-counted["n"] // tasks)))
    # labels beyond one group: at most n / size of them
    large = packed.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("bigint")).alias("a")).where(F.col("n") > size)
    large = cut(large.select("label", F.ceil(F.col("n") / size).alias("nc"), F.greatest(F.lit(1), F.ceil(F.col("a") / ANCHORS)).alias("na")))
    dealt = packed.join(broadcast_known(large, counted["n"] // size), "label", "left").fillna(1, ["nc", "na"])
    by = ["label", "pa", "pc"]
    ours = dealt.where("anchor").withColumn("pa", _part(F.col("na"), 1)).select("key", "x", "label", "pa", _each(F.col("nc")).alias("pc"))
    theirs = dealt.withColumn("pc", _part(F.col("nc"), 2)).select("key", "id", "x", "label", "pc", _each(F.col("na")).alias("pa"))
    found = _apart(ours).groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(best_positives(positives), "key bigint, score bigint, id bigint")
    pos = cut(_first(found, ["key"], positives, "place"))

    # 100 * n >= low * p and 100 * n <= high * p as bounds of n, in whole numbers
    p = F.col("score").cast("decimal(38,0)")
    windows = pos.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(  # at most ``positives`` entries
        "place", F.ceil(p * low / 100).cast("bigint").alias("low"), F.floor(p * high / 100).cast("bigint").alias("high")))).alias("w"))
    na, nc = max(1, -(-counted["a"] // ANCHORS)), max(1, -(-counted["n"] // size))
    by = ["pa", "pc"]
    ours = packed.where("anchor").join(windows, "key").withColumn("pa", _part(F.lit(na), 1)).select(
        "key", "x", "label", F.col("w.low").alias("low"), F.col("w.high").alias("high"), "pa", _each(F.lit(nc)).alias("pc"))
    theirs = packed.withColumn("pc", _part(F.lit(nc), 2)).select("key", "id", "x", "label", "pc", _each(F.lit(na)).alias("pa"))
    found = _apart(ours).groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(
        best_in_windows(negatives), "key bigint, place int, score bigint, id bigint")
    neg = _first(found, ["key", "place"], negatives, "rank").withColumnsRenamed({"score": "negative_score", "id": "negative_id"})
    named = packed.where("anchor").select("key", F.col("id").alias("anchor_id"))
    pos = pos.withColumnsRenamed({"score": "positive_score", "id": "positive_id"})
    return neg.join(pos, ["key", "place"]).join(named, "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
