"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of integer vectors x are found
without forming V: every step is a distributed pass that returns
``V Q = 1/n * sum((x - S/n) (x - S/n)' Q)`` for a thin block Q. A pass is
linear, so tasks add up their part, a bounded number of groups add up the
tasks, and the driver holds ``dimension x block`` numbers whatever the rows.

One round is a Rayleigh-Ritz step (QR of the block, the small eigenproblem of
``Q' V Q``, rotation) followed by a Chebyshev polynomial of V, applied by its
three-term recurrence, that stays small on [0, smallest Ritz value of the
block], where the unwanted spectrum lies, and grows fast above it. Rounds end
when every wanted pair's residual is at rounding level (``CERTIFIED`` times
the largest eigenvalue). Where the spectrum is so flat that many more passes
would be needed the block grows; at the full dimension one round is exact.

Vectors are packed once: blocks of rows as integer bytes, so a pass reads
plain arrays.

Defined results: rows with a null vector or a null or non-finite entry are
dropped; null ids and repeated rows stay rows of their own; vectors of
different lengths are whitened apart, each length with its own fit; an entry
beyond 2**52 after scaling saturates; directions without variance (eigenvalue
under 1e-12 of the trace) have no component, so one vector, equal vectors and
empty vectors give no rows; a deviation beyond a long is null, its exact value
is in ``deviation_exact``; an empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sound

COMPONENTS = 8
BLOCK = 32
CERTIFIED = 1e-13
BLOCK_BYTES = 4 << 20
GROUPS = 16
#: A round of the filter damps by about this factor, in at most MOST_DEGREE passes.
DAMPING, MOST_DEGREE = 1e5, 24
#: Passes still to come above which the block grows.
PATIENCE = 150
CAP = float(1 << 52)


# ---- packed rows -------------------------------------------------------------------

def packer(dim: int, scale: float, shift: int):
    def run(batches):
        step = max(1, BLOCK_BYTES // (8 * dim))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                v = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, dim)
                x = np.clip(np.floor(v * scale), -CAP, CAP).astype(np.int64) + shift
                small = np.abs(x).max() < 1 << 31
                ids = part.column(0)
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([listed, pa.array([len(ids)], pa.int32()), pa.array([x.astype(np.int32 if small else np.int64).tobytes()], pa.binary())],
                                                 names=["ids", "rows", "x"])
    return run


def unpack(rows: int, raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * rows * dim else np.int64).reshape(rows, dim).astype(np.int64)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``x - S/n`` by way of the whole number ``n x - S``."""
    d = deviations(x, n, total)
    return (d / n).astype(np.float64) if d.dtype != object else np.array([[float(v) / n for v in r] for r in d])


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n x - S``, as int64 where that and S fit and as whole numbers of any size else."""
    if max(int(np.abs(x).max(initial=0)) * n, max(map(abs, total), default=0)) < 1 << 62:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def squared(d: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 1 << 63:
        return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in r) for r in d.tolist()]


# ---- passes ------------------------------------------------------------------------

def totals(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Row count and exact sums by dimension."""
    def run(batches):
        n, s = 0, [0] * dim
        for b in batches:
            for rows, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = unpack(rows, raw, dim)
                n += rows
                wide = int(np.abs(x).max(initial=0)) * rows >= 1 << 62
                for i, v in enumerate((x.astype(object) if wide else x).sum(axis=0).tolist()):
                    s[i] += v
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in [n, *s]])], names=["at", "s"])

    got = blocks.select("rows", "x").mapInArrow(run, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["at"]: int(r["s"]) for r in got}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dim)]


def summed(blocks: DataFrame, dim: int, length: int, of) -> np.ndarray:
    """The sum over all packed blocks of ``of(x)``, a vector of ``length``
    doubles: by task, then by ``GROUPS`` groups, then on the driver."""
    def run(batches):
        s = np.zeros(length)
        for b in batches:
            for rows, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s += of(unpack(rows, raw, dim))
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["task", "s"])

    def add(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("task").to_pylist(), t.column("s").to_pylist(), strict=True))
        s = np.zeros(length)
        for _, raw in rows:
            s += np.frombuffer(raw)
        return pa.table({"at": pa.array([rows[0][0] % GROUPS], pa.int32()), "s": pa.array([s.tobytes()], pa.binary())})

    parts = blocks.select("rows", "x").mapInArrow(run, "task int, s binary")
    got = parts.groupBy(F.pmod("task", F.lit(GROUPS))).applyInArrow(add, "at int, s binary").collect()
    return sum((np.frombuffer(r["s"]) for r in sorted(got, key=lambda r: r["at"])), np.zeros(length))


def covariance_times(blocks: DataFrame, dim: int, n: int, total: list[int], q: np.ndarray) -> np.ndarray:
    """``V q`` in one pass over the rows."""
    def of(x):
        c = centred(x, n, total)
        return (c.T @ (c @ q)).ravel()
    return summed(blocks, dim, q.size, of).reshape(q.shape) / n


# ---- iteration ---------------------------------------------------------------------

def growth(value: float, edge: float) -> float:
    """Logarithm of the growth per degree at ``value`` over ``[0, edge]``."""
    t = 2.0 * value / edge - 1.0 if edge > 0 else math.inf
    return math.acosh(t) if 1.0 < t < 1e8 else (0.0 if t <= 1.0 else 19.0)


def chebyshev(times, q: np.ndarray, vq: np.ndarray, edge: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of V on ``[0, edge]`` times ``q``;
    ``vq = V q`` is its first pass, ``top`` keeps the numbers in range."""
    half = edge / 2.0
    first = half / (top - half)
    step, old, new = first, q, (vq - half * q) * (first / half)
    for _ in range(degree - 1):
        following = 1.0 / (2.0 / first - step)
        old, new = new, (times(new) - half * new) * (2.0 * following / half) - old * (step * following)
        step = following
    return new


def leading(times, dim: int, wanted: int, block: int = BLOCK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the positive
    semi-definite operator ``times``, certified by their residuals."""
    rng = np.random.default_rng((seed, dim))
    block = min(dim, max(block, wanted))
    q = np.linalg.qr(rng.standard_normal((dim, block)))[0]
    last, stuck = math.inf, 0
    while True:
        vq = times(q)
        small = q.T @ vq
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(float(value[0]), 0.0)
        worst = float(np.linalg.norm(vq - q * value, axis=0)[:wanted].max())
        stuck = stuck + 1 if worst > last / 2 else 0
        if top == 0 or worst <= CERTIFIED * top or q.shape[1] == dim or stuck >= 3 and worst <= 10 * CERTIFIED * top:
            break
        last = worst
        edge = max(float(value[-1]), 1e-12 * top)
        rate = growth(float(value[wanted - 1]), edge)
        if q.shape[1] < dim and (rate <= 0 or math.log(worst / (CERTIFIED * top)) / rate > PATIENCE):
            more = rng.standard_normal((dim, min(dim - q.shape[1], q.shape[1])))
            q, last, stuck = np.linalg.qr(np.hstack([q, more]))[0], math.inf, 0
            continue
        degree = min(MOST_DEGREE, max(2, math.ceil(math.log(2 * DAMPING) / rate)))
        q = np.linalg.qr(chebyshev(times, q, vq, edge, top, degree))[0]
    value, q = np.maximum(value[:wanted], 0.0), q[:, :wanted]
    sign = np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])
    return value, q * np.where(sign == 0, 1.0, sign)


def fit(blocks: DataFrame, dim: int, wanted: int, block: int = BLOCK):
    """``(n, S, values, vectors, trace, identity_error)`` of packed rows."""
    n, total = totals(blocks, dim)
    trace = float(summed(blocks, dim, dim, lambda x: (centred(x, n, total) ** 2).sum(axis=0)).sum()) / n
    if trace <= 0:
        return n, total, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0
    value, q = leading(lambda m: covariance_times(blocks, dim, n, total, m), dim, min(wanted, dim), block)
    use = value > 1e-12 * trace
    value, q = value[use], q[:, use]
    scaled, k = q / np.sqrt(value), len(value)

    def of(x):
        w = centred(x, n, total) @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    s = summed(blocks, dim, k + k * k, of) / n
    cov = s[k:].reshape(k, k) - np.outer(s[:k], s[:k])  # the means are 0 up to rounding
    return n, total, value, q, trace, float(np.abs(cov - np.eye(k)).max())


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
             scale: float = 1024.0, shift: int = 100_000, block: int = BLOCK) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact)``: a row for every remaining vector and component. Runs
    jobs (the passes); packed vectors are written to the shared folder."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound("v"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double, deviation_exact decimal(38,0)")
    out = table.sparkSession.createDataFrame([], schema)
    for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():  # lengths in use
        dim = int(r["dim"])
        if not dim:
            continue
        one = rows.where(F.size("v") == dim)
        blocks = cut(one.mapInArrow(packer(dim, scale, shift), f"ids array<{kind}>, rows int, x binary"))
        n, total, value, q, trace, error = fit(blocks, dim, components, block)
        if not len(value):
            continue
        out = out.unionByName(_rows(blocks, dim, schema, n, total, q / np.sqrt(value), value / trace, error))
    return out


def _rows(blocks: DataFrame, dim: int, schema: str, n: int, total: list[int], scaled: np.ndarray, explained: np.ndarray, error: float) -> DataFrame:
    k = scaled.shape[1]

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                ids, rows, raw = b.column(0)[at].values, b.column(1)[at].as_py(), b.column(2)[at].as_py()
                x = unpack(rows, raw, dim)
                exact = squared(deviations(x, n, total))
                w = centred(x, n, total) @ scaled
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                    pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(pa.array(each)), pa.array(w.ravel()),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                    pa.array([_decimal(v) for v in exact], pa.decimal128(38, 0)).take(pa.array(each))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])
    return blocks.select("ids", "rows", "x").mapInArrow(run, schema)


def _decimal(v: int):
    from decimal import Decimal
    return Decimal(v) if v < 10 ** 38 else None
