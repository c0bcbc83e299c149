"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random directions. Two vectors
at distance s collide in a projection if their values differ by at most the
half-width w; the differences are normal with deviation s, so near pairs
collide in many projections and others in few. Each projection is sorted, the
window centred on every query is cut out of the order, and collisions are
counted per pair; pairs that reach the count threshold are verified by cosine
in double precision. Half-width and threshold are chosen for a recall of
``RECALL`` at the distance of the cosine threshold. Nearer pairs collide more
often, so the recall holds at every distance and for every group, however the
near pairs are spread over distances and vectors.

Work is laid out by the first projection: its order is cut into blocks of
about ``BLOCK`` vectors, and two blocks meet only if their ranges come within
``REACH`` deviations of that distance. A meeting counts collisions
for its block pair and returns per-vector link counts and a spanning set of
links, never the pairs. Equal vectors are merged first.

The count of pairs that collide by chance grows with the square of the number
of vectors, which is inherent in counting one-dimensional collisions.

Defined results: a vector that is null, zero, empty or has null or
non-finite components links with nothing and is its own component; vectors of
different lengths do not link; repeated rows count as other vectors; a null
id takes part, but is never a component's name unless the component has only
null ids; an empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, range_buckets

PROJECTIONS = 16
BLOCK = 4096
RECALL = 0.99
REACH = 3.5
COSINE = 0.9


def directions(dim: int, n: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """``dim x n`` standard normal directions, the same everywhere."""
    return np.random.default_rng((seed, dim)).standard_normal((dim, n))


def collision_chance(width: float, distance: float) -> float:
    return math.erf(width / max(distance, 1e-12) / math.sqrt(2))


def at_least(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))


def calibrate(far: float, recall: float = RECALL, n: int = PROJECTIONS) -> tuple[float, int]:
    """Half-width and count threshold of least cost with the wanted recall
    of pairs at distance ``far``, and so of every nearer pair. Cost:
    collisions counted and pairs verified by chance, at the distance of
    unrelated unit vectors."""
    best = None
    for width in np.linspace(far / 20, 2 * far, 60):
        p, chance = collision_chance(width, far), collision_chance(width, math.sqrt(2))
        for k in range(1, n + 1):
            if at_least(k, n, p) < recall:
                break
            cost = n * chance + 30 * at_least(k, n, chance)
            if best is None or cost < best[0]:
                best = cost, float(width), k
    return best[1], best[2]


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64)
    x = x.reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]  # large components must not overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def in_order(q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every projection: the sorted values and each row's place in them."""
    out = []
    for line in q.T:
        order = np.argsort(line)
        place = np.empty(len(q), np.uint16 if len(q) < 1 << 16 else np.uint32)
        place[order] = np.arange(len(q))
        out.append((line[order], place))
    return out


def count_collisions(p: np.ndarray, laid: list[tuple[np.ndarray, np.ndarray]], width: float) -> np.ndarray:
    """``len(p) x len(q)`` collision counts, where ``laid`` is ``q`` in the
    order of every projection: a row of ``q`` collides with a row of ``p``
    if its place is in the window around that row."""
    counts = np.zeros((len(p), len(laid[0][1])), np.uint8)
    for j, (line, place) in enumerate(laid):
        lo = np.searchsorted(line, p[:, j] - width)
        n = np.searchsorted(line, p[:, j] + width, side="right") - lo
        # places before the window wrap round to numbers beyond it
        counts += place[None, :] - lo.astype(place.dtype)[:, None] < n.astype(place.dtype)[:, None]
    return counts


def block_links(x: np.ndarray, y: np.ndarray | None, width: float, least: int, cosine: float,
                weight_x: np.ndarray, weight_y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside ``x`` (``y`` None) or between ``x`` and ``y``: for the
    rows of both, the summed weight of their partners and a label that is
    equal for rows connected by links (the first such row)."""
    own = y is None
    y, weight_y = (x, weight_x) if own else (y, weight_y)
    a = directions(x.shape[1])
    p, laid = x @ a, in_order(y @ a)
    n = len(x)
    total = n if own else n + len(y)
    partners, label = np.zeros(total, np.int64), np.arange(total)
    shift = 0 if own else n
    for at in range(0, n, 256):
        near = count_collisions(p[at:at + 256], laid, width) >= least
        if own:
            near[:, :at] = False
            near &= np.arange(n)[None, :] > np.arange(at, at + len(near))[:, None]
        hits = int(near.sum())
        if not hits:
            continue
        if hits * 64 > near.size:  # dense: one product verifies all of it
            near &= x[at:at + 256] @ y.T >= cosine
        else:
            r, c = np.nonzero(near)
            for s in range(0, r.size, 1 << 16):
                i, j = r[s:s + (1 << 16)], c[s:s + (1 << 16)]
                bad = np.einsum("ij,ij->i", x[at + i], y[j]) < cosine
                near[i[bad], j[bad]] = False
        rows = np.flatnonzero(near.any(axis=1))
        partners[at:at + len(near)] += near @ weight_y
        partners[shift:shift + len(y)] += weight_x[at:at + len(near)] @ near
        for i in rows.tolist():
            met = np.flatnonzero(near[i]) + shift
            seen = label[met]
            me = label[at + i]
            if (seen != me).any():
                roots = np.unique(np.append(seen, me))
                label[np.isin(label, roots)] = roots[0]
    return partners, label


def _links(vectors: DataFrame, dim: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``(node, partners)`` and ``(a, b)`` for ``vectors(node, mult, v)`` of
    one length."""
    spark = vectors.sparkSession
    far = math.sqrt(2 - 2 * cosine)
    width, least = calibrate(far)
    reach = REACH * far

    def first(batches):
        a = directions(dim)[:, 0]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit_rows(b.column(2), dim) @ a)], names=["node", "mult", "v", "line"])

    laid = cut(vectors.select("node", "mult", "v").mapInArrow(first, "node bigint, mult bigint, v array<double>, line double"))
    n = laid.count()
    blocks = max(1, -(-n // BLOCK))
    bounds = sorted(set(laid.approxQuantile("line", [i / blocks for i in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    low, high = [-math.inf, *bounds], [*bounds, math.inf]
    meet = [(i, j) for i in range(len(low)) for j in range(i, len(low)) if low[j] - high[i] <= reach]
    tasks = spark.createDataFrame([(b, t, side) for t, (i, j) in enumerate(meet) for side, b in enumerate((i, j)) if side == 0 or i != j],
                                  "block int, task int, side int")
    dealt = range_buckets(laid, "line", bounds, "block").join(tasks, "block").select("task", "side", "node", "mult", "v")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        parts = [table.filter(pa.array(side == s)) for s in (0, 1)]
        rows = [unit_rows(t.column("v"), dim) if t.num_rows else None for t in parts]
        node = np.concatenate([t.column("node").to_numpy() for t in parts])
        mult = [t.column("mult").to_numpy() for t in parts]
        partners, label = np.zeros(len(node), np.int64), np.arange(len(node))
        if rows[0] is not None:
            alone = rows[1] is None and not mixed(table)
            if alone:
                partners, label = block_links(rows[0], None, width, least, cosine, mult[0], None)
            elif rows[1] is not None:
                partners, label = block_links(rows[0], rows[1], width, least, cosine, mult[0], mult[1])
        hit = np.flatnonzero(partners)
        return pa.table({"a": node[hit], "b": node[label[hit]], "n": partners[hit]})

    pairs_of_one = {t for t, (i, j) in enumerate(meet) if i == j}

    def mixed(table: pa.Table) -> bool:
        return table.column("task")[0].as_py() not in pairs_of_one

    made = cut(dealt.groupBy("task").applyInArrow(run, "a bigint, b bigint, n bigint"))
    return made.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("partners")), made.select("a", "b")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    cosine: float = COSINE) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row of ``table``.
    Runs jobs; intermediate tables go to the shared folder."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.coalesce(sound, F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(some, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 equals 0.0
    merged = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("mult"))
    # numbered by hash: ``node`` names a distinct vector and is made unique
    merged = cut(merged.withColumn("node", F.monotonically_increasing_id()))
    counts, edges = None, None
    for r in merged.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():  # lengths in use
        one = merged.where(F.size("v") == r["dim"])
        c, e = _links(one, int(r["dim"]), cosine)
        counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
    if counts is None:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    root = components(edges)
    flat = merged.select("node", "low", "mult").join(root, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = flat.groupBy("component").agg(F.min("low").alias("component_id"))
    named = flat.join(names, "component").join(counts, "node", "left").select(
        "node", "component_id", (F.col("mult") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"))
    byv = cut(merged.select("node", "v").join(named, "node").select("v", "component_id", "n_links"))
    out = rows.join(byv, "v", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
