"""SimHash near-duplicate groups through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that
differ in at most ``MAX_BITS`` = 4 bits differ in at most one bit of some
segment (4 // 3 = 1). Each segment is indexed by its one-wildcard variants
(one bit position blanked): two segment values differ by at most one bit
exactly when they share a variant. Distinct fingerprints meet by equality on
(segment, blanked position, remaining bits), and every meeting is verified on
all 64 bits.

Inside one variant bucket a breadth-first walk links each fingerprint to the
first one that reaches it, so a bucket of k fingerprints yields at most k - 1
links and needs 8 k bytes; the groups are then joined across buckets as
connected components. Copies share one fingerprint and never multiply.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; texts of fewer words than a
shingle hash the whole word sequence; repeated rows keep one row each; an
empty table gives an empty result. Extra columns are ignored. A row with a
null id keeps its fingerprint; its group id is the smallest non-null id of
the group (null if there is none)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: (shift, width) of the three segments of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Runs up to this size compare neighbours batch-wise; longer ones are walked.
SHORT_RUN = 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text: lower-cased A-Z, words split
    at ASCII white space, word shingles with repeats, XXH64 with seed 42; a
    bit is set if it is set in over half of the shingle hashes."""
    return of_words(word_bytes(text), words)


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def of_words(parts: list[bytes], words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's words."""
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(flat[a:b], SEED) for a, b in zip(starts[:len(parts) - k + 1].tolist(), ends[k - 1:].tolist(),
                                                          strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id bigint, fp bigint)``, one row per input row; ``fp`` holds the
    64 bits as a signed number."""
    def run(batches):
        for b in small(batches, 1):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id bigint, fp bigint")


def variants(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: the 64 one-wildcard segment variants of each value."""
    keys = []
    for shift, width in SEGMENTS:
        seg = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        for p in range(width):
            blank = seg.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << p)).cast("bigint"))
            keys.append(blank.bitwiseOR(F.lit((shift + p) << 22).cast("bigint")))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def walk(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph that joins values at ``max_bits`` or
    fewer differing bits, by breadth-first search over what is unreached."""
    left, a, b = values, [], []
    while left.size > 1:
        frontier, left = [left[:1]], left[1:]
        while frontier and left.size:
            for x in frontier.pop():
                near = np.bitwise_count(left ^ x) <= max_bits
                if near.any():
                    new = left[near]
                    a.append(np.full(new.size, x, values.dtype))
                    b.append(new)
                    left = left[~near]
                    frontier.append(new)
    if not a:
        return values[:0], values[:0]
    return np.concatenate(a), np.concatenate(b)


def run_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys (``keys`` are sorted)."""
    if keys.size < 2:
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [keys.size])))
    rest = (starts[:, None][sizes > 1][:, 0], sizes[sizes > 1])
    a, b = [], []
    short = rest[1] <= SHORT_RUN
    s, z = rest[0][short], rest[1][short]
    for gap in range(1, SHORT_RUN):
        s, z = s[z > gap], z[z > gap]
        if not s.size:
            break
        for first in range(SHORT_RUN - gap):
            i = s[z > first + gap] + first
            if not i.size:
                break
            hit = np.bitwise_count(fps[i] ^ fps[i + gap]) <= max_bits
            a.append(fps[i[hit]])
            b.append(fps[i[hit] + gap])
    for at, n in zip(rest[0][~short].tolist(), rest[1][~short].tolist(), strict=True):
        x, y = walk(fps[at:at + n], max_bits)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified links ``(a, b)`` between the distinct values of
    ``fps(fp bigint)`` that keep every connection at ``max_bits`` or fewer
    differing bits (``max_bits`` of at most 5, as three segments allow)."""
    if not 0 <= max_bits <= 5:
        raise ValueError("three segments find up to five differing bits")

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(k, f):
            a, b = run_links(k, f, max_bits)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))],
                                              names=["a", "b"])

        for batch in batches:
            k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not k.size:
                continue
            done = int(np.searchsorted(k, k[-1]))  # the last run may go on in the next batch
            if done:
                yield emit(k[:done], f[:done])
            held_k, held_f = k[done:], f[done:]
        if held_k.size:
            yield emit(held_k, held_f)

    met = variants(fps).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` by row, and ``(fp, component_id, root)``: the group's
    smallest id and its smallest fingerprint, which names it."""
    marked = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("low")))
    joined = components(links(distinct.select("fp"), max_bits))
    root = joined.withColumnsRenamed({"node": "fp", "component": "root"})
    linked = distinct.join(root, "fp")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    # only linked fingerprints can change their group id
    moved = cut(linked.join(low, "root").select("fp", "root", "component_id"))
    named = cut(distinct.join(moved, "fp", "left").select(
        "fp", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return marked, named


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(id, fp, component_id)``: each row's fingerprint and the smallest
    id reachable over links. Runs jobs (fingerprints and links are written
    to the shared folder)."""
    marked, named = _grouped(docs, id_col, text_col, words, max_bits)
    return marked.join(named, "fp").select("id", "fp", "component_id")


def hex_fingerprint(col="fp"):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row (all columns) of each group: that of the group's smallest id.
    Where several of its rows have that id, as repeated rows or because ids
    repeat, the one with the smallest fingerprint stays, then the one with the
    smallest hash of all columns. Groups that share an id keep a row each.
    Rows with a null id stay."""
    marked, named = _grouped(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words, max_bits)
    first = marked.join(named, "fp").where("id = component_id")
    chosen = cut(first.groupBy("root").agg(F.min("id").alias("id"), F.min("fp").alias("fp")))
    own = F.col(id_col).cast("bigint")
    repeated = cut(marked.groupBy("id").count().where("count > 1").join(chosen.select("id"), "id", "left_semi").select(F.col("id").alias("__keep")))
    kept = docs.join(chosen.select(F.col("id").alias("__keep")), own == F.col("__keep"), "left_semi")
    if not repeated.isEmpty():  # only then do ids not name rows
        several = docs.join(repeated, own == F.col("__keep"), "left_semi")
        kept = kept.join(repeated, own == F.col("__keep"), "left_anti").unionByName(_first_rows(several, chosen, id_col, text_col, words))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def _first_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row of ``docs`` for every ``(id, fp)`` of ``chosen`` that it has."""
    cols = docs.columns
    at = cols.index(text_col)

    def run(batches):
        for b in small(batches, at):
            fp = np.array([fingerprint(t, words) for t in b.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*cols, "__fp"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = docs.mapInArrow(run, f"{types}, `__fp` bigint")
    key = chosen.select(F.col("id").alias("__id"), F.col("fp").alias("__fp"))
    mine = marked.withColumn("__id", F.col(id_col).cast("bigint")).join(key, ["__id", "__fp"], "left_semi")
    row = F.struct(*[F.col(c) for c in cols])
    one = mine.groupBy("__id", "__fp").agg(F.min_by(row, F.xxhash64(*cols)).alias("__row"))
    return one.select("__row.*")
