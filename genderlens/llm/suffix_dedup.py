"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte is removed if a ``LENGTH``-byte string that covers it also starts
earlier (smaller document id, or same document, earlier start).

1. Anchors. Each 100-byte window has one anchor: the ``GRAM``-byte string in
   it with the smallest hash (the leftmost of equals). Windows of equal bytes
   have equal anchors at the same offset, so only windows with a common
   anchor have to be compared. The windows of one anchor occurrence are a
   run; its context is the bytes that the run covers.
2. Copies. Occurrences are counted per anchor with partial aggregation; an
   anchor that occurs once is done. What repeats within a document is settled
   where the document is read. Contexts of equal bytes are merged into their
   earliest occurrence, so a group of copies costs one row.
3. Sorting. Anchors with several different contexts remain. The suffixes that
   start at the anchor, and the reversed prefixes that end at it, are sorted:
   multikey quicksort on 8-byte characters to a shallow depth, then a blind
   trie for every group whose common prefix is longer. Neighbouring common
   prefixes give for each window offset the classes of equal windows; the
   earliest start in a class keeps its bytes.
4. Removal. Intervals of later windows are gathered per document (bounded by
   its length) and cut out.

An anchor may have very many different contexts (the edge of a passage that
a third of the documents share). Groups of more than ``group_limit``
contexts are not sorted in one task: their windows are compared by 128-bit
hash with partial aggregation, which is exact up to hash collisions and
spreads over all tasks.

Defined results: a null text counts as empty; texts shorter than the length
keep all bytes; rows of equal id are different documents in the order of
their texts (null ids after all others), and wholly equal rows are one
document whose result each of them gets; an empty table gives an empty
result; other columns are kept as they are. The kept bytes may begin or end
inside a character where a removed run does."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, utf8_chunks

LENGTH = 100
GRAM = 24
#: Multikey quicksort depth in bytes before blind tries take over.
SHALLOW = 16
#: Contexts of one anchor that are sorted in one task.
GROUP_LIMIT = 4_000
#: Bytes of text worked on at a time, so that arrays stay in the cache.
CHUNK = 1 << 17
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)


# ---- 1. anchors ---------------------------------------------------------

def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte string of ``data``; ``gram`` is a
    multiple of 8, as the bytes are read in words of 8."""
    n = data.size - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.empty(data.size - 7, np.uint64)
    for r in range(min(8, words.size)):
        words[r::8] = data[r:r + (data.size - r) // 8 * 8].view("<u8")
    h = words[:n] * np.uint64(_MULT[0])
    for k in range(8, gram, 8):
        h += words[k:k + n] * np.uint64(_MULT[k // 8])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor occurrences of the documents in ``data``: arrays ``doc``
    (index), ``at`` (anchor start), ``lo`` and ``hi`` (first and last window
    start), all but ``doc`` as positions in ``data``, and the anchor hash."""
    empty = np.zeros(0, np.int64)
    if data.size < length:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    h = gram_hashes(np.ascontiguousarray(data), gram)
    span = length - gram + 1
    n = h.size - span + 1
    # the smallest of each ``span`` neighbours, as the smaller of a block's
    # tail and the next block's head; the low bits hold the position, so the
    # leftmost of equal hashes wins
    bits = 32
    key = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(h.size, dtype=np.uint64)
    pad = -h.size % span
    blocks = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, span)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(tail[:n], head[span - 1:span - 1 + n])
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(best[1:], best[:-1], out=new[1:])
    # runs begin anew with each document and end with its last window
    after = bounds[1:] - length + 1
    new[bounds[:-1][bounds[:-1] < n]] = True
    new[after[(after >= 0) & (after < n)]] = True
    lo = np.flatnonzero(new)
    hi = np.concatenate((lo[1:] - 1, [n - 1]))
    doc = np.searchsorted(bounds, lo, side="right") - 1
    inside = lo < after[doc]
    lo, hi, doc = lo[inside], hi[inside], doc[inside]
    at = (best[lo] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return doc, at, lo, hi, h[at]


# ---- 3. deep-shallow sorting ----------------------------------------------

def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and, for each but the first in order, its common
    prefix with the one before. A blind trie keeps only branching positions
    and bytes: a string walks down blindly, is compared once with the leaf it
    meets, and is put in where the first difference says."""
    end = -1  # the label after the last byte
    root: list = [None, [0]]  # leaf: [None, members]; inner node: [depth, {label: child}, any member]

    def label(s, depth):
        return s[depth] if depth < len(s) else end

    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] is not None:
            nxt = node[1].get(label(s, node[0]))
            if nxt is None:
                break
            node = nxt
        other = strings[node[1][0] if node[0] is None else node[2]]
        if s == other:
            diff = None
        else:
            diff = common_prefix(s, other)
        above, node = None, root
        while True:
            if node[0] is None:
                if diff is None:
                    node[1].append(i)
                    break
            elif diff is None or node[0] < diff:
                above, node = (node, label(s, node[0])), node[1][label(s, node[0])]
                continue
            elif node[0] == diff:
                node[1][label(s, diff)] = [None, [i]]
                break
            fresh = [diff, {label(s, diff): [None, [i]], label(other, diff): node}, i]
            if above is None:
                root = fresh
            else:
                above[0][1][above[1]] = fresh
            break
    order, lcp = [], []
    stack: list = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node[0] is None:
            for j, i in enumerate(node[1]):
                if order:
                    lcp.append(depth if j == 0 else len(strings[i]))
                order.append(i)
        else:
            for j, key in enumerate(sorted(node[1], reverse=True)):
                first = j == len(node[1]) - 1
                stack.append((node[1][key], depth if first else node[0]))
    return order, lcp


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    lo, step = 0, 16
    while lo < n and a[lo:lo + step] == b[lo:lo + step]:
        lo += step
    lo = min(lo, n)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    return lo


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort ``strings`` within each group (ids ascending). Returns the order
    and, per place, the common prefix with the string before it (0 at the
    start of a group; equal strings: their length)."""
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = SHALLOW
    sizes = np.fromiter(map(len, strings), np.int64, n)
    head = np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in strings]), np.uint8).reshape(n, width)
    words = head.reshape(n, -1, 8).copy().view(">u8")[:, :, 0].astype(np.uint64)
    order = np.argsort(group, kind="stable")
    cls = group[order]
    start = np.concatenate(([True], cls[1:] != cls[:-1]))
    lcp = np.zeros(n, np.int64)
    # multikey quicksort steps: refine only classes that are still tied
    for step in range(width // 8):
        cid = np.cumsum(start)
        key = words[order, step]
        tied = np.concatenate((~start[1:], [False])) | ~start
        idx = np.flatnonzero(tied)
        if not idx.size:
            break
        sub = np.lexsort((np.minimum(sizes[order[idx]], 8 * step + 8), key[idx], cid[idx]))
        order[idx] = order[idx][sub]
        key = words[order, step]
        cut_len = np.minimum(sizes[order], 8 * step + 8)
        differs = np.concatenate(([True], (key[1:] != key[:-1]) | (cut_len[1:] != cut_len[:-1])))
        fresh = differs & ~start
        at = np.flatnonzero(fresh)
        if at.size:
            lcp[at] = _prefix(head, sizes, order, at)
        start |= differs
    # blind tries for what is still tied at the shallow depth
    begin = np.flatnonzero(start)
    size = np.diff(np.concatenate((begin, [n])))
    for b, m in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = order[b:b + m]
        got, near = blind_trie([strings[i] for i in members.tolist()])
        order[b:b + m] = members[got]
        lcp[b + 1:b + m] = near
    return order, lcp


def _prefix(head, sizes, order, at):
    a, b = head[order[at]], head[order[at - 1]]
    same = np.logical_and.accumulate(a == b, axis=1).sum(axis=1)
    return np.minimum(np.minimum(same, sizes[order[at]]), sizes[order[at - 1]])


def window_classes(left: list[bytes], right: list[bytes], group: np.ndarray, rank: np.ndarray,
                   length: int = LENGTH) -> list[np.ndarray]:
    """For contexts split at their anchor (``left`` holds the bytes before it
    in reverse, ``right`` those from it on) and numbered by ``rank`` in order
    of occurrence: per context, the left lengths d whose window (d bytes to
    the left, ``length - d`` to the right) occurs in an earlier context."""
    n = len(left)
    out: list[list[int]] = [[] for _ in range(n)]
    r_order, r_lcp = deep_shallow(right, group)
    l_order, l_lcp = deep_shallow(left, group)
    r_size = np.fromiter(map(len, right), np.int64, n)
    l_size = np.fromiter(map(len, left), np.int64, n)
    g_start_r = np.concatenate(([True], group[r_order][1:] != group[r_order][:-1])) if n else np.zeros(0, bool)
    g_start_l = np.concatenate(([True], group[l_order][1:] != group[l_order][:-1])) if n else np.zeros(0, bool)
    l_block, r_block = np.empty(n, np.int64), np.empty(n, np.int64)
    later = []
    for d in range(int(l_size.max(initial=0)) + 1):
        ok = np.flatnonzero((l_size >= d) & (r_size >= length - d))
        if ok.size < 2:
            continue
        r_block[r_order] = np.cumsum(g_start_r | (r_lcp < length - d))
        l_block[l_order] = np.cumsum(g_start_l | (l_lcp < d))
        code = r_block[ok] * (n + 1) + l_block[ok]
        order = np.lexsort((rank[ok], code))
        same = np.concatenate(([False], code[order][1:] == code[order][:-1]))
        hit = ok[order[same]]
        later.append(np.stack((hit, np.full(hit.size, d))))
    if later:
        who, d = np.concatenate(later, axis=1)
        by = np.argsort(who, kind="stable")
        cuts = np.flatnonzero(np.diff(who[by])) + 1
        for part_w, part_d in zip(np.split(who[by], cuts), np.split(d[by], cuts), strict=True):
            if part_w.size:
                out[int(part_w[0])] = part_d.tolist()
    return [np.array(x, np.int64) for x in out]


# ---- Spark plan -------------------------------------------------------------

KEY, TEXT = "__key", "__text"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with ``KEY``, a unique bigint in the order of the documents,
    and ``TEXT`` without nulls. The id itself serves if it is unique and
    never null; else the distinct (id, text) rows are sorted and numbered,
    and equal rows share a number. Also whether they may share."""
    d = docs.withColumn(TEXT, F.coalesce(F.col(text_col), F.lit("")))
    i = F.col(id_col).cast("bigint")
    odd = docs.select(i.alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():
        return d.withColumn(KEY, i), False
    number = cut(d.select(i.alias("__id"), F.col(TEXT).alias("__as")).distinct()
                 .sort(F.col("__id").asc_nulls_last(), "__as").withColumn(KEY, F.monotonically_increasing_id()))
    return d.join(number, i.eqNullSafe(F.col("__id")) & (F.col(TEXT) == F.col("__as"))).drop("__id", "__as"), True


def anchor_hashes(docs: DataFrame, length: int) -> DataFrame:
    """``(h)``: the anchor hashes of ``docs(id, text)``, with repeats."""
    def run(batches):
        for b in batches:
            for _, data, bounds in utf8_chunks(b.column(1), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, bounds, length)[4].view(np.int64))], names=["h"])

    return docs.select("id", "text").mapInArrow(run, "h bigint")


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """``(h, c, id, spot, again)`` for ``docs(id, text)``: anchor hash, hash
    of its context, document and the packed place (see ``place``), once per
    document and context. What repeats within a document (a line over and
    over) is later than its first occurrence for certain: it comes as merged
    byte ranges, rows with ``again``, whose ``spot`` and ``c`` are start and
    stop and whose ``h`` only spreads them."""
    def run(batches):
        context = xxhash.xxh64_intdigest
        for b in batches:
            for row, data, bounds in utf8_chunks(b.column(1), CHUNK):
                doc, at, lo, hi, h = anchors(data, bounds, length)
                raw = data.tobytes()
                c = np.array([context(raw[x:y], z) for x, y, z in zip(lo.tolist(), (hi + length).tolist(), (at - lo).tolist(),
                                                                       strict=True)], dtype=np.uint64)
                again = repeats_in_document(doc, h, c)
                spot = ((at - bounds[doc]) << 20) | ((at - lo) << 10) | (at - hi)
                owner, start, stop = ranges(doc[again], lo[again], hi[again] + length)
                base = bounds[owner]
                spread = (owner.astype(np.uint64) + np.uint64(row)) * np.uint64(_MULT[0]) + start.astype(np.uint64)
                once = ~again
                ids = b.column(0).take(pa.array(np.concatenate((doc[once], owner)) + row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((h[once], spread)).view(np.int64)),
                     pa.array(np.concatenate((c[once].view(np.int64), stop - base))), ids,
                     pa.array(np.concatenate((spot[once], start - base))),
                     pa.array(np.arange(len(ids)) >= once.sum())], names=["h", "c", "id", "spot", "again"])

    return docs.select("id", "text").mapInArrow(run, "h bigint, c bigint, id bigint, spot bigint, again boolean")


def repeats_in_document(doc: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which anchor occurrences (in page order) have an equal one before them
    in their document."""
    key = (h ^ (c * np.uint64(_MULT[1]))) * np.uint64(_MULT[2]) + doc.astype(np.uint64) * np.uint64(_MULT[3])
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1])) if key.size else np.zeros(0, bool)
    out = np.zeros(key.size, bool)
    out[order[same]] = True
    return out


def ranges(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Merge ranges (ascending in each document) that overlap or touch."""
    if not doc.size:
        return doc, start, stop
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [doc.size - 1]))
    return doc[first], start[first], stop[last]


def place(spot) -> tuple:
    """Columns ``(at, lo, hi)`` of a packed place: anchor start, first and
    last window start. Places of one document order by anchor start."""
    at = F.shiftright(spot, 20)
    return (at.cast("int").alias("at"), (at - F.shiftright(spot, 10).bitwiseAND(F.lit(1023))).cast("int").alias("lo"),
            (at - spot.bitwiseAND(F.lit(1023))).cast("int").alias("hi"))


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(id, h, at, lo, hi, bytes)`` of ``wanted(h, id, spot)``."""
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("h", "spot")).alias("asked"))
    joined = docs.select("id", F.encode("text", "utf-8").alias("raw")).join(asked, "id")

    def cut_bytes(x):
        at, lo, hi = place(x.spot)
        return F.struct(x.h.alias("h"), at, lo, hi, F.substring(F.col("raw"), lo + 1, hi - lo + length).alias("bytes"))

    return joined.select("id", F.transform("asked", cut_bytes).alias("cuts")).select("id", F.inline("cuts"))


def last_group(h: np.ndarray) -> int:
    """Where the last run of equal values begins."""
    return int(np.argmax(h == h[-1]))


def sorted_later(found: DataFrame, length: int) -> DataFrame:
    """``(id, start)`` runs of later windows for groups of contexts
    ``found(h, id, at, lo, hi, bytes)``, sorted group by group."""
    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 4000:
                continue
            h = held.column("h").to_numpy()
            done = last_group(h)
            if done:
                yield solve(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield solve(held)

    def solve(t):
        h, ids = t.column("h").to_numpy(), t.column("id").to_numpy()
        at, lo, hi = (t.column(x).to_numpy().astype(np.int64) for x in ("at", "lo", "hi"))
        raw = t.column("bytes").to_pylist()
        group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((at, ids))] = np.arange(len(h))
        off = (at - lo).tolist()
        left = [r[:o][::-1] for r, o in zip(raw, off, strict=True)]
        right = [r[o:] for r, o in zip(raw, off, strict=True)]
        who, start, stop = [], [], []
        for i, d in enumerate(window_classes(left, right, group, rank, length)):
            if d.size:
                s = np.sort(at[i] - d)
                edge = np.flatnonzero(np.diff(s) > 1)
                a, z = s[np.concatenate(([0], edge + 1))], s[np.concatenate((edge, [s.size - 1]))]
                who.append(np.full(a.size, ids[i]))
                start.append(a)
                stop.append(z + length)
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, start, stop)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)),
                                           pa.array(cols[2].astype(np.int32))], names=["id", "start", "stop"])

    laid = found.select("h", "id", "at", "lo", "hi", "bytes").repartition("h").sortWithinPartitions("h")
    return laid.mapInArrow(run, "id bigint, start int, stop int")


def hashed_later(found: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for one task: windows compared by
    128-bit hash, the earliest found by partial aggregation."""
    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)
            h, at, start, one, two = [], [], [], [], []
            ids = []
            for g, i, a, lo, _, raw in rows:
                for s in range(len(raw) - length + 1):
                    w = xxhash.xxh3_128_intdigest(raw[s:s + length])
                    h.append(g)
                    ids.append(i)
                    at.append(a - lo - s)
                    start.append(lo + s)
                    one.append((w >> 64) - (1 << 63))
                    two.append((w & ((1 << 64) - 1)) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(start, pa.int32()),
                 pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["h", "id", "d", "start", "w1", "w2"])

    rows = found.select("h", "id", "at", "lo", "hi", "bytes").mapInArrow(
        run, "h bigint, id bigint, d int, start int, w1 bigint, w2 bigint")
    first = cut(rows.groupBy("h", "d", "w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n"))
                .where("n > 1").drop("n"))
    later = rows.join(first, ["h", "d", "w1", "w2"]).where(F.struct("id", "start") != F.col("first"))
    return later.select("id", "start", (F.col("start") + length).alias("stop"))


def removals(d: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(id, start, stop)`` byte ranges to remove (they may overlap) from
    ``d(id, text)`` with unique ids. Runs jobs; partial results go to the
    shared folder."""
    repeated = cut(anchor_hashes(d, length).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    rows = anchor_rows(d, length).join(repeated.withColumn("more", F.lit(True)), "h", "left")
    every = cut(rows.where("more or again").drop("more"))
    own = every.where("again").select("id", F.col("spot").cast("int").alias("start"), F.col("c").cast("int").alias("stop"))
    some = every.where("not again").drop("again")
    merged = cut(some.groupBy("h", "c").agg(F.min(F.struct("id", "spot")).alias("first"), F.count("*").alias("n")))
    kinds = cut(merged.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    several = merged.join(kinds, "h").select("h", "first.*")
    found = cut(contexts(d, several, length))
    # later copies of a whole context, by joining back its earliest occurrence
    copies = some.join(cut(merged.where("n > 1").select("h", "c", "first")), ["h", "c"])
    _, lo, hi = place(F.col("spot"))
    whole = copies.where((F.col("id") != F.col("first.id")) | (F.col("spot") != F.col("first.spot"))).select(
        "id", lo.alias("start"), (hi + length).alias("stop")).unionByName(own)
    large = cut(kinds.where(F.col("kinds") > group_limit).select("h"))
    if large.isEmpty():
        return whole.unionByName(sorted_later(found, length))
    part = sorted_later(found.join(large, "h", "left_anti"), length)
    return whole.unionByName(part).unionByName(hashed_later(found.join(large, "h", "left_semi"), length))


def spans_of(found: DataFrame) -> DataFrame:
    """``(id, spans)``: sorted, merged ranges per document."""
    return found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        a, b = s["start"], s["stop"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


#: What ``cleaned`` returns of the bytes that stay: column, type, making.
KEPT = {"bytes": ("kept", "binary", pa.binary(), lambda raw: raw),
        "text": ("kept_text", "string", pa.string(), lambda raw: raw.decode("utf-8", "ignore")),
        "digest": ("kept_sha256", "string", pa.string(), lambda raw: hashlib.sha256(raw).hexdigest())}


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            group_limit: int = GROUP_LIMIT, kept: str = "bytes") -> DataFrame:
    """``docs`` with its columns, one row per input row; new columns
    ``n_bytes``, ``n_removed``, ``n_spans`` and, by ``kept``, the bytes that
    stay (``kept``), their text (``kept_text``, without the pieces of a
    character that was split) or their SHA-256 (``kept_sha256``). Input
    columns of those names are replaced."""
    name, kind, arrow, finish = KEPT[kept]
    d, repeats = keyed(docs, id_col, text_col)
    unique = d.select(F.col(KEY).alias("id"), F.col(TEXT).alias("text"))
    unique = unique.dropDuplicates(["id"]) if repeats else unique
    spans = cut(spans_of(removals(unique, length, group_limit)))
    new = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", name: kind}
    keep = [c for c in docs.columns if c not in new]
    marks = spans.select(F.col("id").alias(KEY), F.col("spans").alias("__spans"))
    joined = d.join(marks, KEY, "left").select(*keep, TEXT, "__spans")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema]

    def run(batches):
        for b in small(batches, len(keep)):
            n, gone, count, out = [], [], [], []
            for text, mark in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                merged = merge_spans(mark)
                n.append(len(raw))
                gone.append(sum(y - x for x, y in merged))
                count.append(len(merged))
                out.append(finish(cut_out(raw, merged)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(out, arrow)], names=[*keep, *new])

    return joined.mapInArrow(run, ", ".join([*types, *(f"{k} {v}" for k, v in new.items())]))
