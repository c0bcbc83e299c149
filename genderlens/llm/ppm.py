"""Language-model scoring by prediction by partial matching over bytes.

A text is the bytes of its tokens: its words (A-Z in lower case) with one
space between them, then an end sign. The model is a trie of byte contexts of
up to ``ORDER`` bytes, pretrained on all training texts. A symbol is coded in
the longest context; while the context has not shown it, an escape is paid and
the next shorter context is asked, where the symbols of the longer one are
excluded. With n the count of the symbol, T the counts and u the number of the
symbols that are not excluded, a symbol has probability (2n - 1) / 2T and the
escape u / 2T; below the empty context all symbols never seen are equally
likely. Counts of shorter contexts are those of update exclusion: a symbol
counts once for every one byte longer context that has shown it. The score is
the sum of the log10 probabilities.

A context and a symbol of up to eight bytes are one integer, a *gram*, so a
trie level is a table (gram, n), and the shorter level is a group-by of the
longer one. A context has at most 252 symbols and a gram at most 252 longer
ones, which bounds every key of every join and group here, whatever the
corpus. The probability of a gram is the same wherever it occurs: texts are
laid in chunks of about ``CHUNK`` bytes as they are read, each chunk names its
distinct grams and words once, gets their probabilities and counts back by
joins, and scores its texts with them in a task of its own. Nothing that grows with the corpus goes
to the driver or is broadcast.

Defined results: a null text is an empty one, whose only token is its end; a
null id trains (its remainder is 0) and keeps its row; repeated rows are rows
of their own and all train; without training texts every symbol costs
log10(252) and the base score is 0; an empty table gives an empty result."""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..session import checkpoint_dir
from .common import crc_rest, cut, small

ORDER = 5
CHUNK = 32 << 20
PIECE = 1 << 20
#: Rows that a task puts together before it bundles them by chunk.
BUNDLE = 500_000
#: Byte values without the five white-space controls, and the end sign.
SYMBOLS = 252
END = b"\n"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# ---- texts -------------------------------------------------------------------------

def encoded(text: str | None) -> bytes:
    """A text's tokens as bytes."""
    return b" ".join((text or "").encode().translate(LOWER).split()) + END


def word_lists(x: bytes):
    """The words of an encoded text, in lists from about ``PIECE`` bytes each."""
    at, last = 0, len(x) - 1
    while at < last:
        end = last if last - at <= PIECE else x.find(b" ", at + PIECE, last)
        end = last if end < 0 else end
        yield x[at:end].split(b" ")
        at = end + 1


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The gram of every symbol of encoded texts; contexts before a text's
    start are end signs."""
    pad = END * order
    x = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    if not x.size:
        return np.zeros(0, np.int64)
    n = x.size - order
    g = np.zeros(n, np.int64)
    for j in range(order + 1):
        g <<= 8
        g |= x[j:j + n]
    keep = np.ones(x.size, bool)
    ends = np.cumsum([len(t) + order for t in texts]) - order  # after a text's last gram
    keep[(ends[:, None] + np.arange(order)).ravel()] = False
    return g[keep[:n]]


def slices(x: bytes, order: int = ORDER):
    """Grams of one encoded text, ``PIECE`` symbols at a time."""
    if len(x) <= PIECE:
        yield grams([x], order)
        return
    for at in range(0, len(x), PIECE):
        got = grams([x[max(0, at - order):at + PIECE]], order)
        yield got[min(at, order):]


def batched(texts):
    """Lists of texts of about ``PIECE`` bytes; a longer text is alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > PIECE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def lay(batches):
    """Encoded texts, numbered in chunks as they are read; about ``PIECE`` bytes
    of texts to a row, compressed."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    pack = zstandard.ZstdCompressor(level=3)
    for b in small(batches, 2):
        texts = [encoded(t) for t in b.column(2).to_pylist()]
        at = 0
        for part in batched(texts):
            sizes = [len(t) for t in part]
            if size and size + sum(sizes) > CHUNK:
                chunk, size = chunk + 1, 0
            size += sum(sizes)
            rows = b.slice(at, len(part))
            at += len(part)
            one = pa.array([0, len(part)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(one, rows.column(0)), pa.ListArray.from_arrays(one, rows.column(1)),
                pa.ListArray.from_arrays(one, pa.array(sizes, pa.int64())), pa.array([pack.compress(b"".join(part))], pa.binary())],
                names=["chunk", "ids", "held_out", "sizes", "x"])


def unpacked(sizes: list[int], x: bytes) -> list[bytes]:
    """The texts of one row of ``lay``."""
    raw = zstandard.ZstdDecompressor().decompress(x, max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n:e] for e, n in zip(ends, sizes)]


# ---- counting ----------------------------------------------------------------------

def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, sorted."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


class ChunkCounts:
    """Distinct grams and words of one chunk with their training counts."""

    def __init__(self, order: int):
        self.order, self.words = order, Counter()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], held: bool):
        for x in texts:
            for words in word_lists(x):
                if held:
                    self.words.update(dict.fromkeys(words, 0))
                else:
                    self.words.update(words)
        for g in ([grams(texts, self.order)] if len(texts) > 1 else slices(texts[0], self.order)):
            keys, n = np.unique(g, return_counts=True)
            self.parts.append((keys, np.zeros_like(n) if held else n))
        if len(self.parts) >= 32:
            self.settle()

    def settle(self):
        if self.parts:
            self.parts = [merged(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]

    def rows(self, chunk: int):
        self.settle()
        for keys, n in self.parts:
            yield batch(chunk, keys, None, n)
        words = list(self.words)
        for part in batched(words):
            yield batch(chunk, None, part, np.array([self.words[w] for w in part], np.int64))


def batch(chunk: int, keys, words, n) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(size, chunk, np.int64)), pa.nulls(size, pa.int64()) if keys is None else pa.array(keys),
        pa.nulls(size, pa.binary()) if words is None else pa.array(words, pa.binary()), pa.array(n.astype(np.int64))],
        names=["chunk", "gram", "word", "n"])


def count(order: int):
    def run(batches):
        chunk, counts = None, None
        for b in batches:
            for i in range(b.num_rows):
                at, held, sizes, x = (b.column(c)[i].as_py() for c in range(4))
                if at != chunk:
                    if counts:
                        yield from counts.rows(chunk)
                    chunk, counts = at, ChunkCounts(order)
                texts = unpacked(sizes, x)
                for side in (False, True):
                    if mine := [t for t, h in zip(texts, held) if h == side]:
                        counts.add(mine, side)
        if counts:
            yield from counts.rows(chunk)
    return run


# ---- the trie ----------------------------------------------------------------------

def tail(c, size: int):
    """The last ``size`` bytes of a gram."""
    return c.bitwiseAND(F.lit((1 << 8 * size) - 1))


def context(c):
    return F.shiftright(c, 8)


def trie(seen: DataFrame, order: int) -> list[DataFrame]:
    """Levels 0 to ``order``: ``(gram, n)``."""
    out = [cut(seen)]
    for k in range(order - 1, -1, -1):
        out.insert(0, cut(out[0].groupBy(tail(F.col("gram"), k + 1).alias("gram")).agg(F.count("*").alias("n"))))
    return out


def by_context(level: DataFrame, name: str) -> DataFrame:
    return level.groupBy(context(F.col("gram")).alias(name)).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))


def escaped(levels: list[DataFrame], missing: DataFrame) -> DataFrame:
    """``(gram, value)``: the log10 probability of the symbol of each gram of
    ``missing`` (not in the last level) once its full context has escaped.

    Level by level downwards every distinct gram still open pays its escape or
    finds its symbol; upwards the costs of the shorter grams are added."""
    steps, open_ = [], missing
    for k in range(len(levels) - 2, -1, -1):
        longer, level = levels[k + 1], levels[k]
        q = open_.select("gram", context(F.col("gram")).alias("above"), tail(F.col("gram"), k + 1).alias("short"))
        level_n = level.select(F.col("gram").alias("short"), "n")
        # what the longer context excludes here
        gone = longer.select(context(F.col("gram")).alias("above"), tail(F.col("gram"), k + 1).alias("short"))
        gone = gone.join(q.select("above").distinct(), "above", "left_semi").join(level_n, "short")
        gone = gone.groupBy("above").agg(F.sum("n").alias("gone_total"), F.count("*").alias("gone_kinds"))
        x = q.join(gone, "above", "left").withColumn("here", context(F.col("short")))
        x = x.join(by_context(level, "here"), "here", "left").join(level_n, "short", "left")
        total = F.col("total") - F.coalesce("gone_total", F.lit(0))
        kinds = F.col("kinds") - F.coalesce("gone_kinds", F.lit(0))
        cost = F.when(F.col("n").isNotNull(), F.log10((2 * F.col("n") - 1) / (2 * total))).when(kinds > 0, F.log10(kinds / (2 * total))).otherwise(0.0)
        step = cut(x.select("gram", "short", cost.alias("cost"), F.col("n").isNotNull().alias("found")))
        steps.append(step)
        open_ = step.where("not found").select(F.col("short").alias("gram")).distinct()
    never = max(1, SYMBOLS - levels[0].count())  # at most 252 rows
    rest = open_.select("gram", F.lit(-math.log10(never)).alias("value"))
    for step in reversed(steps):
        below = rest.select(F.col("gram").alias("short"), F.col("value").alias("below"))
        rest = cut(step.join(below, "short", "left").select("gram", (F.col("cost") + F.coalesce("below", F.lit(0.0))).alias("value")))
    return rest


def probabilities(counted: DataFrame, order: int) -> DataFrame:
    """``(gram, value)`` for ``counted(gram, n)``, training counts of the
    distinct grams (0 where only other texts have it)."""
    levels = trie(counted.where("n > 0"), order)
    rest = escaped(levels, counted.where("n = 0").select("gram"))
    x = counted.withColumn("here", context(F.col("gram"))).join(by_context(levels[-1], "here"), "here", "left")
    x = x.join(rest, "gram", "left")
    seen = F.log10((2 * F.col("n") - 1) / (2 * F.col("total")))
    escape = F.coalesce(F.log10(F.col("kinds") / (2 * F.col("total"))), F.lit(0.0))
    return x.select("gram", F.when(F.col("n") > 0, seen).otherwise(escape + F.coalesce("value", F.lit(0.0))).alias("value"))


# ---- scoring -----------------------------------------------------------------------

def bundle(batches):
    """Rows (chunk, gram, value) or (chunk, word, c) put together by chunk, a
    few rows a task, sorted and compressed: what a chunk gets back."""
    pack = zstandard.ZstdCompressor(level=3)
    held: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(held)
        for chunk in pc.unique(t.column("chunk")).to_pylist():
            mine = t.filter(pc.equal(t.column("chunk"), chunk))
            g = mine.filter(pc.is_valid(mine.column("gram")))
            keys, value = g.column("gram").to_numpy(), g.column("value").to_numpy()
            order = np.argsort(keys)
            keys, value = keys[order], value[order]
            w = mine.filter(pc.is_valid(mine.column("word")))
            blobs = [np.diff(keys, prepend=0).tobytes(), value.tobytes(), b" ".join(w.column("word").to_pylist()), w.column("value").to_numpy().tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([pack.compress(x)], pa.binary()) for x in blobs)],
                                             names=["chunk", "grams", "values", "words", "counts"])

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= BUNDLE:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


class Values:
    """Values by gram, looked up for arrays of grams that all have one: the
    grams lie in the order of a hash whose slots hold about one each."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.value = keys[order], value[order]
        self.start = np.searchsorted(slot[order], np.arange(1 << self.bits, dtype=np.uint64)).astype(np.int64)

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = self.start[self.slot(g)]
        left = np.flatnonzero(self.keys[at] != g)
        while left.size:
            at[left] += 1
            left = left[self.keys[at[left]] != g[left]]
        return self.value[at]


def opened(bundles: list[dict]) -> tuple[Values, dict[bytes, int]]:
    """A chunk's bundles: values of its grams, and counts by word."""
    read = zstandard.ZstdDecompressor()
    keys, values, counts = [np.zeros(0, np.int64)], [np.zeros(0)], {}
    for row in bundles:
        blob = {k: read.decompressobj().decompress(row[k]) for k in ("grams", "values", "words", "counts")}
        keys.append(np.cumsum(np.frombuffer(blob["grams"], np.int64)))
        values.append(np.frombuffer(blob["values"]))
        if blob["counts"]:
            counts.update(zip(blob["words"].split(b" "), np.frombuffer(blob["counts"]).astype(np.int64).tolist(), strict=True))
    return Values(np.concatenate(keys), np.concatenate(values)), counts


class Terms(dict):
    """Base terms by word; a word that is not in it was never trained on."""

    def __init__(self, counts: dict[bytes, int], scale: int):
        super().__init__((w, math.log10((c + 1) / scale)) for w, c in counts.items())
        self.other = math.log10(1 / scale)

    def __missing__(self, _):
        return self.other


def score_chunk(bundles: list[dict], rows: list[dict], order: int, tokens: int, kinds: int, ends: int):
    """(ids, held out, tokens, known, base, score) of each packed row of texts."""
    scale = tokens + kinds + 1
    value, counts = opened(bundles)
    local: Counter = Counter()  # words of this chunk alone have no other counts
    for r in rows:
        for h, x in zip(r["held_out"], unpacked(r["sizes"], r["x"])):
            if not h:
                for ws in word_lists(x):
                    local.update(ws)
    counts = {**local, **counts}
    terms, known_words = Terms(counts, scale), {w for w, c in counts.items() if c}
    del local, counts
    end = math.log10((ends + 1) / scale)
    for r in rows:
        xs = unpacked(r["sizes"], r["x"])
        n_tokens, n_known, base = [], [], []
        for x in xs:
            n, known, s = 1, int(ends > 0), end
            for ws in word_lists(x):
                n += len(ws)
                known += sum(map(known_words.__contains__, ws))
                s += sum(map(terms.__getitem__, ws))
            n_tokens.append(n)
            n_known.append(known)
            base.append(s)
        if len(xs) == 1:
            total = [float(sum(value(g).sum() for g in slices(xs[0], order)))]
        else:
            total = np.add.reduceat(value(grams(xs, order)), np.cumsum([0, *map(len, xs[:-1])])).tolist()
        yield r["ids"], r["held_out"], n_tokens, n_known, base, total


def score(id_type: pa.DataType, order: int, tokens: int, kinds: int, ends: int):
    """Partitions of whole chunks, bundles (side 0) before texts (side 1)."""
    def flush(bundles, rows):
        for ids, held, n, known, base, total in score_chunk(bundles, rows, order, tokens, kinds, ends):
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                pa.array(np.full(len(n), tokens, np.int64)), pa.array(base, pa.float64()), pa.array(total, pa.float64())],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        chunk, bundles, rows = None, [], []
        for b in batches:
            for i in range(b.num_rows):
                at, side = b.column("chunk")[i].as_py(), b.column("side")[i].as_py()
                if at != chunk:
                    yield from flush(bundles, rows)
                    chunk, bundles, rows = at, [], []
                cols = ("ids", "held_out", "sizes", "x") if side else ("grams", "values", "words", "counts")
                (rows if side else bundles).append({c: b.column(c)[i].as_py() for c in cols})
        yield from flush(bundles, rows)
    return run


def shared_words(named: DataFrame) -> tuple[DataFrame, int, int]:
    """``(chunk, word, c)`` for the words of more than one row of ``named``,
    with the counts of all; the number of training words, and of different
    ones. A word of one chunk is counted by that chunk alone."""
    by = Window.partitionBy("word")  # a row a chunk
    first = F.row_number().over(by.orderBy("chunk")) == 1
    x = named.select("chunk", "word", "n").withColumns({"c": F.sum("n").over(by), "k": F.count("*").over(by), "first": first})
    x = kept(x.where("k > 1"))
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("rows")).first()
    mine = x.agg(F.count_if(F.col("n") > 0).alias("rows"), F.count_if((F.col("c") > 0) & F.col("first")).alias("words")).first()
    return x.select("chunk", "word", "c"), total["n"], total["rows"] - mine["rows"] + mine["words"]


def kept(df: DataFrame) -> DataFrame:
    """``common.cut`` with denser compression: the tables here are large."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ppm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scored(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``,
    one row per row of ``docs``. Runs jobs; texts in chunks, counts and the
    trie are written to the shared folder. ``order`` is at most 6."""
    if not 0 <= order <= 6:
        raise ValueError("a gram of at most seven bytes keeps its sign")
    rows = docs.select(F.col(id_col).alias("id"), (crc_rest(id_col, modulus) == held).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    laid = kept(rows.mapInArrow(lay, f"chunk bigint, ids array<{kind}>, held_out array<boolean>, sizes array<bigint>, x binary"))
    named = kept(laid.select("chunk", "held_out", "sizes", "x").mapInArrow(count(order), "chunk bigint, gram bigint, word binary, n bigint"))
    grams_of = named.where("gram is not null")
    words, tokens, kinds = shared_words(named.where("word is not null"))
    ends = laid.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda h: ~h))), F.lit(0)).alias("n")).first()["n"]
    value = cut(probabilities(cut(grams_of.groupBy("gram").agg(F.sum("n").alias("n"))), order))
    known = grams_of.select("chunk", "gram").join(value, "gram").select("chunk", "gram", F.lit(None).cast("binary").alias("word"), "value")
    known = known.unionByName(words.select("chunk", F.lit(None).cast("bigint").alias("gram"), "word", F.col("c").cast("double").alias("value")))
    known = known.mapInArrow(bundle, "chunk bigint, grams binary, values binary, words binary, counts binary")
    # a partition a chunk: one row a chunk is numbered
    chunks = laid.select("chunk").distinct().withColumn("part", F.row_number().over(Window.orderBy("chunk")) - 1)
    chunks = cut(chunks)
    every = laid.withColumn("side", F.lit(1)).unionByName(known.withColumn("side", F.lit(0)), allowMissingColumns=True).join(chunks, "chunk")
    dealt = every.repartitionById(max(1, chunks.count()), F.col("part")).sortWithinPartitions("chunk", "side").drop("part")
    id_type = to_arrow_type(rows.schema["id"].dataType)
    return dealt.mapInArrow(
        score(id_type, order, tokens + ends, kinds + (1 if ends else 0), ends),
        f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
