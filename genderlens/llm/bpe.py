"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

A pre-token is a row of byte symbols. The leaves of a segment tree hold the
merge rank of each adjacent pair (a large number where no merge exists); an
inner node holds the smaller of its children, ties to the left, so the root
yields the leftmost lowest-rank merge. A merge changes three leaves: its own
and those of its two neighbours, each a logarithmic point update. Merging
ends when the root holds no rank.

New pre-tokens of a batch that have the same padded length are run together:
the trees are the rows of one matrix. Results are remembered per task by
pre-token; the memory is bounded by ``CACHE`` entries and only saves time.

Special tokens of the file are matched in the text as its library does.
Defined results: a null text counts as empty and encodes to no ids; decoding
is by ``bytes`` of each id, joined and read as UTF-8 (bad bytes replaced)."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: Fixed value: the pre-token pattern of byte-level BPE files with
#: ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2 ** 31 - 1)
CACHE = 500_000
#: Pre-tokens of more bytes than this are merged one at a time.
WIDE = 64


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from
    code point 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return out


class Codec:
    """Encoder and decoder of one tokenizer file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.pieces = [b""] * size
        for word, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in word)
        for word, i in self.specials.items():
            self.pieces[i] = word.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.ranks, self.made = size, keys[order], order.astype(np.int32), made
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.of_byte_list = self.of_byte.tolist()
        self.names = [str(i) for i in range(size)]
        self.piece_of = dict(zip(self.names, self.pieces, strict=True))
        self.special_names = {i: str(i) for i in self.specials.values()}
        self.known: dict[str | int, str] = dict(self.special_names)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_rows(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merge each row of ``symbols`` (n x w, w a power of two, the first
        ``lengths`` entries used) until no pair has a rank; returns the
        matrix with -1 where a symbol was merged away or never was."""
        n, w = symbols.shape
        col = np.arange(w)
        after, before = np.tile(col + 1, (n, 1)), np.tile(col - 1, (n, 1))
        tree = np.full((n, 2 * w), NONE, np.int32)  # node i has children 2 i and 2 i + 1
        live = col[None, :] + 1 < lengths[:, None]
        r, c = np.nonzero(live)
        tree[r, w + c] = self.pair_ranks(symbols[r, c], symbols[r, c + 1])
        for size in _levels(w):
            tree[:, size:2 * size] = np.minimum(tree[:, 2 * size:4 * size:2], tree[:, 2 * size + 1:4 * size:2])
        symbols = np.where(col[None, :] < lengths[:, None], symbols, -1)
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            best = tree[rows, 1]
            node = np.ones(rows.size, np.int64)
            while node[0] < w:  # leftmost leaf that holds the root's rank
                node = 2 * node + (tree[rows, 2 * node] != best)
            at = node - w
            gone = after[rows, at]
            symbols[rows, at] = self.made[best]
            symbols[rows, gone] = -1
            follow = after[rows, gone]
            after[rows, at] = follow
            inside = follow < lengths[rows]
            before[rows[inside], follow[inside]] = at[inside]
            self._set(tree, rows, w + gone, np.full(rows.size, NONE, np.int32))
            rank = np.full(rows.size, NONE, np.int32)
            rank[inside] = self.pair_ranks(symbols[rows[inside], at[inside]], symbols[rows[inside], follow[inside]])
            self._set(tree, rows, w + at, rank)
            prior = before[rows, at]
            has = prior >= 0
            self._set(tree, rows[has], w + prior[has],
                      self.pair_ranks(symbols[rows[has], prior[has]], symbols[rows[has], at[has]]))
            rows = rows[tree[rows, 1] != NONE]
        return symbols

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        """Point update of one leaf per row, up to the root."""
        if not rows.size:
            return
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long pre-token, on Python lists."""
        n, w, none, size, rank_of = len(symbols), 1, int(NONE), self.size, self.rank_of
        while w < n:
            w *= 2
        tree = [none] * (2 * w)
        for i in range(n - 1):
            tree[w + i] = rank_of.get(symbols[i] * size + symbols[i + 1], none)
        for i in range(w - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf, value):
            node = w + leaf
            tree[node] = value
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while n > 1 and tree[1] != none:
            best, node = tree[1], 1
            while node < w:
                node = 2 * node + (tree[2 * node] != best)
            at = node - w
            gone = after[at]
            symbols[at], symbols[gone] = int(self.made[best]), -1
            follow = after[gone]
            after[at] = follow
            put(gone, none)
            if follow < n:
                before[follow] = at
                put(at, rank_of.get(symbols[at] * size + symbols[follow], none))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], rank_of.get(symbols[before[at]] * size + symbols[at], none))
        return [s for s in symbols if s >= 0]

    def learn(self, tokens: list[str]) -> None:
        """Encode pre-tokens that are not remembered yet."""
        raws = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        known, names = self.known, self.names
        for i in np.flatnonzero(sizes > WIDE).tolist():
            known[tokens[i]] = ",".join([names[x] for x in self.merge_long([self.of_byte_list[x] for x in raws[i]])])
        w, low = 4, 0
        while low < WIDE:
            part = np.flatnonzero((sizes > low) & (sizes <= w))
            for at in range(0, part.size, 8192):
                chosen = part[at:at + 8192]
                index, lengths = chosen.tolist(), sizes[chosen]
                flat = np.frombuffer(b"".join([raws[i] for i in index]), np.uint8)
                rows = np.zeros((len(index), w), np.int64)
                rows[np.arange(w)[None, :] < lengths[:, None]] = self.of_byte[flat]
                rows = self.merge_rows(rows, lengths)
                left = rows >= 0
                ends = np.cumsum(left.sum(axis=1)).tolist()
                ids = [names[x] for x in rows[left].tolist()]
                start = 0
                for i, end in zip(index, ends, strict=True):
                    known[tokens[i]] = ",".join(ids[start:end])
                    start = end
            w, low = 2 * w, w

    def encode_many(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by commas, per text ('' if there are none)."""
        if len(self.known) > CACHE:
            self.known.clear()
            self.known.update(self.special_names)
        parts, new, find = [], set(), self.pattern.findall
        for text in texts:
            pieces = []  # pre-tokens, and special tokens as ids
            at = 0
            for m in self.split.finditer(text) if self.split else ():
                pieces += find(text[at:m.start()])
                pieces.append(self.specials[m[0]])
                at = m.end()
            pieces += find(text[at:] if at else text)
            parts.append(pieces)
            new.update(pieces)
        known = self.known
        self.learn([p for p in new if p not in known])
        return [",".join([known[p] for p in pieces]) for pieces in parts]

    def decode_names(self, ids: str) -> str:
        """Text of decimal ids joined by commas, special tokens included."""
        of = self.piece_of
        return b"".join([of[i] for i in ids.split(",")]).decode("utf-8", "replace") if ids else ""

    def decode(self, ids) -> str:
        """Text of a sequence of ids, special tokens included."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def batched(texts: list[str], chars: int = 1 << 20):
    """Consecutive parts of ``texts`` of about ``chars`` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded, n_tokens)`` per row: decimal ids joined by commas
    and the text decoded from them. Nothing is shuffled."""
    def run(batches):
        c = codec(path)
        for b in small(batches, 1):
            for at, ids, texts in _encoded(c, b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(ids)), pa.array(ids, pa.string()), pa.array(texts, pa.string()),
                     pa.array(map(count, ids), pa.int64())], names=["id", "ids", "decoded", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, ids string, decoded string, n_tokens bigint")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row."""
    def run(batches):
        c = codec(path)
        for b in small(batches, 1):
            for at, ids, texts in _encoded(c, b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(ids)), pa.array(map(count, ids), pa.int64()),
                     pa.array([hashlib.sha256(s.encode()).hexdigest() for s in ids]),
                     pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts])],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def count(ids: str) -> int:
    """Number of ids in a comma-joined list."""
    return ids.count(",") + 1 if ids else 0


def _encoded(c: Codec, column):
    texts = [t or "" for t in column.to_pylist()]
    at = 0
    for part in batched(texts):
        ids = c.encode_many(part)
        yield at, ids, [c.decode_names(s) for s in ids]
        at += len(part)


def _levels(w: int):
    size = w // 2
    while size:
        yield size
        size //= 2
