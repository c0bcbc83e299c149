"""SimHash, suffix dedup, BPE and order MinHash against brute force, and
their edge cases: nulls, empty and very long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genderlens.llm import bpe, order_minhash, queries, simhash, suffix_dedup
from tests.conftest import SF001

SCHEMA = "doc_id bigint, text string, id string, h int, spans string, bucket int, n int"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rows(texts, start=0):
    return [(start + i, t, "x", 1, "y", 2, 3) for i, t in enumerate(texts)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def odd_texts():
    base = prose(1, 300)
    words = base.split()
    edited = [*words]
    edited[5] = "zzz"
    shared = prose(2, 40)
    return [None, "", "   \n", "one", base, base, base.upper(), " ".join(edited), prose(3, 50) + " " + shared, shared + " " + prose(4, 60),
            "é日本 😀 " * 40, "ab" * 3000, "a" * 250, prose(5, 6000), "tail " + shared[20:], "<|endoftext|> plain <|endoftext|>"]


# ---- SimHash -------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(ids, fps, bits):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return {x: low[find(i)] for i, x in enumerate(ids)}


def test_simhash_query_equals_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    groups = plain_groups([r.doc_id for r in docs], fps, 4)
    assert got == {r.doc_id: (f"{f:016x}", groups[r.doc_id]) for r, f in zip(docs, fps, strict=True)}


def test_simhash_edges(spark, odd_texts):
    got = {r.id: r for r in simhash.groups(frame(spark, odd_texts)).collect()}
    assert len(got) == len(odd_texts)
    assert all(got[i].fp % 2 ** 64 == plain_fingerprint(t) for i, t in enumerate(odd_texts))
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0  # no words: fingerprint zero
    assert got[5].component_id == got[6].component_id == 4  # copies and other case
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


def test_simhash_links_are_complete(spark):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(60)]
    for v in values[:30]:
        for _ in range(4):
            values.append(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    ball = r.getrandbits(64)  # a large bucket: many values near one
    values += [ball ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(1, 20)]
    values = sorted(set(values))
    df = spark.createDataFrame([(v - 2 ** 64 if v >= 2 ** 63 else v,) for v in values], "fp bigint")
    found = simhash.components(simhash.links(df)).collect()
    label = {x.node % 2 ** 64: x.component % 2 ** 64 for x in found}
    want = plain_groups(values, values, 4)
    mine = {}
    for v in values:
        mine.setdefault(label.get(v, v), []).append(v)
    theirs = {}
    for v in values:
        theirs.setdefault(want[v], []).append(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_keeps_one_of_each_group(spark, odd_texts):
    df = spark.createDataFrame(rows(odd_texts) + [rows(odd_texts)[4], (None, "one", "x", 1, "y", 2, 3)], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids and ids.count(None) == 1 and 0 in ids and 1 not in ids


# ---- suffix dedup -----------------------------------------------------------------

def test_simhash_keeps_a_row_of_every_group_when_ids_repeat(spark):
    """One id on unlinked texts, on copies, and on a near copy of an earlier id's text."""
    a, b, c, d = (prose(i, 60) for i in (1, 2, 3, 4))
    near = a.replace(a.split()[7], "other", 1)
    rows = [(5, a), (5, b), (5, a), (7, c), (7, c), (7, near), (8, d), (8, "x " + d), (9, b), (None, a)]
    df = spark.createDataFrame([(i, t, "clash", n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, fp string, root int").repartition(4)
    got = simhash.keep_one(df).collect()
    assert len(got) == len(set(got)) and got[0].__fields__ == df.columns
    kept = [r for r in got if r.doc_id is not None]
    fps = [plain_fingerprint(t) for _, t in rows[:-1]]
    place = plain_groups(list(range(len(fps))), fps, simhash.MAX_BITS)
    assert len(set(place.values())) == len(kept) == 4
    for g in set(place.values()):
        mine = [i for i in place if place[i] == g]
        found = [r for r in kept if plain_fingerprint(r.text) in {fps[i] for i in mine}]
        assert [r.doc_id for r in found] == [min(rows[i][0] for i in mine)]
    assert [r for r in got if r.doc_id is None][0].text == a


def plain_removal(docs, length=100):
    seen, out = set(), {}
    for i, t in docs:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s:s + length]
            if w in seen:
                mark[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        spans = sum(1 for k, m in enumerate(mark) if m and (k == 0 or not mark[k - 1]))
        out[i] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [20_000, 2])
def test_suffix_dedup_equals_brute_force(spark, limit):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = suffix_dedup.cleaned(docs, kept="digest", group_limit=limit).collect()
    want = plain_removal(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 0


def test_suffix_dedup_edges(spark, odd_texts):
    df = frame(spark, odd_texts)
    got = suffix_dedup.cleaned(df, kept="digest")
    assert got.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", "),
                           "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == plain_removal(list(enumerate(odd_texts)))
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.cleaned(empty).count() == 0


def test_suffix_dedup_repeated_and_null_ids(spark):
    a, b = prose(8, 60), prose(9, 60)
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (None, a), (0, "x" + a)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text[:3], r.n_removed) for r in suffix_dedup.cleaned(df).collect())
    n = len(a)
    # equal rows are one document; null ids come last
    assert got == sorted([("0", ("x" + a)[:3], 0), ("1", a[:3], n), ("1", a[:3], n), ("1", b[:3], 0), ("None", a[:3], n)])


def test_finished_groups_are_let_go():
    assert suffix_dedup.last_group(np.array([3, 3, 5, 5, 9, 9, 9])) == 4
    assert suffix_dedup.last_group(np.array([4, 4, 4])) == 0 and suffix_dedup.last_group(np.array([-2, 7])) == 1


def test_deep_shallow_sorting():
    r = random.Random(5)
    for _ in range(60):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 45))) * r.choice([1, 2]) for _ in range(r.randint(1, 40))]
        group = np.sort([r.randint(0, 2) for _ in strings])
        order, lcp = suffix_dedup.deep_shallow(strings, group)
        for g in set(group.tolist()):
            mine = [strings[i] for i in order if group[i] == g]
            assert mine == sorted(strings[i] for i in range(len(strings)) if group[i] == g)
        for k in range(1, len(strings)):
            if group[order[k]] == group[order[k - 1]]:
                x, y = strings[order[k]], strings[order[k - 1]]
                assert lcp[k] == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def test_anchors_tile_all_windows():
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 50, 50, 149, 249, 3000, 5000])
    doc, at, lo, hi, h = suffix_dedup.anchors(data, bounds)
    starts = sorted(s for a, z in zip(lo, hi, strict=True) for s in range(a, z + 1))
    assert starts == [s for a, z in zip(bounds[:-1], bounds[1:], strict=True) for s in range(a, z - 99)]
    assert ((at >= lo) & (at + suffix_dedup.GRAM <= hi + 100) & (at >= hi) | (at >= hi)).all()


# ---- BPE ---------------------------------------------------------------------------

def test_bpe_query_equals_the_library(spark, odd_texts):
    lib = Tokenizer.from_file(TOKENIZER)
    for df in (spark.read.parquet(f"{SF001}/documents.parquet"), frame(spark, odd_texts)):
        got = {r.id: r for r in bpe.digests(df, TOKENIZER).collect()}
        for r in df.select("doc_id", "text").collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            back = lib.decode(ids, skip_special_tokens=False)
            g = got[r.doc_id]
            assert g.n_tokens == len(ids)
            assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert g.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
            assert back == (r.text or "")


def test_bpe_paths_agree_and_ids_round_trip(spark):
    codec = bpe.Codec(TOKENIZER)
    lib = Tokenizer.from_file(TOKENIZER)
    r = random.Random(2)
    for n in [1, 2, 3, 16, 17, 63, 64, 65, 200, 1000]:
        word = "".join(r.choice("theringsaé") for _ in range(n))
        ids = lib.encode(word, add_special_tokens=False).ids
        assert codec.encode_many([word]) == [",".join(map(str, ids))]
        assert codec.merge_long([codec.of_byte_list[b] for b in word.encode()]) == ids
    made = bpe.encode(spark.createDataFrame([(1, "two words"), (2, None)], "doc_id bigint, text string"), TOKENIZER).orderBy("id").collect()
    assert made[0].decoded == "two words" and made[0].n_tokens == 2 and made[1].ids == "" and made[1].n_tokens == 0
    assert bpe.digests(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


# ---- order MinHash ----------------------------------------------------------------------

def plain_succession(pairs):
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), [-ord(c) for c in p[1] or ""]))
    return [(cur, order[(i + 1) % len(order)]) for i, cur in enumerate(order)]


def plain_signature(text, k=8, bins=64, picked=2):
    """The docstring's signature in plain integers, one k-mer at a time."""
    full, low = (1 << 64) - 1, (1 << 26) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    base = 0x9E3779B97F4A7C15
    grams = [text[i:i + k] for i in range(max(len(text) - k + 1, 1))] if text else []
    seen, items, hashes = {}, [], []
    for at, gram in enumerate(grams):
        h = 0
        for c in gram:
            h = (h * base + ord(c)) & full
        h = mixed(h)
        hashes.append(h)
        number = seen.get(h & ~low, 0)  # occurrences so far
        seen[h & ~low] = number + 1
        items.append((mixed((h & ~low) + number * 0xD1B54A32D192ED03 & full) & ~low, at))
    out = []
    for b in range(bins):
        least = sorted(x for x in items if x[0] >> 58 == b)[:picked]
        places = sorted(at for _, at in least)
        acc = 0
        for at in [None] * (picked - len(places)) + places:  # missing ones first
            acc = mixed((acc * base + (0 if at is None else hashes[at] | 1)) & full)
        out.append(max(acc >> 32, 1) if least else 0)
    return out


def plain_likeness(a, b):
    both = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in both) / len(both) if both else 1.0


def check_succession(got, pairs):
    want = {}
    for (i, t), (_, nxt) in plain_succession(pairs):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        s, x, n = plain_signature(t), plain_signature(e), plain_signature(nxt)
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{v:08x}" for v in s), "".join(f"{v:08x}" for v in x),
                   plain_likeness(s, x), plain_likeness(s, n))
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_order_minhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op10_order_minhash(spark, SF001).collect()
    check_succession(got, [(r.doc_id, r.text) for r in docs])
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])


def test_order_minhash_edges(spark, odd_texts):
    df = frame(spark, odd_texts)
    check_succession(order_minhash.successor_likeness(df, ).collect(), list(enumerate(odd_texts)))
    got = {r.id: r.fingerprint for r in order_minhash.fingerprints(df).collect()}
    assert got[4] == got[5] != got[6] and got[0] == got[1]
    one = spark.createDataFrame([(7, "a single text")], "doc_id bigint, text string")
    r = order_minhash.successor_likeness(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert order_minhash.successor_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "x" * 30), (1, "x" * 30), (None, "y" * 30)], "doc_id bigint, text string")
    assert order_minhash.successor_likeness(twice).count() == 3


def test_order_minhash_minds_order():
    a, b = prose(20, 200), prose(21, 200)
    sig = lambda t: order_minhash.signature(order_minhash.codes_of(t))
    small = a[:700] + "QQ" + a[702:]
    assert order_minhash.likeness(sig(a), sig(small)) > 0.9
    swapped = order_minhash.likeness(sig(a + b), sig(b + a))
    assert swapped < 0.8  # the same k-mers in another order
    assert order_minhash.likeness(sig(a), sig(b)) < 0.1
    assert order_minhash.likeness(sig(""), sig("")) == 1.0 and order_minhash.likeness(sig(""), sig("x")) == 0.0
