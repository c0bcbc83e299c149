"""Text augmentation (Q6-Q8, Q10): random deletion, random swap, the
paraphrase arm and fixed-length encoding, all as higher-order column
expressions with hashed uniforms (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_uniform
from ..functions.text import ws_words
from ..session import BROADCAST_KNOWN_ROWS, sized
from .joins import join_known
from .ranking import rank_by_order

#: Words of a vocabulary that are broadcast with their ids.
HOT = BROADCAST_KNOWN_ROWS


def _u(id_col: str, tag, seed: int) -> Column:
    return hash_uniform(F.col(id_col).cast("string"), tag if isinstance(tag, Column) else F.lit(str(tag)),
                        F.lit(str(seed)))


def random_deletion(df: DataFrame, text: str, id_col: str, out: str, p: float = 0.3,
                    seed: int = 123) -> DataFrame:
    """Q6: keep each word with probability 1 - p; a one-word or empty text is
    returned unchanged; if every word is dropped, one random word is kept."""
    x = df.withColumn("__ws", ws_words(text))
    words = F.col("__ws")
    n = F.size(words)
    x = x.withColumn("__kept", F.filter(words, lambda w, i: _u(id_col, i.cast("string"), seed) > p))
    pick = F.element_at(words, (F.floor(_u(id_col, "pick", seed) * n) + 1).cast("int"))
    return (x.withColumn(out, F.when(n <= 1, F.col(text))
                         .when(F.size("__kept") == 0, pick)
                         .otherwise(F.array_join("__kept", " ")))
            .drop("__ws", "__kept"))


def random_swap(df: DataFrame, text: str, id_col: str, out: str, n_swaps: int = 5,
                seed: int = 123) -> DataFrame:
    """Q7: n sequential swaps of two distinct random positions. The swap
    positions are drawn once per row, then folded over the word array."""
    x = df.withColumn("__ws", ws_words(text)).withColumn("__n", F.size("__ws"))
    n = F.col("__n")

    def draw(k):
        a = F.floor(_u(id_col, F.concat(F.lit("swap:"), (k * 2).cast("string")), seed) * n).cast("int")
        o = (F.lit(1) + F.floor(_u(id_col, F.concat(F.lit("swap:"), (k * 2 + 1).cast("string")), seed)
                                * (n - 1))).cast("int")
        return F.struct(a.alias("a"), ((a + o) % n).cast("int").alias("b"))

    x = x.withColumn("__sw", F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.lit(n_swaps)), draw)))

    def step(acc, s):
        return F.transform(acc, lambda w, i: F.when(i == s["a"], F.element_at(acc, s["b"] + 1))
                           .when(i == s["b"], F.element_at(acc, s["a"] + 1)).otherwise(w))

    swapped = F.aggregate("__sw", F.col("__ws"), step)
    return (x.withColumn(out, F.when(n < 2, F.col(text)).otherwise(F.array_join(swapped, " ")))
            .drop("__ws", "__n", "__sw"))


def augment(df: DataFrame, paraphrases: DataFrame | None, id_col: str = "ID", text: str = "text",
            label: str = "label", max_chars: int = 5000, seed: int = 123) -> DataFrame:
    """Q8: per row up to three new rows - paraphrase (when one exists and the
    text fits the length gate), deletion, swap - with the label copied."""
    x = df
    if paraphrases is not None:
        x = x.join(paraphrases.select(id_col, "paraphrase"), id_col, "left")
        para = F.when(F.length(text) <= max_chars, F.col("paraphrase"))
    else:
        para = F.lit(None).cast("string")
    x = random_deletion(x, text, id_col, "__del", 0.3, seed)
    x = random_swap(x, text, id_col, "__swap", 5, seed)
    arms = F.array(
        F.struct(F.lit("paraphrase").alias("kind"), para.alias("text")),
        F.struct(F.lit("deletion").alias("kind"), F.col("__del").alias("text")),
        F.struct(F.lit("swap").alias("kind"), F.col("__swap").alias("text")))
    return (x.select(id_col, label, F.explode(arms).alias("a"))
            .filter(F.col("a.text").isNotNull())
            .select(id_col, F.col("a.kind").alias("kind"), F.col("a.text").alias("text"), label))


def _words(docs: DataFrame, text: str) -> Column:
    """The words of a text column, or of one that holds them already."""
    return F.col(text) if docs.schema[text].dataType.typeName() == "array" else ws_words(text)


def vocabulary_ids(docs: DataFrame, text: str, first_id: int = 4) -> DataFrame:
    """(word, id): the words of ``text`` (which may be an array of words) ranked
    by corpus frequency (desc), then word; ids start after the special tokens. Runs jobs: the words are counted once and
    written; the counted vocabulary is range-partitioned by its order, so the
    long tail of equally rare words is spread like the rest."""
    counts = sized(docs.select(F.explode(_words(docs, text)).alias("word"))
                   .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = rank_by_order(counts, [F.col("cnt").desc(), F.col("word")], "r")
    return ranked.select("word", (F.col("r") + first_id).cast("int").alias("id"))


def encode(docs: DataFrame, vocab_ids: DataFrame, id_col: str, text: str, length: int = 16,
           cls_id: int = 2, sep_id: int = 3, unk_id: int = 1, first_id: int = 4) -> DataFrame:
    """Q10: [CLS] + ids of the first length-2 words + [SEP], zero-padded to
    ``length``, with a 1/0 attention mask; ``text`` may be an array of words. Only
    the words that fit are exploded and joined, so the shuffle is bounded by
    docs x length. The vocabulary is written once; its most frequent words
    (those with ids below ``first_id + HOT``) are broadcast and meet the words
    where they are, and only the rarer words are shuffled."""
    vocab = sized(vocab_ids)
    head = docs.select(id_col, F.posexplode(F.slice(_words(docs, text), 1, length - 2)).alias("p", "word"))
    hot, tail = vocab.where(F.col("id") < first_id + HOT), vocab.where(F.col("id") >= first_id + HOT)
    j = join_known(head, hot, None if tail.isEmpty() else tail, "word", "left").select(
        id_col, "p", F.coalesce(F.col("id"), F.lit(unk_id)).alias("id"))
    ids = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("p", "id"))).alias("s"))
    allids = docs.select(id_col).join(ids, id_col, "left").select(
        id_col, F.coalesce(F.transform("s", lambda s: s["id"]), F.array().cast("array<int>")).alias("w"))
    body = F.concat(F.array(F.lit(cls_id)), F.col("w"), F.array(F.lit(sep_id)))
    pad = F.array_repeat(F.lit(0), F.lit(length) - F.size(body))
    return allids.select(id_col, F.concat(body, pad).alias("input_ids"),
                         F.concat(F.array_repeat(F.lit(1), F.size(body)), pad).alias("attention_mask"))
