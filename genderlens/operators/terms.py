"""Gendered-term counting and counterfactual rewrites for the fixed lexicon
(T4-T9, T14), JVM-side and without a shuffle.

One regex scan per text (a prefix-trie alternation of all terms) marks the
words that contain any lexicon term, so per-term work touches only those few
words. A word is rewritten by the ordered fold over all terms (cascades
included) and the text is rebuilt from the marked words and the segments
between them. Terms and replacements made of word characters never cross a
word boundary, so rewriting words is the same as rewriting the whole text.
Where that does not hold (a text with a term of other characters, or with the
mark itself) the whole text is folded.

Lexicons of any size (name lists) are in ``names``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import W, col_, quote_regex, word_runs

_WORD_ONLY = re.compile(r"^\w+$")


def is_word_term(t: str) -> bool:
    return bool(_WORD_ONLY.match(t))


# --------------------------------------------------------------- shared rules
def _lex_array(pairs) -> Column:
    return F.array(*[
        F.struct(F.lit(t).alias("term"),
                 F.lit(f"({quote_regex(t)})({W}*)").alias("pattern"),
                 F.lit(r.replace("\\", "\\\\").replace("$", "\\$") + "$2").alias("replacement"))
        for t, r in pairs])


def fold(c: Column, pairs) -> Column:
    """Ordered fold: each term, in order, replaces its first hit in every
    word (the rest of the word is kept); later terms see earlier output."""
    if not pairs:
        return c
    return F.aggregate(
        _lex_array(pairs), c,
        lambda acc, x: F.when(F.instr(acc, x["term"]) > 0,
                              F.regexp_replace(acc, x["pattern"], x["replacement"])).otherwise(acc))


def mask_text(text, pairs) -> Column:
    """Whole-text fold (reference form; the word path below is faster)."""
    return fold(col_(text), pairs)


def neutral_pattern(terms) -> str:
    """One leftmost alternation, longest term first: a hit deletes the term
    and the rest of its word."""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    return "(?:" + "|".join(quote_regex(t) for t in ordered) + f"){W}*"


def trie_regex(terms) -> str:
    """Alternation of ``terms`` factored by common prefixes, so testing a
    position costs a few character comparisons instead of one per term."""
    root: dict = {}
    for t in set(terms):
        node = root
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node) -> str:
        alts = [quote_regex(ch) + emit(child) for ch, child in sorted(node.items()) if ch != ""]
        if not alts:
            return ""
        if len(alts) > 6:  # asked by groups of first letters: a position tries few of them
            first = sorted(ch for ch in node if ch != "")
            alts = [f"(?=[{''.join(map(quote_regex, first[i:i + 4]))}])(?:{'|'.join(alts[i:i + 4])})" for i in range(0, len(alts), 4)]
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        if "" in node:
            return f"(?:{body})?" if len(alts) == 1 and len(alts[0]) > 1 else (
                body + "?" if len(alts[0]) == 1 and len(alts) == 1 else f"(?:{body})?")
        return body

    return "(?:" + emit(root) + ")"


def hit_word_regex(terms) -> str:
    """Whole words that contain at least one of ``terms``."""
    return f"(?<!{W}){W}*?{trie_regex(terms)}{W}*"


#: Marks the words that contain a term; cleaned texts hold no control signs.
MARK = "\u0001"


def _with_hits(df: DataFrame, text: str, words) -> DataFrame:
    """``__parts``: the text cut at its hit words by one regex scan (segments
    at even, hit words at odd places); ``__hits``: the hit words."""
    marked = F.regexp_replace(col_(text), f"({hit_word_regex(words)})", f"{MARK}$1{MARK}")
    return df.withColumn("__parts", F.split(marked, MARK, -1)).withColumn(
        "__hits", F.filter("__parts", lambda p, i: i % 2 == 1))


def _folder(pairs):
    return lambda c: fold(c, pairs)


def add_masks(df: DataFrame, text: str, outputs: dict, universe) -> DataFrame:
    """Rewrites. ``outputs``: column name -> list of (term, repl) pairs for
    an ordered fold, or the string 'neutral'. A null text stays null."""
    words = [t for t in universe if is_word_term(t)]
    return _masks(_with_hits(df, text, words), text, outputs, universe).drop("__parts", "__hits")


def _masks(x: DataFrame, text: str, outputs: dict, universe) -> DataFrame:
    other = [t for t in universe if not is_word_term(t)]
    words = [t for t in universe if is_word_term(t)]
    whole = F.instr(col_(text), MARK) > 0
    for t in other:
        whole = whole | (F.instr(col_(text), t) > 0)
    for out, spec in outputs.items():
        if spec == "neutral":
            word_fn = (lambda p: (lambda w: F.regexp_replace(w, p, "")))(neutral_pattern(words))
            text_fn = (lambda p: (lambda w: F.regexp_replace(w, p, "")))(neutral_pattern(universe))
        else:
            word_fn, text_fn = _folder([(t, r) for t, r in spec if is_word_term(t)]), _folder(spec)
        pieces = F.transform("__parts", lambda p, i: F.when(i % 2 == 1, word_fn(p)).otherwise(p))
        x = x.withColumn(out, F.when(whole, text_fn(col_(text))).when(F.size("__hits") > 0, F.array_join(pieces, ""))
                         .otherwise(col_(text)))
    return x


def count_terms_words(hits: Column, text: Column, terms) -> Column:
    """array<struct<term, n>>, n = number of ``term\\w*`` matches in the text
    = number of word occurrences containing the term (zeros included).

    ``hits`` holds every occurrence of a word containing some term. A term
    is looked up in the short string of distinct hit words first; only the
    terms present are counted, over the joined hit occurrences (the space
    separators keep a match inside its word)."""
    distinct = F.array_join(F.array_distinct(hits), " ")
    joined = F.array_join(hits, " ")
    arr = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(quote_regex(t) + W + "*").alias("pattern"))
                    for t in terms])

    def n_of(x):
        if not terms:
            return F.lit(0)
        return F.when(F.instr(F.col("__hw_distinct"), x["term"]) > 0,
                      F.regexp_count(F.col("__hw_joined"), x["pattern"])).otherwise(F.lit(0))

    out = F.transform(arr, lambda x: F.struct(x["term"].alias("term"), n_of(x).cast("int").alias("n")))
    other = [t for t in terms if not is_word_term(t)]
    if other:
        fixed = {t: F.regexp_count(text, F.lit(quote_regex(t) + W + "*")) for t in other}
        out = F.transform(out, lambda e: F.struct(e["term"].alias("term"), _pick(e, fixed).cast("int").alias("n")))
    return out, distinct, joined


def _pick(e, fixed):
    c = e["n"]
    for t, expr in fixed.items():
        c = F.when(e["term"] == t, expr).otherwise(c)
    return c


def masked_table(docs: DataFrame, text: str, f2m, m2f, universe, pronouns) -> DataFrame:
    """Counts (map incl. zeros), totals and the three rewrites per row."""
    words = [t for t in universe if is_word_term(t)]
    prons = F.array(*[F.lit(p) for p in pronouns])
    x = _with_hits(docs, text, words)
    counts, distinct, joined = count_terms_words(F.col("__hits"), col_(text), list(universe))
    x = (x.withColumn("__hw_distinct", distinct).withColumn("__hw_joined", joined)
         .withColumn("__c", counts).drop("__hw_distinct", "__hw_joined"))
    x = (x.withColumn("count_table", F.map_from_entries(F.col("__c")))
         .withColumn("count_total", F.aggregate(F.col("__c"), F.lit(0), lambda a, e: a + e["n"]))
         .withColumn("count_prons", F.aggregate(
             F.col("__c"), F.lit(0),
             lambda a, e: a + F.when(F.array_contains(prons, e["term"]), e["n"]).otherwise(0)))
         .drop("__c"))
    return _masks(x, text, {"text_all_male": f2m, "text_all_female": m2f, "text_all_neutral": "neutral"},
                  universe).drop("__parts", "__hits")


def render_counts(m) -> Column:
    """Non-zero entries of a count map as 'term=n,...' sorted by term."""
    e = F.array_sort(F.filter(F.map_entries(col_(m)), lambda x: x["value"] > 0))
    return F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")


# ----------------------------------------------------------------- vocabulary
def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """Distinct word runs (deduplicated per document first, then globally
    with a partial aggregation, so hot words cost one row per task)."""
    return (docs.select(F.explode(F.array_distinct(word_runs(text))).alias("word"))
            .distinct())
