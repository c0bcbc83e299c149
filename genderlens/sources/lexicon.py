"""Ordered gender lexicon.

The lexicon is data: a table ``(term, repl, pos)`` where ``pos`` is the
place of the term in the ordered mapping. Merging mappings keeps the first
position of a term and the last replacement ("last value wins, first
position kept"). Rewrites apply terms in ``pos`` order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The study's word lists, in their original order.
# Female term -> male term (a repeated key keeps its first place, last value).
TERM_PAIRS = [
    # family, relatives
    ("kvinde", "mand"), ("pige", "dreng"), ("søster", "bror"), ("søstre", "brødre"),
    ("datter", "søn"), ("døtre", "sønner"), ("mor", "far"), ("mødre", "fædre"),
    ("moder", "fader"), ("dame", "mand"), ("damer", "mænd"), ("drengepige", "pigedreng"),
    ("kone", "husbond"), ("enke", "enkemand"), ("enker", "enkemænd"), ("frue", "herre"),
    ("hustru", "husbond"), ("tante", "onkel"), ("moster", "morbror"), ("mostre", "morbrødre"),
    ("svigerinde", "svoger"), ("svigerinder", "svogre"), ("veninde", "ven"),
    # English terms
    ("woman", "man"), ("women", "men"), ("mamma", "pappa"), ("girl", "boy"),
    ("gal", "guy"), ("gals", "guys"), ("mrs", "mr"),
    # descriptive
    ("kvindelig", "mandlig"), ("kvindelig", "mandig"), ("moderlig", "faderlig"),
    ("piget", "drenget"), ("pigede", "drengede"), ("feminim", "maskulin"),
    ("søsterlig", "broderlig"), ("lesbiske", "bøssede"),
    # roles and occupations
    ("elskerinde", "elsker"), ("værtinde", "vært"), ("journalistinde", "journalist"),
    ("heltinde", "helt"), ("fjendinde", "fjende"), ("ballerina", "ballerino"),
    ("bestyrerinde", "bestyrer"), ("dronning", "konge"), ("lesbisk", "bøsse"),
    ("danserinde", "danser"), ("forstanderinde", "forstander"), ("gentlewoman", "gentleman"),
    ("gentlewomen", "gentlemen"), ("skuespillerinde", "skuespiller"), ("heks", "troldmand"),
    ("hekse", "troldmænd"), ("lærerinde", "lærer"), ("nonne", "munk"),
    ("prinsesse", "prins"), ("troldkvinde", "troldmand"), ("troldkvinder", "troldmænd"),
    ("brud", "brudgom"),
    # nouns
    ("yoni", "fallos"), ("kusse", "pik"), ("bryster", "brystkasse"), ("bikini", "badeshorts"),
    ("badedragt", "badeshorts"), ("girlband", "boyband"),
]
# Female pronoun -> male pronoun.
PRONOUN_PAIRS = [("hun", "han"), ("hende", "ham"), ("hendes", "hans")]
# Terms without a counterpart: removed from the opposite-gender version.
FEMALE_ONLY_TERMS = ["blondine", "groupie", "gravid", "luder", "dulle", "jomfruhinde",
                     "moderkage", "abort", "babe", "nymfe", "bagerjomfru", "bh", "bimbo",
                     "skabslebbe", "skabslesbisk"]
MALE_ONLY_TERMS = ["playboy", "ungkarl", "spider-man", "macho", "machoprægede",
                   "metroseksuel", "bejler", "blowjob"]
# The six pronouns counted by the pronoun total.
PRONOUNS = ["hun", "hende", "hendes", "han", "ham", "hans"]
# ---------------------------------------------------------------------------


def merge_ordered(entries):
    """Python form of the ordered merge: list of (term, repl) in order ->
    list of (term, repl) with first place kept and last value winning."""
    out: dict[str, str] = {}
    for k, v in entries:
        if k is None or k == "":
            continue
        out[k] = v
    return list(out.items())


def f2m_pairs(female_names=()):
    """Ordered female->male rewrite list (names and one-sided terms -> '')."""
    base = merge_ordered(TERM_PAIRS + PRONOUN_PAIRS)
    return merge_ordered(base + [(n, "") for n in female_names]
                         + [(t, "") for t in FEMALE_ONLY_TERMS])


def m2f_pairs(male_names=()):
    """Ordered male->female rewrite list: the inverted pairs (last wins on
    collisions, first place kept), then names and male-only terms -> ''."""
    base = merge_ordered(TERM_PAIRS + PRONOUN_PAIRS)
    inverted = merge_ordered([(v, k) for k, v in base])
    return merge_ordered(inverted + [(n, "") for n in male_names]
                         + [(t, "") for t in MALE_ONLY_TERMS])


def term_universe(female_names=(), male_names=()):
    return sorted({t for t, _ in f2m_pairs(female_names)} | {t for t, _ in m2f_pairs(male_names)})


# ---------------------------------------------------------------------------
# DataFrame form (used when the lexicon includes data-derived names).

_NAME_BASE = 1_000_000          # names sit after the fixed pairs ...
_ONE_SIDED_BASE = 10 ** 15      # ... and before the one-sided terms


def _entries_df(spark: SparkSession, rows) -> DataFrame:
    """Fixed entries as a literal relation (no Python-backed scan), parsed in
    one call instead of a call per value."""
    def text(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join(f"({text(t)}, {text(r)}, {p}L)" for t, r, p in rows)
    return spark.sql(f"SELECT term, repl, pos FROM VALUES {values} AS entries(term, repl, pos)")


def lexicon_frame(spark: SparkSession, direction: str, names: DataFrame | None = None) -> DataFrame:
    """Ordered rewrite table ``(term, repl, pos)`` for 'f2m' or 'm2f'.

    ``names``: optional ``(name string, gender string, ord long)``; names of
    the source gender map to ''. They take places after the fixed pairs and
    before the one-sided terms, in ``ord`` order."""
    raw = _entries_df(spark, [(k, v, i) for i, (k, v) in enumerate(TERM_PAIRS + PRONOUN_PAIRS)])
    forward = merge_lexicon(raw)
    if direction == "f2m":
        fixed, one_sided, gender = forward, FEMALE_ONLY_TERMS, "female"
    elif direction == "m2f":
        fixed = merge_lexicon(forward.select(F.col("repl").alias("term"),
                                             F.col("term").alias("repl"), "pos"))
        one_sided, gender = MALE_ONLY_TERMS, "male"
    else:
        raise ValueError(direction)
    rows = [(t, "", _ONE_SIDED_BASE + i) for i, t in enumerate(one_sided)]
    entries = fixed.unionByName(_entries_df(spark, rows))
    if names is not None:
        entries = entries.unionByName(
            names.filter(F.col("gender") == gender)
            .select(F.col("name").alias("term"), F.lit("").alias("repl"),
                    (F.lit(_NAME_BASE) + F.col("ord")).cast("long").alias("pos")))
    return merge_lexicon(entries)


def merge_lexicon(entries: DataFrame) -> DataFrame:
    """Last value wins, first place kept; null/empty terms dropped."""
    return (entries.filter(F.col("term").isNotNull() & (F.col("term") != ""))
            .groupBy("term")
            .agg(F.min("pos").alias("pos"), F.max_by("repl", "pos").alias("repl"))
            .select("term", "repl", "pos"))


def universe_frame(f2m: DataFrame, m2f: DataFrame) -> DataFrame:
    return f2m.select("term").union(m2f.select("term")).distinct()
