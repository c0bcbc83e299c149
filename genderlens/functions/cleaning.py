"""Row-wise cleaning expressions for review tables (author, rating, dates,
labels). All are JVM built-ins, so they run inside whole-stage codegen and
also on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Fixed values (must match the source data's conventions):
# Danish month abbreviation patterns and the English abbreviations they map to,
# applied as regular expressions in this order ("." matches any character).
DANISH_MONTH_MAP = [
    ("jan.", "Jan"), ("feb.", "Feb"), ("mar.", "Mar"), ("apr.", "Apr"),
    ("maj.", "May"), ("jun.", "Jun"), ("jul.", "Jul"), ("aug.", "Aug"),
    ("sep.", "Sep"), ("okt.", "Oct"), ("nov.", "Nov"), ("dec.", "Dec"),
]
# Danish month stems for the strict parser, January to December.
DANISH_MONTH_STEMS = ["jan", "feb", "mar", "apr", "maj", "jun",
                      "jul", "aug", "sep", "okt", "nov", "dec"]
AUTHOR_PREFIX = "Af "


def strip_author(c, mode: str = "parity") -> Column:
    """'parity' strips the character set {A, f, space} from the left (the
    behaviour of a str.lstrip with that set); 'fixed' removes the word "Af"."""
    if mode == "parity":
        return F.expr(f"trim(LEADING '{AUTHOR_PREFIX}' FROM {_sql(c)})") if isinstance(c, str) \
            else F.ltrim(c, AUTHOR_PREFIX)
    return F.regexp_replace(col_(c), r"^Af\s+", "")


def _sql(name: str) -> str:
    return f"`{name}`"


def sentiment(rating) -> Column:
    """>= 5 pos, <= 3 neg, else (4 or null) neu."""
    r = col_(rating)
    return F.when(r >= 5, "pos").when(r <= 3, "neg").otherwise("neu")


def label_encode(sent) -> Column:
    """pos -> 1, neg -> 0, anything else -> null."""
    s = col_(sent)
    return F.when(s == "pos", F.lit(1)).when(s == "neg", F.lit(0))


def danish_date_parity(c) -> Column:
    """Repeat the source's three regex rewrites, then parse 'd. MMM yyyy' and
    render dd/MM/yyyy; null when the rewritten text does not parse."""
    x = col_(c)
    for pat, rep in DANISH_MONTH_MAP:
        x = F.regexp_replace(x, pat, rep)
    x = F.regexp_replace(x, r" \|.*", "")
    x = F.regexp_replace(x, r"(\D)(\d{4})$", "$1 $2")
    # a space in a strptime format matches any run of whitespace
    x = F.regexp_replace(x, r"\s+", " ")
    return F.date_format(F.try_to_date(x, "d. MMM yyyy"), "dd/MM/yyyy")


def danish_date_fixed(c) -> Column:
    """Strict parse: day, any Danish month spelling, year; dd/MM/yyyy or null."""
    months = "|".join(DANISH_MONTH_STEMS)
    pat = rf"^(\d{{1,2}})\.\s*({months})\p{{L}}*\.?\s*(\d{{4}})"
    x = F.lower(F.trim(col_(c)))
    day = F.regexp_extract(x, pat, 1)
    mon = F.array_position(F.array(*[F.lit(m) for m in DANISH_MONTH_STEMS]),
                           F.regexp_extract(x, pat, 2))
    year = F.regexp_extract(x, pat, 3)
    iso = F.concat_ws("-", year, F.lpad(mon.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    made = F.when(day != "", F.try_to_date(iso, "yyyy-MM-dd"))
    return F.date_format(made, "dd/MM/yyyy")
