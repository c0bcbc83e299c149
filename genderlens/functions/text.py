"""Text column expressions with Python-compatible Unicode word classes.

Python's ``\\w``/``\\s`` are Unicode-aware while Java's are ASCII, so the
classes are spelled out explicitly. All functions return JVM-side Column
expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters (Python ``\w`` on str).
W = r"[\p{L}\p{N}_]"
# Anything that is neither a word character nor whitespace (Python ``[^\w\s]``).
NW = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x85\p{Z}]"
WORD_RUN = r"[\p{L}\p{N}_]+"
# A text split into alternating word / non-word runs (concatenation = text).
RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Lower-case, then delete every character that is not word or space.
    Newlines stay and spaces are not collapsed."""
    return F.regexp_replace(F.lower(col_(c)), NW, "")


def clean_name(c) -> Column:
    """Name-list cleaning: the text rule plus trimming."""
    return F.trim(clean_text(c))


def word_runs(c) -> Column:
    """array<string> of maximal word-character runs."""
    return F.regexp_extract_all(col_(c), F.lit(WORD_RUN), 0)


# Unicode whitespace as ``str.split()`` sees it.
SPACE = r"[\s\p{Z}\x0B\x1c-\x1f\x85]"


def ws_words(c) -> Column:
    """Whitespace words, as ``str.split()``; an empty/blank text gives []."""
    t = F.trim(F.regexp_replace(col_(c), SPACE + "+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def quote_regex(term: str) -> str:
    """Escape a literal term for Java and RE2 regex engines alike."""
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\-/" else ch for ch in term)
