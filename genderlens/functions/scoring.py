"""Scoring expressions: argmax, safe ratios, log-sum-exp cross-entropy and
parsing of stringified prediction lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def argmax(logits) -> Column:
    """0-based index of the largest logit; the first index wins ties."""
    a = col_(logits)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def safe_ratio(num, den) -> Column:
    """num / den, 0.0 when the denominator is 0 (the metric is undefined)."""
    return F.coalesce(F.try_divide(col_(num).cast("double"), col_(den).cast("double")), F.lit(0.0))


def cross_entropy(logits, label) -> Column:
    """-log softmax(logits)[label] computed stably with log-sum-exp."""
    a = col_(logits)
    m = F.array_max(a)
    lse = m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return lse - F.element_at(a, (col_(label) + 1).cast("int"))


PRED_LIST_TOKEN = r"(?<![0-9A-Za-z])([0-9]+)(?![0-9A-Za-z])"


def parse_int_list(c) -> Column:
    """'[np.int64(1), np.int64(0)]' or '[1, 0]' -> array<int>. Look-arounds
    keep the '64' of the type name out."""
    return F.transform(F.regexp_extract_all(col_(c), F.lit(PRED_LIST_TOKEN), 1),
                       lambda s: s.cast("int"))
