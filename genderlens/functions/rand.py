"""Deterministic uniforms drawn from a key hash.

u(key) = first 8 hex digits of md5(key) / 2^32, in [0, 1). The same value is
reproducible in SQL engines with md5, so seeded randomness is repeatable and
independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*parts) -> Column:
    key = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
