"""Query registry: importing the modules registers every query."""

from . import (analytics_queries, clean_queries, io_queries, metric_queries, ml_queries,  # noqa: F401
               split_queries, stream_queries, term_queries)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
