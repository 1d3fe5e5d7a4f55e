"""Collects the registered queries from every catalog module."""

from __future__ import annotations

from . import clean_queries, distribution_queries, metric_queries, model_queries, profile_queries, relation_queries, target_queries  # noqa: F401  (register on import)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
