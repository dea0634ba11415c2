"""Bindings to the shared tables, registered queries and their check SQL."""

from tremorline.plans import curate_queries, feature_queries, model_queries, signal_queries, source_queries, store_queries
from tremorline.plans.registry import CHECKS, QUERIES

__all__ = [
    "CHECKS",
    "QUERIES",
    "curate_queries",
    "feature_queries",
    "model_queries",
    "signal_queries",
    "source_queries",
    "store_queries",
]
