"""Registered queries: one per operator, each with an equivalent SQL text where SQL can say it."""

from depotlens.plans import (  # noqa: F401  (importing registers)
    ledger_queries, metric_queries, search_queries, source_queries, stream_queries,
)
from depotlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
