"""All registered queries."""

from __future__ import annotations

from . import bundle_queries, factor_queries, guarded_queries, intraday_queries, model_queries, more_queries, portfolio_queries, record_queries, selection_queries, signal_queries, strategy_queries, stream_queries, table_queries, whole_queries  # noqa: F401
from .registry import ORACLES, QUERIES
from .strategy_queries import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
