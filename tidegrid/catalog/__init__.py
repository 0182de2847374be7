"""Every operator as a named query over the benchmark tables, with its SQL twin."""

from tidegrid.catalog import (  # noqa: F401  (importing registers the queries)
    clean_queries,
    dataset_queries,
    forecast_queries,
    quality_queries,
    regularize_queries,
    score_queries,
    source_queries,
    stats_queries,
    window_queries,
)
from tidegrid.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
