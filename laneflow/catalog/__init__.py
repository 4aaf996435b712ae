"""Every operator as a query over the standard tables, with the SQL that must give the same rows."""

from laneflow.catalog import (  # noqa: F401  (importing registers the queries)
    q_aggregates, q_columns, q_filters, q_joins, q_models, q_reshape, q_scans, q_stats, q_streams, q_windows,
)
from laneflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
