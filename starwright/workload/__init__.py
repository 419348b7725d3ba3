"""All registered queries, grouped by operator family."""

from starwright.workload.registry import QUERIES, SQL
from starwright.workload import (  # noqa: F401  (registers the queries)
    aggregates,
    charts,
    cleaning,
    ingest,
    jobs,
    joining,
    loads,
    pivots,
    series,
    sets,
)

__all__ = ["QUERIES", "SQL"]
