"""All registered queries and oracles."""

from __future__ import annotations

from evalspark.plans import (  # noqa: F401
    experiment_queries,
    io_queries,
    outcome_queries,
    table_queries,
    text_queries,
)
from evalspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
