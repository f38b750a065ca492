"""Queries over the test tables, each with SQL that gives the same rows."""

from staffloom.registry.core import ORACLES, QUERIES
from staffloom.registry import (  # noqa: F401  (they register their queries)
    datasets,
    functions,
    quality,
    relational,
    shaping,
    sheets,
)

__all__ = ["ORACLES", "QUERIES"]
