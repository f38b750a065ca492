"""Column-name helper: HR headers hold dots, slashes, ``#`` and parentheses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def q(name: str) -> str:
    """Quote a column name for use in Spark SQL text."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column reference that never reads a dot as a struct access."""
    return F.col(q(name))
