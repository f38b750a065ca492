"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staffloom.registry.views import VIEW_SQL, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)


def expand(sql: str) -> str:
    """Replace every ``<<view>>`` with the view's SELECT."""
    while "<<" in sql:
        sql = re.sub(r"<<(\w+)>>", lambda m: f"({VIEW_SQL[m.group(1)]})", sql)
    return sql


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return register
