"""Unions and ordering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.names import c


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_diagonal(*frames: DataFrame) -> DataFrame:
    """Union by name over the superset of columns, first seen first; missing values are null.

    For a handful of tables.  Many files of differing headers go through
    ``sources.sheets.promote_header``, which is one plan for any number of files.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def order_by(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Total order by ``keys`` that still spreads when one key value has most rows.

    A hash of the row and the input split follow as tie-breaks, so that the
    range partitioner can cut inside a run of equal keys, and inside a run of
    equal rows.
    """
    row, split = "__row", "__split"
    ties = [c(n) for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    marked = df.withColumns({row: F.xxhash64(*ties), split: F.spark_partition_id()})
    return marked.orderBy(*keys, c(row), c(split)).drop(row, split)
