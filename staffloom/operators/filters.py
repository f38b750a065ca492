"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.functions.text import is_blank
from staffloom.names import c, q
from staffloom.specs import RowFilter


def filter_not_null(df: DataFrame, key: str) -> DataFrame:
    """Drop rows without the key; a table without the column passes unchanged."""
    return df.filter(c(key).isNotNull()) if key in df.columns else df


def filter_not_blank(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for name in names:
        df = df.filter(~is_blank(c(name)))
    return df


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all", subset=[q(n) for n in df.columns])


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the predicate holds, and where it does not; unknown goes to neither."""
    return df.filter(predicate), df.filter(~predicate)


_CONDITIONS = {
    "EQUAL": lambda col, value: col == value,
    "NOT_EQUAL": lambda col, value: col != value,
    "IS_NULL": lambda col, value: col.isNull(),
    "IS_NOT_NULL": lambda col, value: col.isNotNull(),
}


def apply_filters(df: DataFrame, filters: Sequence[RowFilter]) -> DataFrame:
    """Filters named in a spec; those on absent columns or of unknown kind are skipped."""
    for rule in filters:
        if rule.column in df.columns and rule.condition in _CONDITIONS:
            df = df.filter(_CONDITIONS[rule.condition](c(rule.column), rule.value))
    return df


def not_in(col: Column, allowed: Sequence[object]) -> Column:
    """Outside the list; null is exempt and gives false."""
    return F.coalesce(~col.isin(*allowed), F.lit(False))
