"""Typing of string tables by spec."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.functions.dates import parse_stamp
from staffloom.functions.text import FLOAT_TEXT, INTEGER_TEXT
from staffloom.names import c
from staffloom.operators.projection import map_columns
from staffloom.specs import Col, TableSpec

# Words a float column may hold besides digits.
_FLOAT_WORDS = r"(?i)^[+-]?(?:nan|inf|infinity)\z"


def cast_all_string(df: DataFrame, except_: Iterable[str] = ()) -> DataFrame:
    keep = set(except_)
    return map_columns(df, [n for n in df.columns if n not in keep], lambda col: col.cast("string"))


def typed_column(df: DataFrame, spec: Col, fraction: bool) -> Column:
    """Value of the declared type, null where the text does not hold one.

    Spark trims text before a cast and takes Java suffixes such as ``1d``; the
    shape tests keep ``' 31 '``, ``'31.0'`` and ``'1d'`` out of number columns.
    """
    col, source = c(spec.name), dict(df.dtypes)[spec.name]
    if source != "string" or spec.type == "string":
        return col.try_cast(spec.spark_type)
    if spec.type == "integer":
        return F.when(col.rlike(INTEGER_TEXT), col.try_cast("long"))
    if spec.type == "float":
        return F.when(col.rlike(FLOAT_TEXT) | col.rlike(_FLOAT_WORDS), col.try_cast("double"))
    if spec.type == "date":
        return parse_stamp(col, fraction)
    return col.try_cast(spec.spark_type)


def cast_spec(
    df: DataFrame,
    spec: TableSpec,
    mode: str = "null_on_failure",
    fraction: bool = True,
) -> DataFrame:
    """Cast the spec's columns.

    ``null_on_failure`` nulls bad values.  ``keep_on_failure`` leaves a numeric
    column as text when any of its values is bad; finding that out is one
    aggregate over all such columns, which moves one row per task.
    """
    typed = {col.name: typed_column(df, col, fraction) for col in spec.columns if col.name in df.columns}
    if mode == "keep_on_failure":
        source = dict(df.dtypes)
        strict = [
            col.name
            for col in spec.columns
            if col.name in typed and col.type in ("integer", "float") and source[col.name] == "string"
        ]
        if strict:
            failed = df.agg(
                *[
                    F.coalesce(F.bool_or(c(n).isNotNull() & typed[n].isNull()), F.lit(False)).alias(str(i))
                    for i, n in enumerate(strict)
                ]
            ).first()
            for i, name in enumerate(strict):
                if failed[i]:
                    typed[name] = c(name)
    elif mode != "null_on_failure":
        raise ValueError(f"unknown cast mode {mode!r}")
    return df.select(*[typed.get(name, c(name)).alias(name) for name in df.columns])
