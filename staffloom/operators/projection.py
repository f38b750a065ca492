"""Column selection, renaming and reordering."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.names import c
from staffloom.specs import TableSpec


class MissingColumns(ValueError):
    """A table lacks columns its spec requires."""

    def __init__(self, table: str, columns: Sequence[str]):
        super().__init__(f"{table}: missing columns {list(columns)}")
        self.columns = list(columns)


def select_spec(
    df: DataFrame,
    spec: TableSpec,
    order: str = "spec",
    missing: str = "warn",
    skip_derived: bool = False,
) -> DataFrame:
    """Keep the columns of ``spec``, in source or spec order.

    ``missing`` says what to do about absent columns: ``warn`` or ``error``.
    """
    wanted = spec.source_names if skip_derived else spec.names
    present = set(df.columns)
    absent = [name for name in wanted if name not in present]
    if absent and missing == "error":
        raise MissingColumns(spec.name, absent)
    if absent:
        warnings.warn(f"{spec.name}: columns not in the source: {absent}", stacklevel=2)
    if order == "source":
        kept = [name for name in df.columns if name in set(wanted)]
    else:
        kept = [name for name in wanted if name in present]
    return df.select(*[c(name) for name in kept])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the mapped columns that exist; two sources of one name must not both be present."""
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def move_first(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rest = [name for name in df.columns if name not in set(names)]
    return df.select(*[c(name) for name in [*names, *rest]])


def insert_after(df: DataFrame, name: str, value: Column, anchor: str) -> DataFrame:
    """Add (or move) column ``name`` right behind ``anchor``."""
    if anchor not in df.columns:
        raise MissingColumns("insert_after", [anchor])
    out: list[Column] = []
    for col in df.columns:
        if col != name:
            out.append(c(col))
        if col == anchor:
            out.append(value.alias(name))
    return df.select(*out)


def with_constant(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def map_columns(df: DataFrame, names: Iterable[str], fn) -> DataFrame:
    """Apply ``fn`` to the named columns that exist, in one projection."""
    chosen = set(names)
    return df.select(*[fn(c(name)).alias(name) if name in chosen else c(name) for name in df.columns])


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]
