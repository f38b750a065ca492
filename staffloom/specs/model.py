"""Declarative table and source specs, one shape for every dataset."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from staffloom.specs.row_rules import RowRule

SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
}


@dataclass(frozen=True)
class Col:
    """One column of a typed table."""

    name: str
    type: str = "string"
    nullable: bool = True
    required: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple[str, ...] = ()
    derived_from: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]


@dataclass(frozen=True)
class RowFilter:
    """A row filter named in a table spec."""

    column: str
    condition: str
    value: str | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Col, ...]
    primary_key: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)
    filters: tuple[RowFilter, ...] = ()
    row_rules: tuple[RowRule, ...] = ()

    @property
    def names(self) -> list[str]:
        return [col.name for col in self.columns]

    @property
    def source_names(self) -> list[str]:
        """Columns expected from the source, without the derived ones."""
        return [col.name for col in self.columns if col.derived_from is None]

    def __getitem__(self, name: str) -> Col:
        for col in self.columns:
            if col.name == name:
                return col
        raise KeyError(name)

    def __contains__(self, name: object) -> bool:
        return any(col.name == name for col in self.columns)

    def to_struct(self) -> T.StructType:
        return T.StructType([T.StructField(col.name, col.spark_type, col.nullable) for col in self.columns])


@dataclass(frozen=True)
class SheetContract:
    """Where the header of a sheet sits (1-based row, 0-based column) and what it must hold."""

    sheet: str
    header_row: int
    start_col: int
    required: tuple[str, ...]


@dataclass(frozen=True)
class SourceContract:
    id: str
    sheets: tuple[SheetContract, ...]
    filename_regex: str | None = None
    document_date: bool = False
    extensions: tuple[str, ...] = (".xlsx", ".xlsm", ".xls")
    enforce_allowed_sheets: bool = False

    def sheet(self, name: str) -> SheetContract:
        for sheet in self.sheets:
            if sheet.sheet == name:
                return sheet
        raise KeyError(name)
