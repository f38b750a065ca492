"""Income declarations of employees and of interns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.functions.dates import month_name
from staffloom.functions.periods import make_period
from staffloom.functions.text import default_if_blank, fill_null, impute, is_sentinel, needs_default, sentinel_to_null
from staffloom.names import c
from staffloom.operators.casting import cast_spec
from staffloom.operators.filters import drop_all_null_rows
from staffloom.operators.projection import insert_after, map_columns, move_first, select_spec
from staffloom.operators.watch import Watch
from staffloom.sources.layouts import BLANK_ROW, Sheets, discover
from staffloom.specs import contracts, rules, tables

# The gold tables need these columns beyond the usual headers of the two sheets.
EMPLOYEE_EXTRA = ("FECHA NACIMIENTO", "SERVICIO", "REGIMEN")
INTERN_EXTRA = ("Jefe Directo", "Lugar de Trabajo", "Modalidad")


def income_sheets(rows: DataFrame, name: str) -> Sheets:
    """The layouts of one of the two sheets, whose data ends at the first row that is blank under all headers."""
    sheet = contracts.INCOME.sheet(name)
    mine = rows.filter(F.col("sheet") == name)
    return discover(mine, sheet.header_row, sheet.start_col, "first_blank", cut=BLANK_ROW)


def _sheet(rows: DataFrame, name: str, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns, then those of any other header."""
    sheets = income_sheets(rows, name)
    wanted = [*wanted, *sheets.undeclared(wanted, ["PERIODO"])]
    return sheets.table(wanted).select(*[c(n) for n in wanted])


def cleaning_rules() -> dict[str, Column]:
    """Predicates of the rows each cleaning rule changes."""
    return {
        "PROYECTO": needs_default(c("PROYECTO")),
        "CODIGO SAP": F.coalesce(is_sentinel(c("CODIGO SAP")), F.lit(False)),
    }


def clean_income(df: DataFrame) -> DataFrame:
    """Default project, sentinel codes to null, empty rows out, period first."""
    out = map_columns(df, ["PROYECTO"], default_if_blank)
    out = map_columns(out, ["CODIGO SAP"], sentinel_to_null)
    out = drop_all_null_rows(out)
    if "AÑO" in out.columns and "MES" in out.columns:
        out = move_first(out.withColumn("PERIODO", make_period(c("AÑO"), c("MES"))), ["PERIODO"])
    return out


def _watched(raw: DataFrame, source: str, watch: Watch | None) -> DataFrame:
    if watch is None:
        return raw
    mine = {name: cond for name, cond in cleaning_rules().items() if name in raw.columns}
    return watch.changes(raw, source, mine)


def income_employees_silver(rows: DataFrame, extra: Sequence[str] = EMPLOYEE_EXTRA, watch: Watch | None = None) -> DataFrame:
    """``watch`` counts the rows that each cleaning rule touches."""
    raw = _sheet(rows, "EMPLEADOS", [*tables.INCOME_EMPLOYEE_HEADERS, *extra])
    return clean_income(_watched(raw, "income_employees rows", watch))


def income_interns_silver(rows: DataFrame, extra: Sequence[str] = INTERN_EXTRA, watch: Watch | None = None) -> DataFrame:
    raw = _sheet(rows, "PRACTICANTES", [*tables.INCOME_INTERN_HEADERS, *extra])
    return clean_income(_watched(raw, "income_interns rows", watch))


def _gold(silver: DataFrame, spec) -> DataFrame:
    typed = cast_spec(select_spec(silver, spec, missing="error"), spec, fraction=False)
    return insert_after(typed, "NOMBRE_MES", month_name(c("MES"), default=""), "MES")


def income_employees_gold(silver: DataFrame) -> DataFrame:
    gold = _gold(silver, tables.INCOME_EMPLOYEES)
    return map_columns(gold, ["SERVICIO", "REGIMEN"], impute)


def income_interns_gold(silver: DataFrame) -> DataFrame:
    gold = _gold(silver, tables.INCOME_INTERNS)
    return map_columns(
        gold, ["Universidad de Procedencia"], lambda col: fill_null(col, rules.DEFAULT_UNIVERSITY)
    )
