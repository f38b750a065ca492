"""Payroll and mining payroll, and payroll enriched with leave reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from staffloom.functions.dates import month_name, period_from_filename
from staffloom.functions.periods import period_month, period_year
from staffloom.functions.text import strip
from staffloom.names import c
from staffloom.operators.aggregates import string_agg_ordered
from staffloom.operators.casting import cast_spec
from staffloom.operators.filters import filter_not_null
from staffloom.operators.joins import left_join
from staffloom.operators.projection import insert_after, map_columns, select_spec, string_columns
from staffloom.operators.quality import WARNING
from staffloom.operators.watch import Watch
from staffloom.sources.layouts import Sheets, discover
from staffloom.sources.sheets import is_data_row
from staffloom.specs import TableSpec, contracts, tables

PERSON_PERIOD = ["DNI/CEX", "PERIODO"]
_FROM_FILE = ("PERIODO", "AÑO", "MES")


def not_earlier_output(rows: DataFrame) -> DataFrame:
    """Rows of files that are a payroll source: no lock file, and no earlier consolidated output."""
    for prefix in contracts.PAYROLL_EXCLUDED:
        rows = rows.filter(~F.col("source_file").startswith(prefix))
    return rows


def payroll_sheets(rows: DataFrame, every: bool = False) -> Sheets:
    """The layouts of the monthly sheets: of files with a period in their name, and not of an earlier output."""
    sheet = contracts.PAYROLL.sheets[0]
    mine = not_earlier_output(rows).filter((F.col("sheet") == sheet.sheet) & period_from_filename(F.col("source_file")).isNotNull())
    return discover(mine, sheet.header_row, sheet.start_col, "gap", every=every)


def payroll_silver(
    rows: DataFrame, spec: TableSpec = tables.PAYROLL, extra: Sequence[str] = (), watch: Watch | None = None
) -> DataFrame:
    """Monthly sheets under one set of columns, with the period of the file name: declared columns, then those of any other header.

    Files without a period in their name are left out; ``skipped_files`` lists them.  ``watch`` counts the rows left out.
    """
    sheets = payroll_sheets(rows)
    wanted = [*[n for n in spec.names if n not in _FROM_FILE], *extra]
    wanted += sheets.undeclared(wanted, _FROM_FILE)
    data = sheets.table(wanted, keep_cells=True)
    if watch:
        data = watch.losses(data, f"{spec.name} rows", {"first cell": is_data_row(F.col("cells")), "DNI/CEX": c("DNI/CEX").isNotNull()})
    data = data.filter(is_data_row(F.col("cells")))
    period = period_from_filename(F.col("source_file"))
    return filter_not_null(data, "DNI/CEX").select(
        period.alias("PERIODO"),
        period_year(period).alias("AÑO"),
        period_month(period).alias("MES"),
        *[c(n) for n in wanted],
    )


def skipped_files(rows: DataFrame) -> DataFrame:
    """Payroll files whose name holds no period."""
    files = rows.select("source_file").distinct()
    return files.filter(period_from_filename(F.col("source_file")).isNull())


def skipped_report(rows: DataFrame) -> DataFrame:
    """``skipped_files`` as findings, one per file."""
    return skipped_files(rows).select(
        F.lit("payroll").alias("source"), F.lit("no_period").alias("rule"), F.lit(None).cast("string").alias("column"),
        F.lit(WARNING).alias("severity"), F.lit(1).cast("long").alias("n_bad"), F.col("source_file").alias("sample"),
    )


def _gold(silver: DataFrame, spec: TableSpec, mode: str) -> DataFrame:
    typed = cast_spec(select_spec(silver, spec), spec, mode)
    trimmed = map_columns(typed, string_columns(typed), strip)
    return insert_after(trimmed, "NOMBRE_MES", month_name(c("MES").try_cast("int")), "MES")


def payroll_gold(silver: DataFrame) -> DataFrame:
    """Typed payroll; a number column with any bad value stays text."""
    return _gold(silver, tables.PAYROLL, "keep_on_failure")


def mining_payroll_gold(silver: DataFrame) -> DataFrame:
    """Typed mining payroll; bad values become null."""
    return _gold(silver, tables.MINING_PAYROLL, "null_on_failure")


def leave_reasons(leave: DataFrame) -> DataFrame:
    """Reasons of paid and unpaid leave per person and period, in one pass over the leave table."""
    return string_agg_ordered(
        leave,
        PERSON_PERIOD,
        "MOTIVO",
        {
            "MOTIVO_CON_GOCE": F.col("TIPO_LICENCIA") == "CON_GOCE",
            "MOTIVO_SIN_GOCE": F.col("TIPO_LICENCIA") == "SIN_GOCE",
        },
    )


def payroll_with_leave(payroll: DataFrame, leave: DataFrame) -> DataFrame:
    """Every payroll row, with the leave reasons of its person and period."""
    return left_join(payroll, leave_reasons(leave), PERSON_PERIOD)
