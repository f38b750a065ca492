"""Exit medical exams, enriched with cost centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from staffloom.functions.dates import month_name, month_of, parse_stamp_or_date, year_of
from staffloom.functions.text import error_cells_to_null, fill_null, strip, strip_dot_zero, whole_float_text
from staffloom.names import c
from staffloom.operators.aggregates import first_value_by_priority
from staffloom.operators.casting import cast_spec
from staffloom.operators.filters import apply_filters
from staffloom.operators.joins import lookup_join, match_status
from staffloom.operators.projection import insert_after, map_columns, select_spec, string_columns
from staffloom.operators.sets import order_by, union_all
from staffloom.sources.layouts import FIRST_BLANK, Sheets, discover
from staffloom.specs import contracts, tables


def exam_sheets(rows: DataFrame) -> Sheets:
    """The layouts of the exam sheets, whose data ends at the first blank first cell."""
    sheet = contracts.EXIT_EXAMS.sheets[0]
    mine = rows.filter(F.col("sheet") == sheet.sheet)
    return discover(mine, sheet.header_row, sheet.start_col, "first_blank", key=0, cut=FIRST_BLANK)


def exit_exams_silver(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Sheet rows up to the first blank first cell; clean text without nulls, dates typed: declared columns, then those of any other header.

    Dates are taken with or without a time of day.
    """
    spec, sheets = tables.EXIT_EXAMS, exam_sheets(rows)
    wanted = list(dict.fromkeys([*spec.source_names, *extra]))
    wanted += sheets.undeclared(wanted, [n for n in spec.names if n not in wanted])
    data = sheets.table(wanted)
    out = data.select(*[strip(whole_float_text(error_cells_to_null(c(n)))).alias(n) for n in wanted])
    out = map_columns(out, tables.EXIT_EXAM_DATES, parse_stamp_or_date)
    out = map_columns(out, ["DNI"], strip_dot_zero)
    return map_columns(out, string_columns(out), lambda col: fill_null(col, ""))


def exit_exams_gold(silver: DataFrame) -> DataFrame:
    """Spec columns, typed, with year and month of the exit date, after the spec's filters."""
    spec = tables.EXIT_EXAMS
    typed = cast_spec(select_spec(silver, spec, skip_derived=True), spec, fraction=False)
    exit_date = c("FECHA DE CESE")
    out = typed.withColumns({"AÑO": year_of(exit_date), "MES": month_of(exit_date)})
    out = insert_after(out, "NOMBRE_MES", month_name(c("MES")), "MES")
    return apply_filters(out, spec.filters)


def unified_cost_centers(current: DataFrame, old: DataFrame) -> DataFrame:
    """One row per code over both catalogues; the current one goes first."""
    names = tables.COST_CENTERS.names
    both = union_all(
        current.select(*[c(n) for n in names], F.lit(2).alias("fuente")),
        old.select(*[c(n) for n in names], F.lit(1).alias("fuente")),
    )
    values = {"NOMBRE CC": "nombre_cc", "CATEGORIA CC": "categoria_cc", "GERENCIA": "gerencia"}
    return first_value_by_priority(both, "CC", values, "fuente")


def exit_exams_enriched(exams: DataFrame, current: DataFrame, old: DataFrame, ordered: bool = False) -> DataFrame:
    """Every exam with its cost centre and the outcome of the lookup."""
    catalog = unified_cost_centers(current, old).select(
        c("CC").alias("NOMBRE DE CC"),
        c("CC").alias("codigo_cc"),
        F.col("nombre_cc").alias("nombre_cc_completo"),
        "categoria_cc",
        "gerencia",
    )
    joined = lookup_join(exams, catalog, "NOMBRE DE CC")
    out = joined.select(
        *[c(n) for n in ("NOMBRE", "DNI", "FECHA DE CESE", "CAUSA DE SALIDA", "CARGO")],
        c("NOMBRE DE CC").alias("codigo_cc_original"),
        *[c(n) for n in ("AÑO", "MES", "NOMBRE_MES")],
        "codigo_cc", "nombre_cc_completo", "categoria_cc", "gerencia",
        match_status(c("NOMBRE DE CC"), F.col("codigo_cc")).alias("status_match"),
    )
    return order_by(out, [c("NOMBRE").asc_nulls_last()]) if ordered else out
