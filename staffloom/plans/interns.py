"""Intern control: contract dates, service time and term flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from staffloom.functions.dates import document_date_from_filename, parse_excel_date
from staffloom.functions.service import days_between, remaining_months, service_label, term_flag, whole_years
from staffloom.functions.text import float_text_to_text, strip
from staffloom.names import c
from staffloom.operators.sets import order_by
from staffloom.sources.layouts import BLANK_RUN, Sheets, discover
from staffloom.specs import contracts, rules, tables

_DATES = ("FECHA ING", "F. RENOVACION")


def intern_sheets(rows: DataFrame) -> Sheets:
    """The layouts of the intern sheets, whose data ends at the first long run of rows without a document."""
    sheet = contracts.INTERNS.sheets[0]
    mine = rows.filter(F.col("sheet") == sheet.sheet)
    return discover(mine, sheet.header_row, sheet.start_col, key="DNI", cut=BLANK_RUN, run=rules.BLANK_RUN)


def intern_control_silver(rows: DataFrame, check_headers: bool = True) -> DataFrame:
    """Sheet rows with a document, up to the first long run without one.

    ``check_headers`` makes a sheet that lacks a column an error.
    """
    spec, sheets = tables.INTERN_CONTROL, intern_sheets(rows)
    data = (sheets.require(spec.names) if check_headers else sheets).table(spec.names)
    return data.select(
        *[
            (parse_excel_date(c(n)) if n in _DATES else strip(float_text_to_text(c(n)))).alias(n)
            for n in spec.names
        ],
        document_date_from_filename(F.col("source_file"), contracts.INTERNS.filename_regex).alias("FECHA_DOCUMENTO"),
    )


def intern_control_gold(silver: DataFrame, ordered: bool = False) -> DataFrame:
    """Service time and term flags per intern; one projection, and a sort if ``ordered``."""
    entry, renewal = F.col("Fecha_Ingreso"), F.col("Fecha_Renovacion")
    days = F.col("dias_servicio")
    out = silver.select(
        "DNI",
        "CONDICION",
        c("FECHA ING").alias("Fecha_Ingreso"),
        c("F. RENOVACION").alias("Fecha_Renovacion"),
        "FECHA_DOCUMENTO",
        "SEDE",
        "UNIVERSIDAD",
        c("JEFE INMEDIATO"),
        "GERENCIA",
    )
    out = out.withColumn("dias_servicio", days_between(entry, renewal))
    out = out.withColumns({"anios_servicio": whole_years(days), "meses_servicio": remaining_months(days)})
    out = out.withColumns(
        {r.column: term_flag(F.col("CONDICION"), days, r.low_days, r.high_days) for r in rules.TERM_RULES}
    )
    out = out.withColumn(
        "tiempo_servicio",
        service_label(
            F.col("anios_servicio"), F.col("meses_servicio"), F.col("por_cumplir_1"), F.col("por_cumplir_2")
        ),
    )
    return order_by(out, [entry.desc_nulls_last()]) if ordered else out
