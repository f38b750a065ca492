"""Projections, casts and filters (P and F rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staffloom.functions.dates import parse_stamp
from staffloom.functions.service import days_between
from staffloom.names import c
from staffloom.operators.casting import cast_all_string, cast_spec
from staffloom.operators.filters import apply_filters, filter_not_blank, filter_not_null, not_in, split_by
from staffloom.operators.projection import insert_after, move_first, rename, select_spec
from staffloom.plans.employees import is_intern
from staffloom.registry.core import query
from staffloom.specs import RowFilter, tables


def columns(names, prefix: str = "") -> str:
    return ", ".join(f'{prefix}"{n}"' for n in names)


PAYROLL_PRESENT = [
    "PERIODO", "AÑO", "MES", "CÓDIGO CORPORATIVO", "APELLIDO PATERNO", "APELLIDO MATERNO", "NOMBRES",
    "TIPO DE DOCUMENTO", "DNI/CEX", "SEXO", "F. NACIMIENTO", "ÁREA", "CENTRO DE COSTOS", "FECHA DE INGRESO",
    "FECHA CESE", "DIAS SUBSIDIO ENFERMEDAD", "DIAS GOCE HABER(D)", "# HRS EXTRAS SIMP.25%",
    "# HRS EXTRAS SIMP.35%", "SUBS. POR ENFERMEDAD",
]


def stamp(name: str, fraction: bool = True) -> str:
    """SQL for a timestamp text as date, null for text of any other form."""
    form = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}" + (r"(\.\d+)?$" if fraction else "$")
    return f"""CASE WHEN regexp_matches("{name}", '{form}') THEN try_cast(substr("{name}", 1, 10) AS DATE) END"""


def number(name: str, kind: str) -> str:
    form = r"^[+-]?\d+$" if kind == "BIGINT" else r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    return f"""CASE WHEN regexp_matches("{name}", '{form}') THEN try_cast("{name}" AS {kind}) END"""


@query("P1_select_spec_source_order", f"""
SELECT {columns(tables.EMPLOYEES.names)} FROM <<employees_silver>>""")
def source_order(t):
    return select_spec(t["employees_silver"], tables.EMPLOYEES, order="source")


@query("P2_select_spec_order", f"SELECT {columns(PAYROLL_PRESENT)} FROM <<payroll_silver>>")
def spec_order(t):
    return select_spec(t["payroll_silver"], tables.PAYROLL)


@query("P3_select_spec_strict", f"""
SELECT {columns(tables.COST_CENTERS.names)} FROM <<cc_rows>>""")
def strict(t):
    return select_spec(t["cc_rows"], tables.COST_CENTERS, missing="error")


@query("P4_select_spec_skip_derived", f"""
SELECT {columns(tables.EXIT_EXAMS.source_names)} FROM <<exams_silver>>""")
def skip_derived(t):
    return select_spec(t["exams_silver"], tables.EXIT_EXAMS, skip_derived=True)


@query("P5_rename", 'SELECT "DNI/CEX", "MOTIVO" FROM <<leave>>')
def renamed(t):
    raw = t["leave"].select(c("DNI/CEX"), c("MOTIVO").alias("MOTIVO DE LIC.S.G.H"))
    return rename(raw, tables.LEAVE.renames)


@query("P6_move_first", 'SELECT "MES", "PERIODO", "NOMBRES" FROM <<payroll_silver>>')
def moved(t):
    return move_first(t["payroll_silver"].select("NOMBRES", "PERIODO", "MES"), ["PERIODO", "MES"])


@query("P7_insert_after", 'SELECT "PERIODO", "PERIODO" || \'-01\' AS "DIA", "MES" FROM <<payroll_silver>>')
def inserted(t):
    df = t["payroll_silver"].select("PERIODO", "MES")
    return insert_after(df, "DIA", F.concat(c("PERIODO"), F.lit("-01")), "PERIODO")


@query("P8_cast_all_string", """
SELECT c_custkey, c_name, cast(c_nationkey AS VARCHAR) AS c_nationkey, cast(c_acctbal AS VARCHAR) AS c_acctbal,
       c_mktsegment FROM customer""")
def all_string(t):
    return cast_all_string(t["customer"], except_=["c_custkey"])


@query("P9_cast_keep_on_failure", f"""
SELECT "DNI/CEX", cast("MES" AS BIGINT) AS "MES", {stamp("F. NACIMIENTO")} AS "F. NACIMIENTO",
       cast("DIAS SUBSIDIO ENFERMEDAD" AS BIGINT) AS "DIAS SUBSIDIO ENFERMEDAD", "DIAS GOCE HABER(D)",
       cast("# HRS EXTRAS SIMP.25%" AS DOUBLE) AS "# HRS EXTRAS SIMP.25%", "# HRS EXTRAS SIMP.35%"
FROM <<payroll_silver>>""")
def keep_on_failure(t):
    names = ["DNI/CEX", "MES", "F. NACIMIENTO", "DIAS SUBSIDIO ENFERMEDAD", "DIAS GOCE HABER(D)",
             "# HRS EXTRAS SIMP.25%", "# HRS EXTRAS SIMP.35%"]
    return cast_spec(t["payroll_silver"].select(*[c(n) for n in names]), tables.PAYROLL, "keep_on_failure")


@query("P10_cast_null_on_failure", f"""
SELECT "DNI/CEX", cast("MES" AS BIGINT) AS "MES", {number("DIAS TRABAJADOS", "BIGINT")} AS "DIAS TRABAJADOS",
       {number("TOTAL INGRESOS", "DOUBLE")} AS "TOTAL INGRESOS", {number("NETO", "DOUBLE")} AS "NETO",
       {stamp("FECHA DE INGRESO")} AS "FECHA DE INGRESO"
FROM <<mining_silver>>""")
def null_on_failure(t):
    names = ["DNI/CEX", "MES", "DIAS TRABAJADOS", "TOTAL INGRESOS", "NETO", "FECHA DE INGRESO"]
    return cast_spec(t["mining_silver"].select(*[c(n) for n in names]), tables.MINING_PAYROLL)


@query("P11_parse_stamp", f"""
SELECT "DNI/CEX", {stamp("FECHA CESE")} AS with_fraction, {stamp("FECHA CESE", False)} AS whole_seconds
FROM <<payroll_silver>>""")
def stamps(t):
    text = c("FECHA CESE")
    return t["payroll_silver"].select(
        c("DNI/CEX"), parse_stamp(text).alias("with_fraction"), parse_stamp(text, False).alias("whole_seconds")
    )


@query("P12_literal_and_alias", """
SELECT e.*, 2 AS fuente, e."NOMBRE CC" AS nombre_cc FROM <<cc_actual>> e""")
def literals(t):
    return t["cc_actual"].select("*", F.lit(2).alias("fuente"), c("NOMBRE CC").alias("nombre_cc"))


@query("F1_filter_not_null", 'SELECT "NUMERO DE DOC", "SEXO" FROM <<employees>> WHERE "NUMERO DE DOC" IS NOT NULL')
def not_null(t):
    return filter_not_null(t["employees"], "NUMERO DE DOC").select(c("NUMERO DE DOC"), "SEXO")


@query("F2_filter_not_blank", """
SELECT "DNI", "PROYECTO", "REGIMEN" FROM <<income_raw>>
WHERE "PROYECTO" IS NOT NULL AND trim("PROYECTO") <> '' AND "REGIMEN" IS NOT NULL AND trim("REGIMEN") <> ''""")
def not_blank(t):
    return filter_not_blank(t["income_raw"], ["PROYECTO", "REGIMEN"]).select("DNI", "PROYECTO", "REGIMEN")


@query("F3_split_by", """
SELECT "NUMERO DE DOC", contains("Modalidad de Contrato", 'TERMINO DE CONVENIO') AS is_intern
FROM <<employees_silver>> WHERE "Modalidad de Contrato" IS NOT NULL""")
def split(t):
    interns, employees = split_by(t["employees_silver"], is_intern())
    key = c("NUMERO DE DOC")
    return interns.select(key, F.lit(True).alias("is_intern")).unionByName(
        employees.select(key, F.lit(False).alias("is_intern"))
    )


@query("F4_apply_filters", """
SELECT "DNI", "CARGO", "CAUSA DE SALIDA" FROM <<exams_silver>>
WHERE "CARGO" <> 'STUDENT INTERNAL' AND "CAUSA DE SALIDA" = 'CESE' AND "FECHA DE CESE" IS NOT NULL""")
def filters(t):
    rules = [
        *tables.EXIT_EXAMS.filters,
        RowFilter("CAUSA DE SALIDA", "EQUAL", "CESE"),
        RowFilter("FECHA DE CESE", "IS_NOT_NULL"),
        RowFilter("NO EXISTE", "EQUAL", "x"),
    ]
    return apply_filters(t["exams_silver"], rules).select("DNI", "CARGO", c("CAUSA DE SALIDA"))


@query("F5_between", """
SELECT "N°", "F. RENOVACION" - "FECHA ING" AS dias,
       ("F. RENOVACION" - "FECHA ING") BETWEEN 335 AND 364 AS near_one, ("F. RENOVACION" - "FECHA ING") >= 365 AS past_one
FROM <<interns>> WHERE ("F. RENOVACION" - "FECHA ING") BETWEEN 335 AND 729""")
def between(t):
    days = days_between(c("FECHA ING"), c("F. RENOVACION"))
    return t["interns"].filter(days.between(335, 729)).select(
        c("N°"), days.cast("long").alias("dias"), days.between(335, 364).alias("near_one"), (days >= 365).alias("past_one")
    )


@query("F6_not_in", """
SELECT "DNI/CEX", "SEXO" FROM <<payroll_silver>> WHERE "SEXO" NOT IN ('M', 'F') AND "SEXO" IS NOT NULL""")
def outside(t):
    return t["payroll_silver"].filter(not_in(c("SEXO"), ["M", "F"])).select(c("DNI/CEX"), "SEXO")
