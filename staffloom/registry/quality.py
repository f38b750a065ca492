"""Checks, profiles and preflight (V rows and O2 of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staffloom.functions.text import is_blank
from staffloom.names import c
from staffloom.operators import quality as checks
from staffloom.operators.casting import cast_spec
from staffloom.operators.watch import Watch
from staffloom.plans.employees import employee_flags, employees_typed, flag_columns
from staffloom.plans.exams import exam_sheets, exit_exams_enriched, exit_exams_gold
from staffloom.plans.income import clean_income, cleaning_rules, income_employees_gold
from staffloom.plans.payroll import mining_payroll_gold, payroll_gold, payroll_sheets
from staffloom.registry.core import query
from staffloom.registry.functions import as_of
from staffloom.registry.relational import FLAGS_SQL
from staffloom.registry.shaping import PAYROLL_PRESENT, number, stamp
from staffloom.registry.sheets import PAYROLL_EVEN, PAYROLL_FILE
from staffloom.sources.layers import write_current
from staffloom.sources.preflight import preflight
from staffloom.sources.scratch import shared_folder
from staffloom.specs import Col, SheetContract, SourceContract, TableSpec, contracts, tables

_NO_SAMPLE = "cast(NULL AS VARCHAR) AS sample"


def finding(source: str, rule: str, column: str, severity: str, condition: str, table: str) -> str:
    return f"""SELECT '{source}' AS source, '{rule}' AS rule, '{column}' AS "column", '{severity}' AS severity,
    count(*) FILTER (WHERE {condition}) AS n_bad, {_NO_SAMPLE} FROM {table}"""


def _rows_sql(source: str, rule: str, found: dict[str, str | None]) -> str:
    """SQL rows of a metadata finding per column."""
    return " UNION ALL ".join(
        f"""SELECT '{source}' AS source, '{rule}' AS rule, '{column}' AS "column", 'error' AS severity,
    cast(1 AS BIGINT) AS n_bad, {f"'{sample}'" if sample else "cast(NULL AS VARCHAR)"} AS sample"""
        for column, sample in found.items()
    )


_ABSENT = {n: None for n in tables.PAYROLL.names if n not in PAYROLL_PRESENT}
_STILL_TEXT = {
    "F. NACIMIENTO": "date", "FECHA DE INGRESO": "date", "FECHA CESE": "date", "DIAS SUBSIDIO ENFERMEDAD": "integer",
    "DIAS GOCE HABER(D)": "integer", "# HRS EXTRAS SIMP.25%": "float", "# HRS EXTRAS SIMP.35%": "float",
    "SUBS. POR ENFERMEDAD": "float",
}


@query("V1_check_columns", f"""
WITH sheets AS (SELECT DISTINCT {PAYROLL_FILE} AS file, {PAYROLL_EVEN} AS wide FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'),
asked(header, only_wide) AS (VALUES ('APELLIDO PATERNO', NULL), ('TIPO DE DOCUMENTO', NULL), ('MOTIVO CESE', true), ('bono  especial', true), ('nombres', false))
SELECT 'payroll' AS source, 'missing_column' AS rule, header AS "column", 'error' AS severity, count(*) AS n_bad, min(file) AS sample
FROM sheets, asked WHERE only_wide IS NULL OR (only_wide AND NOT wide) GROUP BY header""")
def columns(t):
    asked = ["APELLIDO PATERNO", "TIPO DE DOCUMENTO", "MOTIVO CESE", "bono  especial", "nombres"]
    return checks.check_headers(payroll_sheets(t["payroll_bronze"]).missing(asked), "payroll")


_DATE, _BIGINT, _DOUBLE = (lambda n: stamp(n)), (lambda n: number(n, "BIGINT")), (lambda n: number(n, "DOUBLE"))
_VALUE = {"date": _DATE, "integer": _BIGINT, "float": _DOUBLE}


@query("V2_check_types", " UNION ALL ".join(
    finding("payroll", "wrong_type", n, "error", f'"{n}" IS NOT NULL AND ({_VALUE[k](n)}) IS NULL', "<<payroll_silver>>")
    for n, k in _STILL_TEXT.items()
))
def types(t):
    return checks.check_castable(t["payroll_silver"], tables.PAYROLL)


_NOT_NULL = [
    "PERIODO", "AÑO", "MES", "APELLIDO PATERNO", "NOMBRES", "TIPO DE DOCUMENTO", "DNI/CEX",
]


@query("V3_check_not_null", " UNION ALL ".join(
    finding("payroll", "null", n, "error", f'"{n}" IS NULL', "<<payroll_silver>>") for n in _NOT_NULL
))
def not_null(t):
    return checks.check_not_null(t["payroll_silver"], tables.PAYROLL)


def _allowed_sql(source: str, column: str, allowed: str, severity: str, table: str) -> str:
    bad = f'"{column}" NOT IN ({allowed})'
    return f"""
SELECT '{source}' AS source, 'not_allowed' AS rule, '{column}' AS "column", '{severity}' AS severity,
    (SELECT count(*) FROM {table} WHERE {bad}) AS n_bad,
    (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT "{column}" AS v FROM {table} WHERE {bad} ORDER BY v LIMIT 5)) AS sample"""


@query("V4_check_allowed_payroll", _allowed_sql("payroll", "SEXO", "'M', 'F'", "warning", "<<payroll_silver>>"))
def allowed_payroll(t):
    return checks.check_allowed(t["payroll_silver"], tables.PAYROLL)


@query("V4_check_allowed_leave", _allowed_sql("leave", "TIPO_LICENCIA", "'CON_GOCE', 'SIN_GOCE'", "error", "<<leave>>"))
def allowed_leave(t):
    return checks.check_allowed(t["leave"], tables.LEAVE, checks.ERROR)


_MINING_DAYS = number("DIAS TRABAJADOS", "BIGINT")


@query("V5_check_range", " UNION ALL ".join([
    finding("mining_payroll", "below_min", "MES", "warning", '"MES" < 1', "<<mining_silver>>"),
    finding("mining_payroll", "above_max", "MES", "warning", '"MES" > 12', "<<mining_silver>>"),
    finding("mining_payroll", "below_min", "DIAS TRABAJADOS", "warning", f"{_MINING_DAYS} < 0", "<<mining_silver>>"),
    finding("mining_payroll", "above_max", "DIAS TRABAJADOS", "warning", f"{_MINING_DAYS} > 31", "<<mining_silver>>"),
    finding("mining_payroll", "below_min", "TOTAL INGRESOS", "warning",
            number("TOTAL INGRESOS", "DOUBLE") + " < 0", "<<mining_silver>>"),
    finding("mining_payroll", "below_min", "TOTAL DESCUENTOS", "warning",
            number("TOTAL DESCUENTOS", "DOUBLE") + " < 0", "<<mining_silver>>"),
]))
def ranges(t):
    typed = cast_spec(t["mining_silver"], tables.MINING_PAYROLL)
    return checks.check_range(typed, tables.MINING_PAYROLL)


@query("V6_check_unique", """
SELECT '' AS source, 'duplicate_key' AS rule, 'PERIODO, CENTRO DE COSTOS' AS "column", 'error' AS severity,
       count(*) AS n_bad, cast(NULL AS VARCHAR) AS sample
FROM (SELECT 1 FROM <<payroll_silver>> GROUP BY "PERIODO", "CENTRO DE COSTOS" HAVING count(*) > 1)""")
def unique(t):
    return checks.check_unique(t["payroll_silver"], ["PERIODO", "CENTRO DE COSTOS"])


@query("V7_null_profile", " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) FILTER (WHERE "{n}" IS NULL) AS n_null,
    round(count(*) FILTER (WHERE "{n}" IS NULL) / count(*) * 100, 2) AS pct_null FROM <<employees>>"""
    for n in ["NUMERO DE DOC", "Modalidad de Contrato", "Fecha de Termino", "FECH_INGR.", "FECHA DE NAC.", "SEXO"]
))
def nulls(t):
    names = ["NUMERO DE DOC", "Modalidad de Contrato", "Fecha de Termino", "FECH_INGR.", "FECHA DE NAC.", "SEXO"]
    return checks.null_profile(t["employees"].select(*[c(n) for n in names]))


_PROJECT = """("PROYECTO" IS NULL OR trim("PROYECTO") = '' OR "PROYECTO" = '0')"""
_SAP = """coalesce("CODIGO SAP" LIKE '%#N/D%' OR "CODIGO SAP" LIKE '%#N/A%' OR "CODIGO SAP" ILIKE '%error%', FALSE)"""


@query("V8_change_profile", " UNION ALL ".join(
    f"""SELECT '{n}' AS rule, count(*) FILTER (WHERE {cond}) AS n_changed,
    round(count(*) FILTER (WHERE {cond}) / count(*) * 100, 2) AS pct_changed FROM <<income_raw>>"""
    for n, cond in (("PROYECTO", _PROJECT), ("CODIGO SAP", _SAP))
))
def changes(t):
    return checks.change_profile(t["income_raw"], cleaning_rules())


@query("V9_row_loss", """
SELECT 'MOTIVO' AS step, count(*) FILTER (WHERE "MOTIVO" IS NULL) AS n_lost FROM <<leave>>
UNION ALL SELECT 'TIPO_LICENCIA', count(*) FILTER (WHERE "MOTIVO" IS NOT NULL AND "TIPO_LICENCIA" LIKE 'OTRO%') FROM <<leave>>""")
def loss(t):
    return checks.row_loss(
        t["leave"],
        {"MOTIVO": ~is_blank(c("MOTIVO")), "TIPO_LICENCIA": F.col("TIPO_LICENCIA").isin("CON_GOCE", "SIN_GOCE")},
    )


@query("V10_join_quality", """
WITH s AS (SELECT CASE WHEN "NOMBRE DE CC" = '' THEN 'SIN_CODIGO' WHEN "NOMBRE DE CC" IS NULL OR "NOMBRE DE CC" NOT IN
    (SELECT "CC" FROM <<cc_actual>> UNION SELECT "CC" FROM <<cc_old>>) THEN 'CODIGO_NO_ENCONTRADO' ELSE 'OK' END AS status_match
    FROM <<exams>>)
SELECT status_match, count(*) AS cantidad, round(count(*) / (SELECT count(*) FROM s) * 100, 2) AS porcentaje
FROM s GROUP BY status_match""")
def join_quality(t):
    return checks.join_quality(exit_exams_enriched(t["exams"], t["cc_actual"], t["cc_old"], ordered=False))


@query("V11_flag_summary", "WITH f AS (" + FLAGS_SQL + ")" + " UNION ALL ".join(
    f"""
SELECT 'flag' AS kind, '{name}' AS name, count(*) FILTER (WHERE "{name}") AS cantidad,
       round(count(*) FILTER (WHERE "{name}") / count(*) * 100, 2) AS porcentaje FROM f"""
    for name in flag_columns()
) + """ UNION ALL SELECT 'Modalidad de Contrato', "Modalidad de Contrato", count(*),
       round(count(*) / (SELECT count(*) FROM f) * 100, 2) FROM f GROUP BY "Modalidad de Contrato" """)
def summary(t):
    flagged = employee_flags(t["employees"], as_of())
    return checks.flag_summary(flagged, flag_columns(), "Modalidad de Contrato")


_PREFLIGHT = SourceContract(
    "leave",
    (
        *contracts.LEAVE.sheets,
        SheetContract("RESUMEN", 1, 0, ("TOTAL",)),
        SheetContract("OTROS", 2, 2, ("MOTIVO DE LIC.S.G.H", "periodo", "Falta")),
    ),
    filename_regex=r"(?i)^.*(?:19|20)\d[02468]\.xlsx$",
    enforce_allowed_sheets=False,
)


@query("V12_preflight", """
WITH f AS (SELECT DISTINCT 'CONTROL_DE_LICENCIAS ' || year(l_shipdate) || '.xlsx' AS source, year(l_shipdate) AS y FROM lineitem)
SELECT source, 'file_name' AS rule, cast(NULL AS VARCHAR) AS "column", 'error' AS severity, cast(1 AS BIGINT) AS n_bad,
       source AS sample FROM f WHERE y % 2 = 1
UNION ALL SELECT source, 'missing_sheet', 'RESUMEN', 'error', 1, NULL FROM f
UNION ALL SELECT source, 'header_position', 'OTROS row 2 column 3', 'error', 1, NULL FROM f
UNION ALL SELECT source, 'missing_header', h, 'error', 1, 'OTROS' FROM f, (VALUES ('periodo'), ('Falta')) v(h)""")
def preflight_report(t):
    rows = t["leave_bronze"]
    files = rows.select("source_file").distinct().withColumn("error", F.lit(None).cast("string"))
    return preflight(files, rows, _PREFLIGHT)


@query("V14_severity_policy", f"""
SELECT * FROM ({finding("leave", "null", "MOTIVO", "error", '"MOTIVO" IS NULL', "<<leave>>")}
UNION ALL {finding("leave", "not_allowed", "TIPO_LICENCIA", "error", '"TIPO_LICENCIA" LIKE \'OTRO%\'', "<<leave>>")})""")
def policy(t):
    report = checks.check_table(t["leave"], tables.LEAVE, list_severity=checks.ERROR)
    return report.filter(F.col("severity") == checks.ERROR)


@query("V14_payroll_report", " UNION ALL ".join([
    _rows_sql("payroll", "missing_column", _ABSENT),
    _rows_sql("payroll", "wrong_type", {n: f"{_STILL_TEXT[n]} expected, string found"
                                        for n in ("DIAS GOCE HABER(D)", "# HRS EXTRAS SIMP.35%")}),
    finding("payroll", "null", "APELLIDO PATERNO", "error", '"APELLIDO PATERNO" IS NULL', "<<payroll_silver>>"),
    finding("payroll", "not_allowed", "SEXO", "warning", "\"SEXO\" NOT IN ('M', 'F')", "<<payroll_silver>>"),
    finding("payroll", "below_min", "SUBS. POR ENFERMEDAD", "warning",
            'cast("SUBS. POR ENFERMEDAD" AS DOUBLE) < 0', "<<payroll_silver>>"),
]))
def payroll_report(t):
    return checks.check_table(payroll_gold(t["payroll_silver"]), tables.PAYROLL)


_MARKET = TableSpec("customer", (Col("c_mktsegment", allowed=("BUILDING",)),))


@query("O2_head_sample", """
SELECT 'c_mktsegment' AS "column", string_agg(v, ', ' ORDER BY v) AS sample FROM
(SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY v LIMIT 2)""")
def head(t):
    return checks.invalid_samples(t["customer"], _MARKET, size=2)


# --- rules over several columns -----------------------------------------------------


def _dates(later: str, earlier: str, fraction: bool = True) -> str:
    return f"({stamp(later, fraction)}) <= ({stamp(earlier, fraction)})"


@query("V15_row_rules_payroll", " UNION ALL ".join([
    finding("payroll", "not_after", "FECHA CESE, FECHA DE INGRESO", "warning", _dates("FECHA CESE", "FECHA DE INGRESO"), "<<payroll_silver>>"),
    finding("payroll", "pattern", "PERIODO", "warning", "NOT regexp_full_match(\"PERIODO\", '[0-9]{4}-[0-9]{2}')", "<<payroll_silver>>"),
]))
def payroll_rules(t):
    return checks.check_rows(payroll_gold(t["payroll_silver"]), tables.PAYROLL)


@query("V15_row_rules_mining", " UNION ALL ".join([
    finding("mining_payroll", "no_balance", "NETO", "warning",
            f"abs({number('NETO', 'DOUBLE')} - {number('TOTAL INGRESOS', 'DOUBLE')} + {number('TOTAL DESCUENTOS', 'DOUBLE')}) > 0.05", "<<mining_silver>>"),
    finding("mining_payroll", "negative", "NETO", "warning", f"{number('NETO', 'DOUBLE')} < 0", "<<mining_silver>>"),
    finding("mining_payroll", "after_period", "FECHA DE INGRESO, PERIODO", "warning",
            f"strftime({stamp('FECHA DE INGRESO')}, '%Y-%m') > \"PERIODO\"", "<<mining_silver>>"),
    finding("mining_payroll", "pattern", "PERIODO", "warning", "NOT regexp_full_match(\"PERIODO\", '[0-9]{4}-[0-9]{2}')", "<<mining_silver>>"),
]))
def mining_rules(t):
    return checks.check_rows(mining_payroll_gold(t["mining_silver"]), tables.MINING_PAYROLL)


@query("V15_row_rules_employees", " UNION ALL ".join([
    finding("employees", "not_after", "Fecha de Termino, FECH_INGR.", "warning", _dates("Fecha de Termino", "FECH_INGR.", False), "<<employees_silver>>"),
    finding("employees", "no_rule", "Modalidad de Contrato", "warning",
            "\"Modalidad de Contrato\" = 'CONTRATO POR OBRA' OR NOT (\"Modalidad de Contrato\" SIMILAR TO "
            "'CONTRATO POR OBRA O SERVICIO ESPECIFICO|CONTRATO POR INCREMENTO DE ACTIVIDAD|PLAZO INDETERMINADO|CONTRATO EXTRANJERO|.*TERMINO DE CONVENIO.*')",
            "<<employees_silver>>"),
]))
def employee_rules(t):
    return checks.check_rows(employees_typed(t["employees_silver"]), tables.EMPLOYEES)


@query("V15_pattern_income", finding(
    "income_employees", "pattern", "PERIODO", "warning",
    "NOT regexp_full_match(\"AÑO\" || '-' || lpad(\"MES\", 2, '0'), '[0-9]{4}-[0-9]{2}')", "<<income_raw>>"
))
def income_pattern(t):
    return checks.check_rows(income_employees_gold(clean_income(t["income_raw"])), tables.INCOME_EMPLOYEES)


@query("V15_exam_key", f"""
WITH g AS (SELECT "DNI", {stamp("FECHA DE CESE", False)} AS d FROM <<exams_silver>> WHERE "CARGO" <> 'STUDENT INTERNAL')
SELECT 'exit_exams' AS source, 'duplicate_key' AS rule, 'DNI, FECHA DE CESE' AS "column", 'error' AS severity,
       count(*) AS n_bad, cast(NULL AS VARCHAR) AS sample FROM (SELECT 1 FROM g GROUP BY "DNI", d HAVING count(*) > 1)""")
def exam_key(t):
    return checks.check_unique(exit_exams_gold(t["exams_silver"]), tables.EXIT_EXAMS.primary_key, "exit_exams")


@query("V16_watched_report", " UNION ALL ".join([
    finding("payroll", "null", "APELLIDO PATERNO", "error", '"APELLIDO PATERNO" IS NULL', "<<payroll_silver>>"),
    finding("payroll", "below_min", "SUBS. POR ENFERMEDAD", "warning",
            'cast("SUBS. POR ENFERMEDAD" AS DOUBLE) < 0', "<<payroll_silver>>"),
    """SELECT 'payroll', 'not_allowed', 'SEXO', 'warning', count(*), min("SEXO") || ', ' || max("SEXO")
       FROM <<payroll_silver>> WHERE "SEXO" NOT IN ('M', 'F')""",
    """SELECT 'payroll rows', 'lost', 'SEXO', 'warning', count(*), NULL FROM <<payroll_silver>> WHERE length("SEXO") > 1""",
]))
def watched_report(t):
    """Counts that came with the write of a layer."""
    watch = Watch()
    gold = watch.table(payroll_gold(t["payroll_silver"]), tables.PAYROLL)
    gold = watch.losses(gold, "payroll rows", {"SEXO": F.length("SEXO") == 1})
    write_current(gold.filter(F.length("SEXO") == 1), f"{shared_folder(t.spark)}/staffloom/watched-{uuid.uuid4().hex}")
    return watch.report(t.spark).filter(F.col("rule").isin("null", "not_allowed", "below_min", "lost"))


# --- sheets: what became of their rows ------------------------------------------------


@query("S5_accounting_of_sheets", """
WITH r AS (SELECT 'Examenes ' || strftime(o_orderdate, '%Y-%m') || '.xlsx' AS source_file, o_orderkey + 4 AS row_idx, o_totalprice < 2000 AS blank FROM orders),
cut AS (SELECT source_file, min(row_idx) FILTER (blank) AS first_cut FROM r GROUP BY source_file)
SELECT source_file, count(*) AS landed, count(*) FILTER (row_idx >= first_cut) AS cut, count(*) FILTER (first_cut IS NULL OR row_idx < first_cut) AS kept, any_value(first_cut) AS first_cut
FROM r JOIN cut USING (source_file) GROUP BY source_file""")
def exam_accounting(t):
    return exam_sheets(t["exams_bronze"]).accounting().select("source_file", "landed", "cut", "kept", "first_cut")


@query("S8_accounting_of_footers", f"""
SELECT {PAYROLL_FILE} AS source_file, count(*) AS landed, count(*) FILTER (o_totalprice > 490000) AS footer,
       count(*) FILTER (o_totalprice < 5000) AS no_first_cell, count(*) FILTER (o_totalprice BETWEEN 5000 AND 490000) AS kept
FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' GROUP BY 1""")
def footer_accounting(t):
    told = payroll_sheets(t["payroll_bronze"], every=True).accounting(footers=True)
    return told.select("source_file", "landed", "footer", "no_first_cell", "kept")
