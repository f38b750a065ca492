"""End-to-end dataset queries (Q rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from staffloom.names import c
from staffloom.plans import employees, exams, income, interns, leave, payroll
from staffloom.registry.core import query
from staffloom.registry.functions import _MONTHS, as_of
from staffloom.registry.relational import FLAGS_SQL, PAID_SQL, UNIFIED_SQL, UNPAID_SQL, mark_sql
from staffloom.registry.shaping import number, stamp
from staffloom.registry.sheets import PAYROLL_EVEN, PAYROLL_FIRST
from staffloom.specs import rules, tables

#: What an intern near the end of a term is called; fixed values.
_TERM_LABELS = {"por_cumplir_1": "'1 año (En límite)'", "por_cumplir_2": "'2 años (Límite Máximo)'"}
_EMPLOYEE_TEXT = [n.name for n in tables.EMPLOYEES.columns if n.type == "string"]
_EMPLOYEE_DATES = [n.name for n in tables.EMPLOYEES.columns if n.type == "date"]
_EMPLOYEES_SQL = (
    "SELECT "
    + ", ".join(f'"{n}"' for n in _EMPLOYEE_TEXT)
    + ", "
    + ", ".join(f'{stamp(n, False)} AS "{n}"' for n in _EMPLOYEE_DATES)
    + " FROM <<employees_silver>> WHERE "
)


@query("Q1_employees_gold", _EMPLOYEES_SQL + "NOT contains(\"Modalidad de Contrato\", 'TERMINO DE CONVENIO')")
def q1(t):
    return employees.employees_gold(t["employees_silver"])


@query("Q1_interns_gold", _EMPLOYEES_SQL + "contains(\"Modalidad de Contrato\", 'TERMINO DE CONVENIO')")
def q1b(t):
    return employees.interns_gold(t["employees_silver"])


@query("Q1_employees_silver", r"""
WITH r AS (SELECT *, 'BD. 01.' || strftime(o_orderdate, '%m.%Y') || '..xlsx' AS source_file, o_orderkey + 11 AS row_idx FROM orders),
cut AS (SELECT source_file, min(row_idx) AS cut FROM r WHERE o_totalprice < 2000 GROUP BY source_file)
SELECT r.source_file, r.row_idx, cast(o_orderkey AS VARCHAR) AS "NUMERO DE DOC", 'SAP' || o_custkey AS "CODIGO SAP2",
       'Empleado ' || o_orderkey AS "NOMBRE COMPLETOS", CASE WHEN o_orderstatus <> 'P' THEN 'G1' END AS "GERENCIA",
       'M' AS "SEXO", cast(NULL AS VARCHAR) AS "SEDE3", 'WHITE' AS "WHITE COLLAR / BLUE COLLAR",
       o_orderpriority AS "Modalidad de Contrato",
       CASE WHEN o_orderstatus = 'P' THEN '31/02/2001' ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS "Fecha de Termino",
       'S' AS "SERVICIO", 'R' AS "REGIMEN DE TRABAJO", strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS "FECH_INGR.",
       cast(NULL AS VARCHAR) AS "FECHA DE NAC.", strftime(o_orderdate, '%Y-%m-01') AS "FECHA_DOCUMENTO",
       CASE WHEN year(o_orderdate) % 2 = 0 THEN o_custkey || '@x' END AS "CORREO",
       CASE WHEN year(o_orderdate) = 1995 THEN cast(o_orderkey AS VARCHAR) END AS "Numero de Doc."
FROM r LEFT JOIN cut ON r.source_file = cut.source_file WHERE cut.cut IS NULL OR r.row_idx < cut.cut""")
def q1c(t):
    return employees.employees_silver(t["employees_bronze"])


@query("Q2_employee_flags", FLAGS_SQL)
def q2(t):
    return employees.employee_flags(t["employees"], as_of())


@query("Q3_cost_centers", f"""
SELECT "CC", "NOMBRE CC", "CATEGORIA CC", "GERENCIA" FROM <<cc_rows>>
QUALIFY row_number() OVER (PARTITION BY "CC" ORDER BY row_idx, {mark_sql('"CC"', '"NOMBRE CC"', '"CATEGORIA CC"', '"GERENCIA"', "row_idx")}) = 1""")
def q3(t):
    return employees.cost_centers(t["cc_rows"])


_SILVER_GIVEN = ["CÓDIGO CORPORATIVO", "DNI/CEX", "NOMBRES", "MOTIVO CESE", "SUBS. POR ENFERMEDAD", "PERIODO", "AÑO", "MES"]


@query("Q4_payroll_silver", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS "PERIODO", strftime(o_orderdate, '%Y') AS "AÑO",
       cast(month(o_orderdate) AS INTEGER) AS "MES", {PAYROLL_FIRST} AS "CÓDIGO CORPORATIVO",
       cast(o_orderkey AS VARCHAR) AS "DNI/CEX", 'Nombre ' || o_orderkey AS "NOMBRES",
       CASE WHEN {PAYROLL_EVEN} THEN o_orderpriority END AS "MOTIVO CESE",
       cast(o_totalprice AS VARCHAR) AS "SUBS. POR ENFERMEDAD",
       CASE WHEN {PAYROLL_EVEN} THEN cast(o_custkey AS VARCHAR) END AS "BONO ESPECIAL", """ + ", ".join(
    f'cast(NULL AS VARCHAR) AS "{n}"' for n in tables.PAYROLL.names if n not in _SILVER_GIVEN
) + """ FROM orders
WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_totalprice BETWEEN 8000 AND 490000""")
def q4(t):
    return payroll.payroll_silver(t["payroll_bronze"])


_PAYROLL_TEXT = ["PERIODO", "AÑO", "CÓDIGO CORPORATIVO", "APELLIDO MATERNO", "NOMBRES", "TIPO DE DOCUMENTO", "DNI/CEX",
                 "SEXO", "ÁREA", "CENTRO DE COSTOS", "DIAS GOCE HABER(D)"]


@query("Q5_payroll_gold", f"""
SELECT {", ".join(f'"{n}"' for n in _PAYROLL_TEXT)}, trim("APELLIDO PATERNO", ' \t') AS "APELLIDO PATERNO",
       cast("MES" AS BIGINT) AS "MES", {_MONTHS.replace("CASE m", 'CASE "MES"')} END AS "NOMBRE_MES",
       {stamp("F. NACIMIENTO")} AS "F. NACIMIENTO", {stamp("FECHA DE INGRESO")} AS "FECHA DE INGRESO",
       {stamp("FECHA CESE")} AS "FECHA CESE", cast("DIAS SUBSIDIO ENFERMEDAD" AS BIGINT) AS "DIAS SUBSIDIO ENFERMEDAD",
       cast("# HRS EXTRAS SIMP.25%" AS DOUBLE) AS "# HRS EXTRAS SIMP.25%",
       trim("# HRS EXTRAS SIMP.35%") AS "# HRS EXTRAS SIMP.35%", cast("SUBS. POR ENFERMEDAD" AS DOUBLE) AS "SUBS. POR ENFERMEDAD"
FROM <<payroll_silver>>""")
def q5(t):
    return payroll.payroll_gold(t["payroll_silver"])


@query("Q6_mining_payroll_gold", f"""
SELECT "PERIODO", "AÑO", "DNI/CEX", "SEXO", trim("PUESTO") AS "PUESTO", cast("MES" AS BIGINT) AS "MES",
       {_MONTHS.replace("CASE m", 'CASE "MES"')} END AS "NOMBRE_MES", {stamp("F. NACIMIENTO")} AS "F. NACIMIENTO",
       {stamp("FECHA DE INGRESO")} AS "FECHA DE INGRESO", {number("DIAS TRABAJADOS", "BIGINT")} AS "DIAS TRABAJADOS",
       {number("TOTAL INGRESOS", "DOUBLE")} AS "TOTAL INGRESOS", {number("TOTAL DESCUENTOS", "DOUBLE")} AS "TOTAL DESCUENTOS",
       {number("NETO", "DOUBLE")} AS "NETO"
FROM <<mining_silver>>""")
def q6(t):
    return payroll.mining_payroll_gold(t["mining_silver"])


@query("Q7_leave_silver", """
SELECT strftime(l_shipdate, '%Y-%m') AS "PERIODO", cast(l_orderkey AS VARCHAR) AS "DNI/CEX", 'Paterno' AS "APELLIDO PATERNO",
       'Materno' AS "APELLIDO MATERNO", 'Nombre ' || l_orderkey AS "NOMBRES", 'MOTIVO ' || l_linenumber AS "MOTIVO",
       CASE l_returnflag WHEN 'A' THEN 'CON_GOCE' ELSE 'SIN_GOCE' END AS "TIPO_LICENCIA"
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 2 AND l_quantity < 50 AND l_discount > 0.01""")
def q7(t):
    return leave.leave_silver(t["leave_bronze"])


@query("Q8_payroll_with_leave", f"""
SELECT n.*, cg.MOTIVO_CON_GOCE, sg.MOTIVO_SIN_GOCE FROM <<payroll_silver>> n
LEFT JOIN ({PAID_SQL}) cg ON n."DNI/CEX" = cg."DNI/CEX" AND n."PERIODO" = cg."PERIODO"
LEFT JOIN ({UNPAID_SQL}) sg ON n."DNI/CEX" = sg."DNI/CEX" AND n."PERIODO" = sg."PERIODO" """)
def q8(t):
    return payroll.payroll_with_leave(t["payroll_silver"], t["leave"])


_PERIOD = """"AÑO" || '-' || lpad("MES", 2, '0')"""


@query("Q9_income_employees_gold", f"""
SELECT {_PERIOD} AS "PERIODO", cast("AÑO" AS BIGINT) AS "AÑO", cast("MES" AS BIGINT) AS "MES",
       {_MONTHS.replace("CASE m", 'CASE cast("MES" AS INTEGER)')} ELSE '' END AS "NOMBRE_MES",
       "DNI", "N° DOCUM.", {stamp("FECHA NACIMIENTO", False)} AS "FECHA NACIMIENTO", "SEXO", "DEPARTAMENTO", "PROVINCIA",
       "DISTRITO", "CARGO", "ÁREA", "LUGAR DE TRABAJO", {stamp("FECHA INICIO", False)} AS "FECHA INICIO", "WC/BC",
       "Tiempo de contrato", coalesce(nullif("SERVICIO", ''), 'Personal_Interno') AS "SERVICIO",
       coalesce(nullif("REGIMEN", ''), 'Personal_Interno') AS "REGIMEN"
FROM <<income_raw>>""")
def q9(t):
    return income.income_employees_gold(income.clean_income(t["income_raw"]))


@query("Q9_income_clean", f"""
SELECT "DNI", {_PERIOD} AS "PERIODO",
       CASE WHEN "PROYECTO" IS NULL OR trim("PROYECTO") = '' OR "PROYECTO" = '0' THEN 'Staff' ELSE "PROYECTO" END AS "PROYECTO",
       CASE WHEN "CODIGO SAP" LIKE '%#N/D%' OR "CODIGO SAP" LIKE '%#N/A%' OR "CODIGO SAP" ILIKE '%error%' THEN NULL
            ELSE "CODIGO SAP" END AS "CODIGO SAP" FROM <<income_raw>>""")
def q9b(t):
    return income.clean_income(t["income_raw"]).select("DNI", "PERIODO", "PROYECTO", c("CODIGO SAP"))


@query("Q10_income_interns_gold", f"""
SELECT {_PERIOD} AS "PERIODO", cast("AÑO" AS BIGINT) AS "AÑO", cast("MES" AS BIGINT) AS "MES",
       {_MONTHS.replace("CASE m", 'CASE cast("MES" AS INTEGER)')} ELSE '' END AS "NOMBRE_MES",
       "Numero Documento", "Sexo", "Cargo", "Área", "Jefe Directo", "Lugar de Trabajo",
       coalesce("Universidad de Procedencia", 'POR DEFINIR') AS "Universidad de Procedencia", "Modalidad"
FROM <<income_interns_raw>>""")
def q10(t):
    return income.income_interns_gold(income.clean_income(t["income_interns_raw"]))


@query("Q11_intern_control_silver", """
WITH v AS (SELECT *, 'BD Practicantes ' || strftime(o_orderdate, '%d.%m.%Y') || '.xlsx' AS source_file FROM orders WHERE o_totalprice > 50000),
g AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY source_file ORDER BY o_orderkey) AS nxt FROM v),
cut AS (SELECT source_file, min(o_orderkey) AS cut FROM g WHERE nxt - o_orderkey > 1000 GROUP BY source_file)
SELECT cast(o_orderkey AS VARCHAR) AS "N°", o_custkey || '.5' AS "DNI", 'Practicante ' || o_orderkey AS "APELLIDOS Y NOMBRES",
       'PRACTICANTE PROFESIONAL' AS "CONDICION", cast(o_orderdate AS DATE) AS "FECHA ING",
       CASE WHEN o_orderpriority NOT IN ('3-MEDIUM', '4-NOT SPECIFIED')
            THEN cast(o_orderdate AS DATE) + cast(floor(o_totalprice / 600) AS INTEGER) END AS "F. RENOVACION",
       'Sede' AS "SEDE", 'U' AS "UNIVERSIDAD", 'Jefe' AS "JEFE INMEDIATO", 'G' AS "GERENCIA",
       strftime(o_orderdate, '%Y-%m-%d') AS "FECHA_DOCUMENTO"
FROM v LEFT JOIN cut ON v.source_file = cut.source_file WHERE cut.cut IS NULL OR o_orderkey <= cut.cut""")
def q11(t):
    return interns.intern_control_silver(t["interns_bronze"])


# Terms and labels as small tables; months and years in whole quarters of a day (1461 to a year).
INTERN_GOLD_SQL = f"""
WITH span AS (SELECT *, row_number() OVER () AS n, ("F. RENOVACION" - "FECHA ING")::INTEGER AS days FROM <<interns>>),
term(flag, label, least, most) AS (VALUES {", ".join(f"('{r.column}', {_TERM_LABELS.get(r.column, 'NULL')}, {r.low_days}, {r.high_days or 99999999})" for r in rules.TERM_RULES)}),
reached AS (SELECT n, list(flag) AS flags, min(label) AS label FROM span JOIN term
            ON days BETWEEN least AND most AND "CONDICION" = '{rules.PROFESSIONAL_INTERN}' GROUP BY n),
whole AS (SELECT *, days * 4 // 1461 AS y, days * 4 % 1461 * 25 // 3044 AS m FROM span LEFT JOIN reached USING (n))
SELECT "DNI", "CONDICION", "FECHA ING" AS "Fecha_Ingreso", "F. RENOVACION" AS "Fecha_Renovacion", "FECHA_DOCUMENTO", "SEDE", "UNIVERSIDAD",
       "JEFE INMEDIATO", "GERENCIA", days AS dias_servicio, y AS anios_servicio, m AS meses_servicio,
       {", ".join(f"if(days IS NULL, NULL, if(list_contains(flags, '{r.column}'), 'SI', 'NO')) AS {r.column}" for r in rules.TERM_RULES)},
       if(days IS NULL, NULL, coalesce(label, concat_ws(' y ', nullif(y, 0) || if(y = 1, ' año', ' años'),
                                                        if(m = 0 AND y > 0, NULL, m || ' meses')))) AS tiempo_servicio
FROM whole"""


@query("Q12_intern_control_gold", INTERN_GOLD_SQL)
def q12(t):
    return interns.intern_control_gold(t["interns"])


@query("Q13_exit_exams_silver", """
WITH cut AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, min(o_orderkey) AS cut FROM orders WHERE o_totalprice < 2000 GROUP BY 1)
SELECT 'Persona ' || o_orderkey AS "NOMBRE", cast(o_orderkey AS VARCHAR) AS "DNI", cast(o_orderdate AS DATE) AS "FECHA DE CESE",
       CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'RENUNCIA' END AS "CAUSA DE SALIDA",
       CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE o_orderpriority END AS "CARGO",
       CASE WHEN o_totalprice = floor(o_totalprice) THEN cast(cast(o_totalprice AS BIGINT) AS VARCHAR)
            ELSE cast(o_totalprice AS VARCHAR) END AS "NOMBRE DE CC",
       CASE WHEN month(o_orderdate) IN (3, 7, 11) THEN 'obs ' || o_custkey ELSE '' END AS "OBSERVACION"
FROM orders LEFT JOIN cut ON strftime(o_orderdate, '%Y-%m') = m WHERE cut IS NULL OR o_orderkey < cut""")
def q13(t):
    return exams.exit_exams_silver(t["exams_bronze"])


@query("Q14_exit_exams_gold", f"""
WITH r AS (SELECT *, {stamp("FECHA DE CESE", False)} AS d FROM <<exams_silver>>)
SELECT "NOMBRE", "DNI", d AS "FECHA DE CESE", "CAUSA DE SALIDA", "CARGO", "NOMBRE DE CC", cast(year(d) AS INTEGER) AS "AÑO",
       cast(month(d) AS INTEGER) AS "MES", {_MONTHS.replace("CASE m", "CASE month(d)")} END AS "NOMBRE_MES"
FROM r WHERE "CARGO" <> 'STUDENT INTERNAL'""")
def q14(t):
    return exams.exit_exams_gold(t["exams_silver"])


_OUT = ["NOMBRE", "DNI", "FECHA DE CESE", "CAUSA DE SALIDA", "CARGO", "AÑO", "MES", "NOMBRE_MES"]


@query("Q15_exit_exams_enriched", f"""
WITH center AS ({UNIFIED_SQL})
SELECT {", ".join(f'"{n}"' for n in _OUT)}, "NOMBRE DE CC" AS codigo_cc_original, "CC" AS codigo_cc,
       nombre_cc AS nombre_cc_completo, categoria_cc, gerencia,
       if("NOMBRE DE CC" = '', 'SIN_CODIGO', if("CC" IS NOT NULL, 'OK', 'CODIGO_NO_ENCONTRADO')) AS status_match
FROM <<exams>> LEFT JOIN center ON "CC" = "NOMBRE DE CC" """)
def q15(t):
    return exams.exit_exams_enriched(t["exams"], t["cc_actual"], t["cc_old"])


# --- from the sheet on --------------------------------------------------------------


_INCOME_CUT = """r AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS f, (o_orderpriority = '5-LOW') AS intern FROM orders),
cut AS (SELECT f, intern, min(o_orderkey) AS cut FROM r WHERE o_totalprice < 2000 GROUP BY f, intern),
kept AS (SELECT r.* FROM r LEFT JOIN cut ON r.f = cut.f AND r.intern = cut.intern WHERE cut IS NULL OR o_orderkey < cut)"""
_CODE = "CASE WHEN o_orderstatus NOT IN ('P', 'F') THEN cast(o_custkey AS VARCHAR) END"
_GIVEN = {
    "AÑO": "strftime(o_orderdate, '%Y')", "MES": "cast(month(o_orderdate) AS VARCHAR)", "DNI": "cast(o_orderkey AS VARCHAR)",
    "N° DOCUM.": "cast(o_custkey AS VARCHAR)", "PROYECTO": "if(o_orderpriority IN ('1-URGENT', '2-HIGH'), 'Staff', 'P')", "CODIGO SAP": _CODE,
    "SEXO": "if(o_orderstatus = 'F', 'F', 'M')", "FECHA INICIO": "strftime(o_orderdate, '%Y-%m-%d 00:00:00')", "TURNO": "'T'",
    "Numero Documento": "cast(o_orderkey AS VARCHAR)", "Universidad de Procedencia": "if(o_orderstatus <> 'O', 'U', NULL)",
    "Sexo": "if(o_orderstatus = 'F', 'F', 'M')",
}


def _income_sql(names, intern: bool) -> str:
    given = [n for n in _GIVEN if n not in ("Numero Documento", "Universidad de Procedencia", "Sexo")] if not intern else [
        "AÑO", "MES", "Numero Documento", "CODIGO SAP", "Universidad de Procedencia", "Sexo"]
    picked = ", ".join(f'{_GIVEN[n] if n in given else "cast(NULL AS VARCHAR)"} AS "{n}"' for n in names)
    return f"""WITH {_INCOME_CUT}
SELECT strftime(o_orderdate, '%Y-%m') AS "PERIODO", {picked} FROM kept WHERE {"" if intern else "NOT "}intern"""


@query("Q9_income_employees_silver", _income_sql([*tables.INCOME_EMPLOYEE_HEADERS, *income.EMPLOYEE_EXTRA, "TURNO"], False))
def q9_sheet(t):
    return income.income_employees_silver(t["income_bronze"])


@query("Q10_income_interns_silver", _income_sql([*tables.INCOME_INTERN_HEADERS, *income.INTERN_EXTRA], True))
def q10_sheet(t):
    return income.income_interns_silver(t["income_bronze"])


_MINING_GIVEN = {
    "PERIODO": "strftime(o_orderdate, '%Y-%m')", "AÑO": "strftime(o_orderdate, '%Y')", "MES": "cast(month(o_orderdate) AS BIGINT)",
    "CÓDIGO CORPORATIVO": "'C' || o_custkey", "DNI/CEX": "cast(o_orderkey AS VARCHAR)", "PUESTO": "o_orderpriority",
    "FECHA DE INGRESO": "cast(o_orderdate AS DATE)", "DIAS TRABAJADOS": "if(o_orderstatus = 'P', NULL, o_custkey % 40)",
    "TOTAL INGRESOS": "o_totalprice", "TOTAL DESCUENTOS": "o_totalprice / 4",
    "NETO": "o_totalprice - o_totalprice / 4 + if(o_orderstatus = 'F', 1, 0)",
}
_MINING_KINDS = {"string": "VARCHAR", "integer": "BIGINT", "float": "DOUBLE", "date": "DATE"}


@query("Q6_mining_payroll_from_sheets", "SELECT " + ", ".join(
    f'{_MINING_GIVEN.get(n.name, f"cast(NULL AS {_MINING_KINDS[n.type]})")} AS "{n.name}"' for n in tables.MINING_PAYROLL.columns
) + f""", {_MONTHS.replace("CASE m", "CASE month(o_orderdate)")} END AS "NOMBRE_MES"
FROM orders WHERE o_totalprice BETWEEN 5000 AND 490000""")
def q6_sheet(t):
    silver = payroll.payroll_silver(t["mining_bronze"], tables.MINING_PAYROLL)
    return payroll.mining_payroll_gold(silver)
