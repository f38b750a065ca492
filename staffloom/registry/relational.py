"""Joins, aggregates, windows, sorts and unions (J, A, W, O and U rows of the inventory)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from staffloom.names import c
from staffloom.operators.aggregates import (
    count_distinct,
    count_true,
    dedup_keep_first,
    distinct_sorted,
    filtered_count,
    first_value_by_priority,
    group_count,
    select_distinct,
    string_agg_ordered,
    value_counts,
)
from staffloom.operators.joins import left_join, lookup_join, match_status
from staffloom.operators.quality import check_unique
from staffloom.operators.sets import order_by, union_all, union_diagonal
from staffloom.plans.employees import employee_flags, flag_columns
from staffloom.plans.exams import unified_cost_centers
from staffloom.plans.payroll import PERSON_PERIOD, leave_reasons
from staffloom.registry.core import query
from staffloom.registry.functions import AS_OF_SQL, DAYS_SQL, TEXT_SQL, as_of
from staffloom.sources.buckets import buckets_for, write_bucketed
from staffloom.sources.scratch import shared_folder
from staffloom.specs import rules

REASONS_SQL = """
SELECT "DNI/CEX", "PERIODO", string_agg("MOTIVO", ' | ' ORDER BY "MOTIVO") AS {name}
FROM <<leave>> WHERE "TIPO_LICENCIA" = '{kind}' GROUP BY "DNI/CEX", "PERIODO" """
PAID_SQL = REASONS_SQL.format(name="MOTIVO_CON_GOCE", kind="CON_GOCE")
UNPAID_SQL = REASONS_SQL.format(name="MOTIVO_SIN_GOCE", kind="SIN_GOCE")

def mark_sql(*columns: str) -> str:
    """The order of rows that tie: the first 15 digits of the md5 of their values, each with its length."""
    fields = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    return f"substr(md5({' || '.join(fields)}), 1, 15)"


# One row per code: all rows of the current catalogue go before those of the old one.
_CENTER = ('"NOMBRE CC"', '"CATEGORIA CC"', '"GERENCIA"')
UNIFIED_SQL = f"""
SELECT code AS "CC", won.n AS nombre_cc, won.k AS categoria_cc, won.g AS gerencia
FROM (SELECT "CC" AS code, arg_min({{'n': {_CENTER[0]}, 'k': {_CENTER[1]}, 'g': {_CENTER[2]}}}, source || {mark_sql(*_CENTER)}) AS won
      FROM (SELECT 'a' AS source, * FROM <<cc_actual>> UNION ALL BY NAME SELECT 'b' AS source, * FROM <<cc_old>>) GROUP BY code)"""

# One SELECT: a flag is null without a document; service is compared in days.
_FLAGS = {
    "tiempo_servicio_texto": TEXT_SQL,
    **{r.column: f"""year({AS_OF_SQL}) - year("FECHA DE NAC.") = {r.age - r.year_offset}""" for r in rules.AGE_RULES},
    **{
        r.column: f"""({DAYS_SQL} >= {r.alert_years * 365.25}) AND "Modalidad de Contrato" = '{r.modality}'"""
        for r in rules.CONTRACT_RULES
    },
}
FLAGS_SQL = (
    "SELECT *, "
    + ", ".join(f"""CASE WHEN "NUMERO DE DOC" IS NOT NULL THEN {value} END AS "{name}" """ for name, value in _FLAGS.items())
    + " FROM <<employees>>"
)


@query("J1_left_join_two_keys", f"""
SELECT n."DNI/CEX", n."PERIODO", n."SEXO", cg.MOTIVO_CON_GOCE, sg.MOTIVO_SIN_GOCE FROM <<payroll_silver>> n
LEFT JOIN ({PAID_SQL}) cg ON n."DNI/CEX" = cg."DNI/CEX" AND n."PERIODO" = cg."PERIODO"
LEFT JOIN ({UNPAID_SQL}) sg ON n."DNI/CEX" = sg."DNI/CEX" AND n."PERIODO" = sg."PERIODO" """)
def two_keys(t):
    payroll = t["payroll_silver"].select(c("DNI/CEX"), "PERIODO", "SEXO")
    return left_join(payroll, leave_reasons(t["leave"]), PERSON_PERIOD)


def _bucketed(t, *names: str):
    buckets = buckets_for(*(t[name] for name in names))
    path = lambda name: f"{shared_folder(t.spark)}/staffloom/{name}-{uuid.uuid4().hex}"
    return [write_bucketed(t[name], path(name), PERSON_PERIOD, buckets, name) for name in names]


@query("J1_bucketed_layers", f"""
SELECT n."DNI/CEX", n."PERIODO", n."SEXO", l.paid AS MOTIVO_CON_GOCE, l.unpaid AS MOTIVO_SIN_GOCE FROM <<payroll_silver>> n LEFT JOIN (
    SELECT "DNI/CEX", "PERIODO", string_agg("MOTIVO", ' | ' ORDER BY "MOTIVO") FILTER ("TIPO_LICENCIA" = 'CON_GOCE') AS paid,
           string_agg("MOTIVO", ' | ' ORDER BY "MOTIVO") FILTER ("TIPO_LICENCIA" = 'SIN_GOCE') AS unpaid
    FROM <<leave>> GROUP BY ALL) l USING ("DNI/CEX", "PERIODO")""")
def bucketed_join(t):
    """J1 and A1 over layers that are bucketed by person and period: nothing is shuffled."""
    payroll, leave = _bucketed(t, "payroll_silver", "leave")
    return left_join(payroll.select(c("DNI/CEX"), "PERIODO", "SEXO"), leave_reasons(leave), PERSON_PERIOD)


@query("V6_bucketed_key", """
SELECT count(*) AS n_bad FROM (SELECT 1 FROM <<leave>> GROUP BY "DNI/CEX", "PERIODO" HAVING count(*) > 1)""")
def bucketed_key(t):
    (leave,) = _bucketed(t, "leave")
    return check_unique(leave, PERSON_PERIOD, "leave").select("n_bad")


@query("J2_left_join_catalog", f"""
SELECT e."NOMBRE", e."NOMBRE DE CC", cc.nombre_cc, cc.gerencia FROM <<exams>> e
LEFT JOIN ({UNIFIED_SQL}) cc ON e."NOMBRE DE CC" = cc."CC" """)
def catalog(t):
    centers = unified_cost_centers(t["cc_actual"], t["cc_old"]).select(
        c("CC").alias("NOMBRE DE CC"), "nombre_cc", "gerencia"
    )
    return lookup_join(t["exams"].select("NOMBRE", c("NOMBRE DE CC")), centers, "NOMBRE DE CC")


@query("J3_self_join_on_key", FLAGS_SQL)
def self_join(t):
    return employee_flags(t["employees"], as_of())


@query("J4_match_status", """
SELECT e."NOMBRE", e."NOMBRE DE CC", CASE WHEN e."NOMBRE DE CC" = '' THEN 'SIN_CODIGO'
    WHEN cc."CC" IS NULL THEN 'CODIGO_NO_ENCONTRADO' ELSE 'OK' END AS status_match
FROM <<exams>> e LEFT JOIN (SELECT "CC" FROM <<cc_actual>> UNION SELECT "CC" FROM <<cc_old>>) cc ON e."NOMBRE DE CC" = cc."CC" """)
def status(t):
    codes = select_distinct(union_all(t["cc_actual"], t["cc_old"]), ["CC"]).select(c("CC").alias("NOMBRE DE CC"), "CC")
    joined = lookup_join(t["exams"].select("NOMBRE", c("NOMBRE DE CC")), codes, "NOMBRE DE CC")
    code = c("NOMBRE DE CC")
    return joined.select("NOMBRE", code, match_status(code, c("CC")).alias("status_match"))


@query("A1_string_agg_ordered", """
SELECT "DNI/CEX", "PERIODO", array_to_string(list_sort(list("MOTIVO") FILTER ("MOTIVO" IS NOT NULL)), ' | ') AS motivos
FROM <<leave>> GROUP BY ALL""")
def string_agg(t):
    return string_agg_ordered(t["leave"], PERSON_PERIOD, "MOTIVO", {"motivos": F.lit(True)})


@query("A2_filtered_string_agg", f"""
SELECT coalesce(p."DNI/CEX", u."DNI/CEX") AS "DNI/CEX", coalesce(p."PERIODO", u."PERIODO") AS "PERIODO",
       MOTIVO_CON_GOCE, MOTIVO_SIN_GOCE
FROM ({PAID_SQL}) p FULL JOIN ({UNPAID_SQL}) u ON p."DNI/CEX" = u."DNI/CEX" AND p."PERIODO" = u."PERIODO"
WHERE MOTIVO_CON_GOCE IS NOT NULL OR MOTIVO_SIN_GOCE IS NOT NULL""")
def filtered_agg(t):
    return leave_reasons(t["leave"]).filter("MOTIVO_CON_GOCE IS NOT NULL OR MOTIVO_SIN_GOCE IS NOT NULL")


@query("A2_filtered_count", """
SELECT "PERIODO", count(*) FILTER (WHERE "TIPO_LICENCIA" = 'CON_GOCE') AS con_goce,
       count(*) FILTER (WHERE "TIPO_LICENCIA" = 'SIN_GOCE') AS sin_goce FROM <<leave>> GROUP BY "PERIODO" """)
def filtered(t):
    kind = F.col("TIPO_LICENCIA")
    return filtered_count(t["leave"], ["PERIODO"], {"con_goce": kind == "CON_GOCE", "sin_goce": kind == "SIN_GOCE"})


@query("A3_dedup_keep_first", f"""
SELECT row_idx, "CC", "NOMBRE CC", "CATEGORIA CC", "GERENCIA" FROM <<cc_rows>>
QUALIFY row_number() OVER (PARTITION BY "CC" ORDER BY row_idx, {mark_sql("row_idx", '"CC"', '"NOMBRE CC"', '"CATEGORIA CC"', '"GERENCIA"')}) = 1""")
def dedup(t):
    return dedup_keep_first(t["cc_rows"], "CC", ["row_idx"])


@query("A4_group_count", """
SELECT "Modalidad de Contrato", count(*) AS cantidad FROM <<employees>> GROUP BY 1""")
def groups(t):
    return group_count(t["employees"], ["Modalidad de Contrato"])


@query("A5_value_counts", """
SELECT "Universidad de Procedencia", count(*) AS count FROM <<income_interns_raw>> GROUP BY 1""")
def values(t):
    return value_counts(t["income_interns_raw"], "Universidad de Procedencia")


@query("A6_distinct_sorted", 'SELECT DISTINCT "PERIODO" FROM <<payroll_silver>> ORDER BY 1')
def distinct(t):
    return distinct_sorted(t["payroll_silver"], "PERIODO")


@query("A7_count_distinct", """
SELECT count(DISTINCT "NOMBRE DE CC") + max(CASE WHEN "NOMBRE DE CC" IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM <<exams>>""")
def distinct_count(t):
    return count_distinct(t["exams"], "NOMBRE DE CC")


@query("A8_count_true", "WITH f AS (" + FLAGS_SQL + ")" + " UNION ALL ".join(
    f"""
SELECT '{name}' AS flag, count(*) FILTER (WHERE "{name}") AS cantidad,
       round(count(*) FILTER (WHERE "{name}") / count(*) * 100, 2) AS porcentaje FROM f"""
    for name in flag_columns()
))
def flags_true(t):
    flagged = employee_flags(t["employees"], as_of())
    return count_true(flagged, {name: c(name) for name in flag_columns()})


@query("A9_select_distinct", 'SELECT DISTINCT "CC", "CATEGORIA CC" FROM <<cc_rows>>')
def distinct_rows(t):
    return select_distinct(t["cc_rows"], ["CC", "CATEGORIA CC"])


@query("W1_first_value_by_priority", f"""
SELECT "CC", "NOMBRE CC" AS nombre, "CATEGORIA CC" AS categoria FROM <<cc_rows>>
QUALIFY row_number() OVER (PARTITION BY "CC" ORDER BY row_idx % 8 DESC, {mark_sql('"NOMBRE CC"', '"CATEGORIA CC"')}) = 1""")
def by_priority(t):
    rows = t["cc_rows"].withColumn("fuente", F.col("row_idx") % 8)
    return first_value_by_priority(rows, "CC", {"NOMBRE CC": "nombre", "CATEGORIA CC": "categoria"}, "fuente")


@query("O1_order_by", """
SELECT "NOMBRE", "DNI", "NOMBRE DE CC" FROM <<exams>> ORDER BY "NOMBRE DE CC" """)
def ordered(t):
    df = t["exams"].select("NOMBRE", "DNI", c("NOMBRE DE CC"))
    return order_by(df, [c("NOMBRE DE CC").asc_nulls_last()])


@query("U1_union_all", """
SELECT "CC", "NOMBRE CC", 2 AS fuente FROM <<cc_actual>> UNION ALL SELECT "CC", "NOMBRE CC", 1 AS fuente FROM <<cc_old>>""")
def union(t):
    pick = lambda name, rank: t[name].select("CC", c("NOMBRE CC"), F.lit(rank).alias("fuente"))
    return union_all(pick("cc_actual", 2), pick("cc_old", 1))


@query("U2_union_diagonal", """
SELECT "DNI", "AÑO", "MES", "PROYECTO", NULL AS "Modalidad" FROM <<income_raw>>
UNION ALL SELECT "Numero Documento" AS "DNI", "AÑO", NULL AS "MES", NULL AS "PROYECTO", "Modalidad" FROM <<income_interns_raw>>""")
def diagonal(t):
    return union_diagonal(
        t["income_raw"].select("DNI", "AÑO", "MES", "PROYECTO"),
        t["income_interns_raw"].select(c("Numero Documento").alias("DNI"), "AÑO", "Modalidad"),
    )
