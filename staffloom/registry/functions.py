"""Scalar functions (X rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffloom.functions.dates import ddmmyyyy_to_iso, month_name, month_of, parse_excel_date, year_of
from staffloom.functions.flags import age_flag, contract_alert
from staffloom.functions.periods import make_period, period_month, period_year
from staffloom.functions.service import (
    days_between,
    remaining_months,
    service_label,
    service_text,
    service_years,
    term_flag,
    whole_years,
)
from staffloom.functions.text import (
    default_if_blank,
    error_cells_to_null,
    fill_null,
    impute,
    null_tokens,
    number_to_text,
    sentinel_to_null,
    strip,
    strip_dot_zero,
)
from staffloom.names import c
from staffloom.operators.projection import map_columns, string_columns
from staffloom.registry.core import query
from staffloom.registry.sheets import WS
from staffloom.registry.views import AS_OF
from staffloom.specs import rules

def as_of() -> Column:
    return F.lit(AS_OF).cast("date")

AS_OF_SQL = f"DATE '{AS_OF}'"

# SQL of the service-time columns over the employee view.
DAYS_SQL = f"""date_diff('day', "FECH_INGR.", coalesce("Fecha de Termino", {AS_OF_SQL}))"""
YEARS_SQL = f"({DAYS_SQL} / 365.25)"
TEXT_SQL = " || ".join(
    f"coalesce(floor({value})::INTEGER::VARCHAR, '') || '{unit}'" for value, unit in ((YEARS_SQL, " años, "), (f"{YEARS_SQL} % 1 * 12", " meses"))
)


@query("X1_trim_strings", f"""
SELECT doc_id, trim(text, {WS}) AS text, trim(lang, {WS}) AS lang, trim(source, {WS}) AS source FROM documents""")
def trimmed(t):
    df = t["documents"].select("doc_id", "text", "lang", "source")
    return map_columns(df, string_columns(df), strip)


@query("X2_null_tokens", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_orderpriority END AS v FROM orders""")
def tokens(t):
    raw = F.when(F.col("o_orderstatus") == "P", "nan").when(F.col("o_orderstatus") == "F", "None").otherwise(
        F.col("o_orderpriority")
    )
    return t["orders"].select("o_orderkey", null_tokens(raw).alias("v"))


@query("X3_ddmmyyyy_to_iso", """
WITH r AS (SELECT o_orderkey, (o_custkey % 35) || '/' || (o_orderkey % 14) || '/' || year(o_orderdate) AS raw FROM orders)
SELECT o_orderkey, raw,
       coalesce(strftime(try_strptime(raw, '%d/%m/%Y'), '%Y-%m-%d 00:00:00'), raw) AS iso FROM r""")
def slashed(t):
    raw = F.concat_ws("/", F.col("o_custkey") % 35, F.col("o_orderkey") % 14, F.year("o_orderdate"))
    return t["orders"].select("o_orderkey", raw.alias("raw")).withColumn("iso", ddmmyyyy_to_iso(F.col("raw")))


@query("X4_number_to_text", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / 8 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity = floor(l_quantity) THEN cast(cast(l_quantity AS BIGINT) AS VARCHAR)
            ELSE rtrim(rtrim(printf('%.6f', l_quantity), '0'), '.') END AS quantity,
       CASE WHEN v = floor(v) THEN cast(cast(v AS BIGINT) AS VARCHAR)
            ELSE rtrim(rtrim(printf('%.6f', v), '0'), '.') END AS price
FROM r""")
def numbers(t):
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", number_to_text(F.col("l_quantity")).alias("quantity"),
        number_to_text(F.col("l_extendedprice") / 8).alias("price"),
    )


@query("X5_strip_dot_zero", r"""
SELECT o_orderkey, regexp_replace(cast(o_totalprice AS VARCHAR), '\.0$', '') AS v,
       regexp_replace(o_orderkey || '.0', '\.0$', '') AS doc FROM orders""")
def dot_zero(t):
    return t["orders"].select(
        "o_orderkey", strip_dot_zero(F.col("o_totalprice").cast("string")).alias("v"),
        strip_dot_zero(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("doc"),
    )


@query("X6_error_cells_to_null", """
SELECT "DNI", CASE WHEN "CODIGO SAP" NOT LIKE '#%' THEN "CODIGO SAP" END AS v FROM <<income_raw>>""")
def errors(t):
    return t["income_raw"].select("DNI", error_cells_to_null(c("CODIGO SAP")).alias("v"))


@query("X7_sentinel_to_null", """
SELECT "DNI", CASE WHEN contains("CODIGO SAP", '#N/D') OR contains("CODIGO SAP", '#N/A')
    OR contains(lower("CODIGO SAP"), 'error') THEN NULL ELSE "CODIGO SAP" END AS "CODIGO SAP" FROM <<income_raw>>""")
def sentinels(t):
    return t["income_raw"].select("DNI", sentinel_to_null(c("CODIGO SAP")).alias("CODIGO SAP"))


@query("X8_default_if_blank", """
SELECT "DNI", CASE WHEN "PROYECTO" IS NULL OR trim("PROYECTO") = '' OR "PROYECTO" = '0' THEN 'Staff'
    ELSE "PROYECTO" END AS "PROYECTO" FROM <<income_raw>>""")
def projects(t):
    return t["income_raw"].select("DNI", default_if_blank(c("PROYECTO")).alias("PROYECTO"))


@query("X9_impute", """
SELECT "DNI", coalesce(nullif("SERVICIO", ''), 'Personal_Interno') AS "SERVICIO",
       coalesce(nullif("REGIMEN", ''), 'Personal_Interno') AS "REGIMEN" FROM <<income_raw>>""")
def imputed(t):
    return t["income_raw"].select("DNI", impute(c("SERVICIO")).alias("SERVICIO"), impute(c("REGIMEN")).alias("REGIMEN"))


@query("X10_fill_null", """
SELECT "Numero Documento", coalesce("Universidad de Procedencia", 'POR DEFINIR') AS universidad FROM <<income_interns_raw>>""")
def filled(t):
    university = fill_null(c("Universidad de Procedencia"), rules.DEFAULT_UNIVERSITY)
    return t["income_interns_raw"].select(c("Numero Documento"), university.alias("universidad"))


@query("X11_make_period", """
SELECT "DNI", "AÑO" || '-' || CASE WHEN length("MES") < 2 THEN '0' || "MES" ELSE "MES" END AS "PERIODO",
       "AÑO" || '-' || CASE WHEN length("DNI") < 2 THEN '0' || "DNI" ELSE "DNI" END AS long_month FROM <<income_raw>>""")
def periods(t):
    return t["income_raw"].select(
        "DNI", make_period(c("AÑO"), c("MES")).alias("PERIODO"), make_period(c("AÑO"), c("DNI")).alias("long_month")
    )


@query("X12_split_period", """
SELECT "DNI/CEX", substr("PERIODO", 1, 4) AS "AÑO", try_cast(substr("PERIODO", 6, 2) AS INTEGER) AS "MES",
       CASE WHEN regexp_matches(substr("NOMBRES", 6, 2), '^[0-9]+$') THEN try_cast(substr("NOMBRES", 6, 2) AS INTEGER) END AS bad
FROM <<payroll_silver>>""")
def split_periods(t):
    return t["payroll_silver"].select(
        c("DNI/CEX"), period_year(c("PERIODO")).alias("AÑO"), period_month(c("PERIODO")).alias("MES"),
        period_month(c("NOMBRES")).alias("bad"),
    )


_MONTHS = "CASE m " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(rules.MONTH_NAMES, 1))


@query("X13_month_name", f"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 15 END AS m FROM orders)
SELECT o_orderkey, {_MONTHS} END AS or_null, {_MONTHS} ELSE '' END AS or_blank FROM r""")
def months(t):
    month = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 15)
    return t["orders"].select(
        "o_orderkey", month_name(month).alias("or_null"), month_name(month, default="").alias("or_blank")
    )


@query("X14_year_month", """
SELECT l_orderkey, l_linenumber, cast(year(l_shipdate) AS INTEGER) AS "AÑO", cast(month(l_shipdate) AS INTEGER) AS "MES"
FROM lineitem""")
def year_month(t):
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", year_of(F.col("l_shipdate")).alias("AÑO"), month_of(F.col("l_shipdate")).alias("MES")
    )


_RAW_DATE = """CASE o_orderpriority
 WHEN '1-URGENT' THEN cast(date_diff('day', DATE '1899-12-30', cast(o_orderdate AS DATE)) AS VARCHAR) ||
      CASE o_orderstatus WHEN 'P' THEN '.75' ELSE '' END
 WHEN '2-HIGH' THEN (o_custkey % 33) || '/' || (o_orderkey % 13) || '/' || year(o_orderdate)
 WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, ' %d.%m.%Y ') END
 WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END
 ELSE CASE o_orderstatus WHEN 'P' THEN 'sin fecha' WHEN 'F' THEN '2001-12/31' END END"""


@query("X15_parse_excel_date", rf"""
WITH r AS (SELECT o_orderkey, {_RAW_DATE} AS raw FROM orders)
SELECT o_orderkey, raw, cast(coalesce(
    try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(trim(raw), '%d/%m/%Y'), try_strptime(trim(raw), '%d-%m-%Y'),
    try_strptime(trim(raw), '%Y/%m/%d'), try_strptime(trim(raw), '%d.%m.%Y'),
    CASE WHEN regexp_matches(raw, '^\d+(\.\d+)?$') THEN DATE '1899-12-30' + cast(floor(try_cast(raw AS DOUBLE)) AS INTEGER) END
  ) AS DATE) AS parsed FROM r""")
def excel_dates(t):
    o = t["orders"]
    date, status, priority = F.col("o_orderdate").cast("date"), F.col("o_orderstatus"), F.col("o_orderpriority")
    is_p = status == "P"
    raw = (
        F.when(
            priority == "1-URGENT",
            F.concat(
                F.datediff(date, F.lit("1899-12-30").cast("date")).cast("string"), F.when(is_p, ".75").otherwise("")
            ),
        )
        .when(priority == "2-HIGH", F.concat_ws("/", F.col("o_custkey") % 33, F.col("o_orderkey") % 13, F.year(date)))
        .when(
            priority == "3-MEDIUM",
            F.when(is_p, F.date_format(date, "dd-MM-yyyy")).otherwise(F.date_format(date, " dd.MM.yyyy ")),
        )
        .when(
            priority == "4-NOT SPECIFIED",
            F.when(is_p, F.date_format(date, "yyyy-MM-dd")).otherwise(F.date_format(date, "yyyy/MM/dd")),
        )
        .otherwise(F.when(is_p, "sin fecha").when(status == "F", "2001-12/31"))
    )
    return o.select("o_orderkey", raw.alias("raw")).withColumn("parsed", parse_excel_date(F.col("raw")))


@query("X16_days_between", """
SELECT "NUMERO DE DOC", cast("Fecha de Termino" - "FECH_INGR." AS INTEGER) AS dias FROM <<employees>>""")
def days(t):
    return t["employees"].select(
        c("NUMERO DE DOC"), days_between(c("FECH_INGR."), c("Fecha de Termino")).alias("dias")
    )


def _years():
    return service_years(c("FECH_INGR."), c("Fecha de Termino"), as_of())


@query("X17_service_years", f'SELECT "NUMERO DE DOC", {YEARS_SQL} AS years FROM <<employees>>')
def years(t):
    return t["employees"].select(c("NUMERO DE DOC"), _years().alias("years"))


@query("X18_service_text", f'SELECT "NUMERO DE DOC", {TEXT_SQL} AS texto FROM <<employees>>')
def text(t):
    return t["employees"].select(c("NUMERO DE DOC"), service_text(_years()).alias("texto"))


@query("X19_service_years_months", """
SELECT "N°", cast(floor(("F. RENOVACION" - "FECHA ING") / 365.25) AS INTEGER) AS anios,
       cast(floor((("F. RENOVACION" - "FECHA ING") % 365.25) / 30.44) AS INTEGER) AS meses FROM <<interns>>""")
def modulo(t):
    d = days_between(c("FECHA ING"), c("F. RENOVACION"))
    return t["interns"].select(c("N°"), whole_years(d).alias("anios"), remaining_months(d).alias("meses"))


@query("X20_service_label", """
WITH r AS (SELECT p_partkey, p_partkey % 4 AS y, p_size % 12 AS m, p_type = 'ECONOMY' AS one, p_retailprice > 1000 AND p_partkey % 4 > 1 AS two FROM part),
words AS (SELECT *, [CASE WHEN one THEN '1 año (En límite)' END, CASE WHEN two THEN '2 años (Límite Máximo)' END,
    concat_ws(' y ', nullif(y, 0) || if(y = 1, ' año', ' años'), if(m > 0 OR y = 0, m || ' meses', NULL))] AS choice FROM r)
SELECT p_partkey, list_filter(choice, lambda w: w IS NOT NULL)[1] AS label FROM words""")
def label(t):
    y, m = (F.col("p_partkey") % 4).cast("int"), (F.col("p_size") % 12).cast("int")
    near_one = F.when(F.col("p_type") == "ECONOMY", "SI").when(F.col("p_type") == "SMALL", "NO")
    near_two = F.when((F.col("p_retailprice") > 1000) & (y > 1), "SI").otherwise("NO")
    return t["part"].select("p_partkey", service_label(y, m, near_one, near_two).alias("label"))


@query("X21_age_flag", f"""
SELECT "NUMERO DE DOC", """ + ", ".join(
    f"""year({AS_OF_SQL}) - year("FECHA DE NAC.") = {r.age - r.year_offset} AS "{r.column}" """ for r in rules.AGE_RULES
) + " FROM <<employees>>")
def ages(t):
    return t["employees"].select(
        c("NUMERO DE DOC"), *[age_flag(c("FECHA DE NAC."), as_of(), r).alias(r.column) for r in rules.AGE_RULES]
    )


@query("X22_contract_alert", f"""
SELECT "NUMERO DE DOC", """ + ", ".join(
    f"""(({DAYS_SQL} >= {r.alert_years * 365.25}) AND "Modalidad de Contrato" = '{r.modality}') AS "{r.column}" """
    for r in rules.CONTRACT_RULES
) + " FROM <<employees>>")
def alerts(t):
    return t["employees"].select(
        c("NUMERO DE DOC"),
        *[contract_alert(c("Modalidad de Contrato"), _years(), r).alias(r.column) for r in rules.CONTRACT_RULES],
    )


@query("X23_term_flag", f"""
WITH term(flag, least, most) AS (VALUES {", ".join(f"('{r.column}', {r.low_days}, {r.high_days or 99999999})" for r in rules.TERM_RULES)}),
span AS (SELECT "N°", "F. RENOVACION" - "FECHA ING" AS days, "CONDICION" FROM <<interns>>),
hit AS (SELECT "N°", days, flag, days BETWEEN least AND most AND "CONDICION" = '{rules.PROFESSIONAL_INTERN}' AS yes FROM span, term)
SELECT "N°", {", ".join(f"max(if(days IS NULL, NULL, if(yes, 'SI', 'NO'))) FILTER (flag = '{r.column}') AS {r.column}" for r in rules.TERM_RULES)}
FROM hit GROUP BY "N°" """)
def terms(t):
    d = days_between(c("FECHA ING"), c("F. RENOVACION"))
    return t["interns"].select(
        c("N°"), *[term_flag(c("CONDICION"), d, r.low_days, r.high_days).alias(r.column) for r in rules.TERM_RULES]
    )


@query("X24_scalar_vocabulary", f"""
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'x') || '-' || o_orderpriority AS joined,
       cast(floor(o_totalprice) AS BIGINT) AS whole, o_totalprice BETWEEN 1000 AND 90000 AS within,
       cast(year({AS_OF_SQL}) - year(o_orderdate) AS INTEGER) AS age,
       CASE WHEN o_totalprice > 90000 THEN 'alto' ELSE 'bajo' END AS nivel FROM orders""")
def vocabulary(t):
    return t["orders"].select(
        "o_orderkey",
        F.concat(
            F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("x")), F.lit("-"), "o_orderpriority"
        ).alias("joined"),
        F.floor("o_totalprice").alias("whole"),
        F.col("o_totalprice").between(1000, 90000).alias("within"),
        (F.year(as_of()) - F.year("o_orderdate")).alias("age"),
        F.when(F.col("o_totalprice") > 90000, "alto").otherwise("bajo").alias("nivel"),
    )
