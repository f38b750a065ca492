"""Landing of sheet rows: headers, crops, file names (S and V13 rows of the inventory)."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from staffloom.functions.dates import (
    document_date_from_filename,
    has_document_date_fragment,
    period_from_filename,
)
from staffloom.functions.text import WHITESPACE, header_key, normalize_header
from staffloom.names import c
from staffloom.operators.filters import drop_all_null_rows
from staffloom.operators.projection import with_constant
from staffloom.registry.core import query
from staffloom.sources.layers import read_current, read_history, read_layer, write_current, write_current_and_history, write_if_nonempty
from staffloom.sources.layouts import BLANK_RUN, FIRST_BLANK, discover, missing_headers, promote_header, select_by_header
from staffloom.sources.scratch import shared_folder
from staffloom.sources.sheets import drop_non_data_rows, header_scan, skip_blank_key
from staffloom.specs import contracts

# White space as a SQL literal, and the pattern of a run of it.
WS = "'" + WHITESPACE + "'"
SPACES = r"[\s\x0b\x{85}\p{Z}]+"

PAYROLL_FILE = """CASE WHEN o_orderpriority = '5-LOW' THEN 'Planilla sin periodo.xlsx'
 ELSE 'Planilla ' || strftime(o_orderdate, '%Y-%m') || ' Empleados.xlsx' END"""
PAYROLL_EVEN = "o_orderpriority <> '5-LOW' AND year(o_orderdate) % 2 = 0"
PAYROLL_FIRST = """CASE WHEN o_totalprice > 490000 THEN 'TOTAL GENERAL DE LA PLANILLA'
 WHEN o_totalprice >= 5000 THEN 'C' || o_custkey END"""

PAYROLL_COLUMNS = ["CÓDIGO CORPORATIVO", "DNI/CEX", "NOMBRES", "MOTIVO CESE", "SUBS. POR ENFERMEDAD", "SEXO"]


@query("S2_promote_header", f"""
SELECT {PAYROLL_FILE} AS source_file, CASE WHEN o_orderstatus = 'P' THEN 'Resumen' ELSE 'Planilla' END AS sheet,
       o_orderkey + 7 AS row_idx, {PAYROLL_FIRST} AS "CÓDIGO CORPORATIVO",
       CASE WHEN o_totalprice >= 8000 THEN cast(o_orderkey AS VARCHAR) END AS "DNI/CEX",
       'Nombre ' || o_orderkey AS "NOMBRES",
       CASE WHEN {PAYROLL_EVEN} THEN o_orderpriority END AS "MOTIVO CESE",
       cast(o_totalprice AS VARCHAR) AS "SUBS. POR ENFERMEDAD", cast(NULL AS VARCHAR) AS "SEXO"
FROM orders""")
def promote(t):
    return promote_header(t["payroll_bronze"], PAYROLL_COLUMNS, 6, stop="gap")


@query("S3_normalize_header", f"""
SELECT conv_id, turn, regexp_replace(trim(text, {WS}), '{SPACES}', ' ', 'g') AS header,
       upper(replace(regexp_replace(trim(text, {WS}), '{SPACES}', ' ', 'g'), 'ß', 'SS')) AS header_key
FROM conversations""")
def normalize(t):
    return t["conversations"].select(
        "conv_id", "turn", normalize_header(F.col("text")).alias("header"), header_key(F.col("text")).alias("header_key")
    )


@query("S4_select_by_header", """
SELECT 'BD Practicantes ' || strftime(o_orderdate, '%d.%m.%Y') || '.xlsx' AS source_file, 'Practicantes' AS sheet,
       o_orderkey + 5 AS row_idx, ' Practicante ' || o_orderkey AS "APELLIDOS Y NOMBRES", 'G' AS "GERENCIA"
FROM orders""")
def by_header(t):
    return select_by_header(t["interns_bronze"], ["APELLIDOS Y NOMBRES", "GERENCIA"], 4)


@query("S4_missing_headers", """
SELECT DISTINCT 'BD Practicantes ' || strftime(o_orderdate, '%d.%m.%Y') || '.xlsx' AS source_file,
       'Practicantes' AS sheet, 'CONDICIONES' AS header
FROM orders""")
def lacking(t):
    return missing_headers(t["interns_bronze"], ["condicion", "CONDICIONES"], 4)


@query("S5_crop_at_first_blank", """
WITH r AS (SELECT 'Examenes ' || strftime(o_orderdate, '%Y-%m') || '.xlsx' AS source_file, o_orderkey + 4 AS row_idx,
                  CASE WHEN o_totalprice >= 2000 THEN 'Persona ' || o_orderkey END AS nombre FROM orders),
cut AS (SELECT source_file, min(row_idx) AS cut FROM r WHERE nombre IS NULL GROUP BY source_file)
SELECT r.source_file, r.row_idx, nombre AS "NOMBRE" FROM r LEFT JOIN cut ON r.source_file = cut.source_file
WHERE cut.cut IS NULL OR r.row_idx < cut.cut""")
def crop_first(t):
    sheets = discover(t["exams_bronze"], 3, stop="first_blank", key="NOMBRE", cut=FIRST_BLANK)
    return sheets.table(["NOMBRE"]).select("source_file", "row_idx", "NOMBRE")


@query("S6_skip_blank_key", """
SELECT 'CONTROL_DE_LICENCIAS ' || year(l_shipdate) || '.xlsx' AS source_file,
       l_orderkey * 8 + l_linenumber + 3 AS row_idx FROM lineitem WHERE l_quantity < 50""")
def skip_blank(t):
    rows = t["leave_bronze"].filter(F.col("row_idx") > 2)
    return skip_blank_key(rows, F.get("cells", F.lit(0))).select("source_file", "row_idx")


@query("S7_crop_after_blank_run", """
WITH v AS (SELECT 'BD Practicantes ' || strftime(o_orderdate, '%d.%m.%Y') || '.xlsx' AS source_file,
                  o_orderkey + 5 AS row_idx, o_custkey || '.50' AS dni FROM orders WHERE o_totalprice > 50000),
g AS (SELECT *, lead(row_idx) OVER (PARTITION BY source_file ORDER BY row_idx) AS nxt FROM v),
cut AS (SELECT source_file, min(row_idx) AS cut FROM g WHERE nxt - row_idx > 1000 GROUP BY source_file)
SELECT v.source_file, v.row_idx, v.dni AS "DNI" FROM v LEFT JOIN cut ON v.source_file = cut.source_file
WHERE cut.cut IS NULL OR v.row_idx <= cut.cut""")
def crop_run(t):
    sheets = discover(t["interns_bronze"], 4, key="DNI", cut=BLANK_RUN)
    return sheets.table(["DNI"]).select("source_file", "row_idx", "DNI")


@query("S8_drop_non_data_rows", f"""
SELECT {PAYROLL_FILE} AS source_file, o_orderkey + 7 AS row_idx, {PAYROLL_FIRST} AS first_cell
FROM orders WHERE o_totalprice BETWEEN 5000 AND 490000""")
def non_data(t):
    rows = drop_non_data_rows(t["payroll_bronze"].filter(F.col("row_idx") > 6))
    return rows.select("source_file", "row_idx", F.get("cells", F.lit(0)).alias("first_cell"))


@query("S9_drop_all_null_rows", """
SELECT "PROYECTO", "CODIGO SAP" FROM <<income_raw>> WHERE "PROYECTO" IS NOT NULL OR "CODIGO SAP" IS NOT NULL""")
def all_null(t):
    return drop_all_null_rows(t["income_raw"].select(c("PROYECTO"), c("CODIGO SAP")))


@query("S11_period_from_filename", f"""
SELECT DISTINCT {PAYROLL_FILE} AS source_file,
       CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m') END AS "PERIODO" FROM orders""")
def period(t):
    files = t["payroll_bronze"].select("source_file").distinct()
    return files.select("source_file", period_from_filename(F.col("source_file")).alias("PERIODO"))


_DOC = "'BD. ' || lpad(cast(o_custkey % 40 AS VARCHAR), 2, '0') || '.02.' || year(o_orderdate) || '..XLSX'"


@query("S12_document_date_from_filename", f"""
SELECT o_orderkey, {_DOC} AS source_file,
       strftime(try_strptime(substr({_DOC}, 5, 10), '%d.%m.%Y'), '%Y-%m-%d') AS "FECHA_DOCUMENTO" FROM orders""")
def document_date(t):
    name = F.concat(
        F.lit("BD. "), F.lpad((F.col("o_custkey") % 40).cast("string"), 2, "0"), F.lit(".02."),
        F.year("o_orderdate").cast("string"), F.lit("..XLSX"),
    )
    return t["orders"].select("o_orderkey", name.alias("source_file")).withColumn(
        "FECHA_DOCUMENTO", document_date_from_filename(F.col("source_file"), contracts.EMPLOYEE_FILE)
    )


@query("S13_has_document_date_fragment", r"""
SELECT doc_id, regexp_matches(text, '\d{2}\.\d{2}\.\d{4}') AS has_date FROM documents""")
def fragment(t):
    return t["documents"].select("doc_id", has_document_date_fragment(F.col("text")).alias("has_date"))


@query("S14_with_constant", """
SELECT doc_id, lang, '2025-12-21' AS "FECHA_DOCUMENTO" FROM documents""")
def constant(t):
    return with_constant(t["documents"].select("doc_id", "lang"), "FECHA_DOCUMENTO", "2025-12-21")


@query("S15_read_layer", "SELECT * FROM supplier")
def layer(t):
    return read_layer(t.spark, f"{t.folder}/supplier.parquet")


def _base(t):
    return f"{shared_folder(t.spark)}/staffloom/layer-{uuid.uuid4().hex}"


@query("S16_write_current", "SELECT * FROM supplier")
def current(t):
    """A table written twice: the second version is the current one."""
    base, df = _base(t), t["supplier"]
    write_current(df.filter(F.col("s_suppkey") % 2 == 0), base)
    write_current(df, base)
    return read_current(t.spark, base)


@query("S17_write_current_and_history", """
SELECT c_custkey, c_mktsegment, '20250101T000000' AS run_ts FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, c_mktsegment, '20250201T120000' FROM customer""")
def history(t):
    """Three runs, the second of them repeated by the third."""
    base, df = _base(t), t["customer"].select("c_custkey", "c_mktsegment")
    for part, stamp in ((df.filter(F.col("c_custkey") % 3 == 0), datetime(2025, 1, 1)), (df.limit(1), datetime(2025, 2, 1, 12)), (df, datetime(2025, 2, 1, 12))):
        write_current_and_history(part, base, stamp)
    return read_history(t.spark, base)


@query("S18_write_if_nonempty", "SELECT p_partkey, p_name FROM part")
def nonempty(t):
    """A run without rows leaves the table as it was."""
    base, df = _base(t), t["part"].select("p_partkey", "p_name")
    write_if_nonempty(df, base, datetime(2025, 1, 1))
    write_if_nonempty(df.filter(F.col("p_partkey") < 0), base, datetime(2025, 2, 1))
    return read_current(t.spark, base)


@query("V13_header_scan", rf"""
WITH t AS (SELECT cast(conv_id AS VARCHAR) AS source_file, string_split_regex(text, '[ \n]') AS l
           FROM conversations WHERE turn = 0),
p AS (SELECT source_file, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM t),
n AS (SELECT source_file, pos, regexp_replace(trim(raw, {WS}), '{SPACES}', ' ', 'g') AS header FROM p),
g AS (SELECT *, header = '' AS blank, lead(header) OVER w AS n1, lead(header, 2) OVER w AS n2,
             min(CASE WHEN header <> '' THEN pos END) OVER (PARTITION BY source_file) AS started
      FROM n WINDOW w AS (PARTITION BY source_file ORDER BY pos)),
cut AS (SELECT source_file, min(pos) AS cut FROM g WHERE blank AND n1 = '' AND n2 = '' AND pos > started GROUP BY source_file)
SELECT n.source_file, cast(n.pos AS INTEGER) AS pos, n.header FROM n LEFT JOIN cut ON n.source_file = cut.source_file
WHERE n.header <> '' AND (cut.cut IS NULL OR n.pos < cut.cut)""")
def scan(t):
    return header_scan(t["chat_bronze"], 1).select("source_file", "pos", "header")
