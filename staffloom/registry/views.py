"""HR-shaped views over the test tables.

Silver and gold shapes are plain SELECTs in the dialect that Spark and DuckDB
share, so that the checks can inline the same text.  Bronze shapes (rows of
cells) exist for Spark only; their checks go straight to the base tables.
Every view reads whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

AS_OF = "2001-12-31"

_ODATE = "cast(o_orderdate AS date)"
_SDATE = "cast(l_shipdate AS date)"
_BIRTH = (
    "make_date(cast(1927 + o_custkey % 50 AS int), cast(1 + o_orderkey % 12 AS int), "
    "cast(1 + o_orderkey % 28 AS int))"
)
_END = f"CASE WHEN o_orderstatus <> 'O' THEN {_ODATE} + cast(floor(o_totalprice / 200) AS int) END"
_ENTRY = f"CASE WHEN o_totalprice <= 495000 THEN {_ODATE} END"
_CONTRACT = """CASE o_orderpriority
    WHEN '1-URGENT' THEN 'CONTRATO POR OBRA O SERVICIO ESPECIFICO'
    WHEN '2-HIGH' THEN 'CONTRATO POR INCREMENTO DE ACTIVIDAD'
    WHEN '3-MEDIUM' THEN 'PLAZO INDETERMINADO'
    WHEN '5-LOW' THEN 'TERMINO DE CONVENIO PRACTICAS' END"""


def _stamp(date_sql: str) -> str:
    """Text of a date as the sheets have it: with time, with fraction, or (not accepted) alone."""
    return (
        f"CASE o_orderstatus WHEN 'F' THEN cast({date_sql} AS string) || ' 00:00:00' "
        f"WHEN 'O' THEN cast({date_sql} AS string) || ' 10:20:30.250000' ELSE cast({date_sql} AS string) END"
    )


def _plain_stamp(date_sql: str) -> str:
    return (
        f"CASE WHEN o_orderstatus = 'P' THEN cast({date_sql} AS string) "
        f"ELSE cast({date_sql} AS string) || ' 00:00:00' END"
    )


_MONEY = "cast(o_totalprice AS string)"

VIEW_SQL: dict[str, str] = {
    "employees": f"""
SELECT CASE WHEN o_orderstatus <> 'P' OR o_totalprice > 20000 THEN cast(o_orderkey AS string) END AS "NUMERO DE DOC",
       'SAP' || cast(o_custkey AS string) AS "CODIGO SAP2",
       'Empleado ' || cast(o_orderkey AS string) AS "NOMBRE COMPLETOS",
       'G' || cast(o_custkey % 7 AS string) AS "GERENCIA",
       CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'M' END AS "SEXO",
       {_CONTRACT} AS "Modalidad de Contrato",
       {_END} AS "Fecha de Termino",
       {_ENTRY} AS "FECH_INGR.",
       CASE WHEN o_totalprice >= 5000 THEN {_BIRTH} END AS "FECHA DE NAC.",
       '{AS_OF}' AS "FECHA_DOCUMENTO"
FROM orders""",
    "employees_silver": f"""
SELECT 'x' AS "SIN USO",
       cast(o_orderkey AS string) AS "NUMERO DE DOC",
       {_plain_stamp(_ODATE)} AS "FECH_INGR.",
       {_plain_stamp(_BIRTH)} AS "FECHA DE NAC.",
       'SAP' || cast(o_custkey AS string) AS "CODIGO SAP2",
       'Empleado ' || cast(o_orderkey AS string) AS "NOMBRE COMPLETOS",
       'G' || cast(o_custkey % 7 AS string) AS "GERENCIA",
       CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'M' END AS "SEXO",
       'Sede' AS "SEDE3",
       'WHITE' AS "WHITE COLLAR / BLUE COLLAR",
       {_CONTRACT} AS "Modalidad de Contrato",
       {_plain_stamp(_END)} AS "Fecha de Termino",
       'S' AS "SERVICIO",
       'R' AS "REGIMEN DE TRABAJO",
       '{AS_OF}' AS "FECHA_DOCUMENTO"
FROM orders""",
    "cc_rows": """
SELECT l_orderkey * 8 + l_linenumber AS row_idx,
       'CC' || cast(l_suppkey AS string) AS "CC",
       'Nombre ' || cast(l_partkey AS string) AS "NOMBRE CC",
       CASE l_returnflag WHEN 'A' THEN 'COGS' WHEN 'R' THEN 'SGA' END AS "CATEGORIA CC",
       'G' || l_linestatus AS "GERENCIA"
FROM lineitem""",
    "payroll_silver": f"""
SELECT substring(cast({_ODATE} AS string), 1, 7) AS "PERIODO",
       substring(cast({_ODATE} AS string), 1, 4) AS "AÑO",
       cast(month({_ODATE}) AS int) AS "MES",
       'C' || cast(o_custkey AS string) AS "CÓDIGO CORPORATIVO",
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN ' ' || o_orderpriority || '\t ' END AS "APELLIDO PATERNO",
       'Materno' AS "APELLIDO MATERNO",
       'Nombre ' || cast(o_orderkey AS string) AS "NOMBRES",
       'DNI' AS "TIPO DE DOCUMENTO",
       cast(o_orderkey AS string) AS "DNI/CEX",
       CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE 'X' || cast(o_custkey AS string) END AS "SEXO",
       {_stamp(_BIRTH)} AS "F. NACIMIENTO",
       'Área' AS "ÁREA",
       'CC' || cast(o_custkey AS string) AS "CENTRO DE COSTOS",
       {_stamp(_ODATE)} AS "FECHA DE INGRESO",
       {_stamp(_END)} AS "FECHA CESE",
       cast(o_custkey % 30 AS string) AS "DIAS SUBSIDIO ENFERMEDAD",
       CASE o_orderstatus WHEN 'P' THEN '31.0' ELSE cast(o_custkey % 9 AS string) END AS "DIAS GOCE HABER(D)",
       {_MONEY} AS "# HRS EXTRAS SIMP.25%",
       CASE o_orderstatus WHEN 'P' THEN ' 1.5 ' ELSE {_MONEY} END AS "# HRS EXTRAS SIMP.35%",
       cast(o_totalprice - 9000 AS string) AS "SUBS. POR ENFERMEDAD"
FROM orders""",
    "mining_silver": f"""
SELECT substring(cast({_ODATE} AS string), 1, 7) AS "PERIODO",
       substring(cast({_ODATE} AS string), 1, 4) AS "AÑO",
       cast(month({_ODATE}) AS int) AS "MES",
       cast(o_orderkey AS string) AS "DNI/CEX",
       CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS "SEXO",
       {_stamp(_BIRTH)} AS "F. NACIMIENTO",
       ' ' || o_orderpriority || ' ' AS "PUESTO",
       {_stamp(_ODATE)} AS "FECHA DE INGRESO",
       CASE o_orderstatus WHEN 'P' THEN '31.0' ELSE cast(o_custkey % 40 AS string) END AS "DIAS TRABAJADOS",
       CASE o_orderstatus WHEN 'P' THEN 'x' ELSE {_MONEY} END AS "TOTAL INGRESOS",
       cast(o_totalprice / 4 AS string) AS "TOTAL DESCUENTOS",
       {_MONEY} AS "NETO"
FROM orders""",
    "leave": f"""
SELECT substring(cast({_SDATE} AS string), 1, 7) AS "PERIODO",
       cast(l_orderkey AS string) AS "DNI/CEX",
       'Paterno' AS "APELLIDO PATERNO",
       'Materno' AS "APELLIDO MATERNO",
       'Nombre ' || cast(l_orderkey AS string) AS "NOMBRES",
       CASE WHEN l_quantity >= 3 THEN 'MOTIVO ' || cast(l_linenumber AS string) END AS "MOTIVO",
       CASE l_returnflag WHEN 'A' THEN 'CON_GOCE' WHEN 'R' THEN 'SIN_GOCE'
            ELSE 'OTRO ' || cast(l_suppkey AS string) END AS "TIPO_LICENCIA"
FROM lineitem""",
    "income_raw": f"""
SELECT cast(year({_ODATE}) AS string) AS "AÑO",
       CASE WHEN o_totalprice > 3000 THEN cast(month({_ODATE}) AS string) END AS "MES",
       cast(o_orderkey AS string) AS "DNI",
       cast(o_custkey AS string) AS "N° DOCUM.",
       {_plain_stamp(_BIRTH)} AS "FECHA NACIMIENTO",
       CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'M' END AS "SEXO",
       'Lima' AS "DEPARTAMENTO", 'Lima' AS "PROVINCIA", 'Lima' AS "DISTRITO",
       o_orderpriority AS "CARGO", 'Área' AS "ÁREA", 'Planta' AS "LUGAR DE TRABAJO",
       {_plain_stamp(_ODATE)} AS "FECHA INICIO",
       'WC' AS "WC/BC", '1' AS "Tiempo de contrato",
       CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'Servicio' END AS "SERVICIO",
       CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'O' THEN 'Regimen' END AS "REGIMEN",
       CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '  ' WHEN '3-MEDIUM' THEN ' 0 '
            WHEN '5-LOW' THEN 'Proyecto' END AS "PROYECTO",
       CASE WHEN o_orderpriority = '1-URGENT' THEN '#N/D' WHEN o_orderpriority = '2-HIGH' THEN 'x#N/A'
            WHEN o_orderpriority = '3-MEDIUM' THEN '#n/d' WHEN o_orderstatus = 'P' THEN 'ERRor 7'
            WHEN o_orderstatus = 'F' THEN cast(o_custkey AS string) END AS "CODIGO SAP"
FROM orders""",
    "income_interns_raw": f"""
SELECT cast(year({_ODATE}) AS string) AS "AÑO",
       cast(month({_ODATE}) AS string) AS "MES",
       cast(o_orderkey AS string) AS "Numero Documento",
       CASE o_orderstatus WHEN 'F' THEN 'F' ELSE 'M' END AS "Sexo",
       o_orderpriority AS "Cargo", 'Área' AS "Área", 'Jefe' AS "Jefe Directo", 'Planta' AS "Lugar de Trabajo",
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'U ' || o_orderpriority END AS "Universidad de Procedencia",
       'M' AS "Modalidad",
       CASE o_orderstatus WHEN 'P' THEN 'Error' ELSE 'S' || cast(o_custkey AS string) END AS "CODIGO SAP"
FROM orders""",
    "interns": f"""
SELECT cast(o_orderkey AS string) AS "N°",
       cast(o_custkey AS string) AS "DNI",
       'Practicante ' || cast(o_orderkey AS string) AS "APELLIDOS Y NOMBRES",
       CASE o_orderstatus WHEN 'P' THEN 'PRACTICANTE PRE PROFESIONAL' ELSE 'PRACTICANTE PROFESIONAL' END AS "CONDICION",
       {_ODATE} AS "FECHA ING",
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
            THEN {_ODATE} + cast(floor(o_totalprice / 600) AS int) END AS "F. RENOVACION",
       'Sede' AS "SEDE", 'U' AS "UNIVERSIDAD", 'Jefe' AS "JEFE INMEDIATO", 'G' AS "GERENCIA",
       '2026-03-30' AS "FECHA_DOCUMENTO"
FROM orders""",
    "exams_silver": f"""
SELECT 'Persona ' || cast(l_orderkey AS string) AS "NOMBRE",
       cast(l_orderkey AS string) AS "DNI",
       CASE WHEN l_quantity > 2 THEN cast({_SDATE} AS string) || ' 00:00:00'
            WHEN l_quantity > 1 THEN cast({_SDATE} AS string) ELSE '2001-02-31 00:00:00' END AS "FECHA DE CESE",
       CASE l_returnflag WHEN 'A' THEN 'RENUNCIA' WHEN 'R' THEN 'CESE' ELSE '' END AS "CAUSA DE SALIDA",
       CASE WHEN l_linenumber = 1 THEN 'STUDENT INTERNAL' WHEN l_linenumber < 7 THEN 'OPERARIO' END AS "CARGO",
       CASE WHEN l_returnflag = 'N' THEN '' ELSE 'CC' || cast(l_partkey + l_suppkey AS string) END AS "NOMBRE DE CC",
       'otro' AS "SIN USO"
FROM lineitem""",
    "exams": f"""
SELECT 'Persona ' || cast(l_orderkey AS string) AS "NOMBRE",
       cast(l_orderkey AS string) AS "DNI",
       {_SDATE} AS "FECHA DE CESE",
       CASE l_returnflag WHEN 'A' THEN 'RENUNCIA' WHEN 'R' THEN 'CESE' ELSE '' END AS "CAUSA DE SALIDA",
       'OPERARIO' AS "CARGO",
       CASE WHEN l_returnflag = 'N' THEN '' WHEN l_quantity <= 48
            THEN 'CC' || cast(l_partkey + l_suppkey AS string) END AS "NOMBRE DE CC",
       cast(year({_SDATE}) AS int) AS "AÑO",
       cast(month({_SDATE}) AS int) AS "MES",
       'x' AS "NOMBRE_MES"
FROM lineitem""",
    "cc_actual": """
SELECT 'CC' || cast(s_suppkey * 7 AS string) AS "CC", s_name AS "NOMBRE CC",
       CASE WHEN s_acctbal > 0 THEN 'COGS' END AS "CATEGORIA CC", 'GA' || cast(s_nationkey AS string) AS "GERENCIA"
FROM supplier""",
    "cc_old": """
SELECT 'CC' || cast(p_partkey - p_partkey % 2 AS string) AS "CC", p_name AS "NOMBRE CC",
       p_type AS "CATEGORIA CC", p_brand AS "GERENCIA"
FROM part""",
}


def _spark_sql(sql: str) -> str:
    """The same text for Spark: its identifier quotes, and its marks for table arguments."""
    sql = sql.replace('"', "`")
    return re.sub(r"\bFROM (\w+)", r"FROM {\1}", sql)


def read_base(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- bronze: rows of cells -----------------------------------------------------


def _odate() -> Column:
    return F.col("o_orderdate").cast("date")


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _slashed(date: Column) -> Column:
    """Day-first text without leading zeros."""
    return F.concat_ws("/", F.dayofmonth(date), F.month(date), F.year(date))


def _with_header(data: DataFrame, header_row: int, header: Column) -> DataFrame:
    """Data rows plus one header row per sheet; ``header`` may use the file and sheet name."""
    heads = data.select("source_file", "sheet").distinct()
    heads = heads.select("*", header.alias("cells"), F.lit(header_row).cast("long").alias("row_idx"))
    names = ["source_file", "sheet", "row_idx", "cells"]
    return heads.select(*names).unionByName(data.select(*names))


def _words(*names: str | None) -> Column:
    return F.array(*[F.lit(n).cast("string") for n in names])


EMPLOYEE_SHEET = (
    "NUMERO DE DOC", "CODIGO SAP2", "NOMBRE COMPLETOS", "GERENCIA", "SEXO", "SEDE3",
    "WHITE COLLAR / BLUE COLLAR", "Modalidad de Contrato", "Fecha de Termino", "SERVICIO",
    "REGIMEN DE TRABAJO", "FECH_INGR.", "FECHA DE NAC.",
)


def employees_bronze(spark: SparkSession, folder: str) -> DataFrame:
    o = read_base(spark, folder, "orders")
    name = F.concat(F.lit("BD. 01."), F.date_format(_odate(), "MM.yyyy"), F.lit("..xlsx"))
    cells = F.array(
        F.when(F.col("o_totalprice") >= 2000, _text("o_orderkey")),
        F.concat(F.lit("  SAP"), _text("o_custkey"), F.lit("\t")),
        F.concat(F.lit("Empleado "), _text("o_orderkey")),
        F.when(F.col("o_orderstatus") == "P", "nan").otherwise("G1"),
        F.lit("M"), F.lit("None"), F.lit("WHITE"),
        F.col("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "P", "31/02/2001").otherwise(_slashed(_odate())),
        F.lit("S"), F.lit("R"),
        F.concat(_text(_odate()), F.lit(" 00:00:00")),
        F.lit("NaT"),
        F.when(F.year(_odate()) % 2 == 0, F.concat(_text("o_custkey"), F.lit("@x"))),
        F.lit(None).cast("string"),
        F.lit("fuera"),
    )
    data = o.select(
        name.alias("source_file"), F.lit("METSO").alias("sheet"),
        (F.col("o_orderkey") + 11).alias("row_idx"), cells.alias("cells"),
    )
    # files of even years have a header that the spec does not know, those of 1995 spell the document's otherwise
    year = F.substring("source_file", 11, 4)
    other = _words("Numero de Doc.", *EMPLOYEE_SHEET[1:])
    known = F.when(year == "1995", other).otherwise(_words(*EMPLOYEE_SHEET))
    mail = F.when(year.cast("int") % 2 == 0, "CORREO")
    return _with_header(data, 10, F.concat(known, F.array(mail), _words(None, "NOTA")))


def payroll_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """One file per month; files of even years have one more column and another order."""
    o = read_base(spark, folder, "orders")
    period = F.date_format(_odate(), "yyyy-MM")
    name = F.when(F.col("o_orderpriority") == "5-LOW", "Planilla sin periodo.xlsx").otherwise(
        F.concat(F.lit("Planilla "), period, F.lit(" Empleados.xlsx"))
    )
    even = F.col("source_file").rlike("[02468]-[0-9]{2}")
    first = (
        F.when(F.col("o_totalprice") > 490000, "TOTAL GENERAL DE LA PLANILLA")
        .when(F.col("o_totalprice") >= 5000, F.concat(F.lit("C"), _text("o_custkey")))
    )
    document = F.when(F.col("o_totalprice") >= 8000, _text("o_orderkey"))
    names, extra = F.concat(F.lit("Nombre "), _text("o_orderkey")), F.col("o_orderpriority")
    gap, money = F.lit(None).cast("string"), _text("o_totalprice")
    data = (
        o.withColumn("source_file", name)
        .withColumn("sheet", F.when(F.col("o_orderstatus") == "P", "Resumen").otherwise("Planilla"))
        .withColumn("row_idx", F.col("o_orderkey") + 7)
        .withColumn(
            "cells",
            F.when(even, F.array(first, names, gap, extra, money, document, _text("o_custkey"))).otherwise(
                F.array(first, document, gap, names, money)
            ),
        )
    )
    header = F.when(
        even, _words("CÓDIGO CORPORATIVO", "NOMBRES", None, "MOTIVO CESE", "SUBS. POR ENFERMEDAD", " DNI/CEX ", "BONO ESPECIAL")
    ).otherwise(_words("CÓDIGO CORPORATIVO", "DNI/CEX", None, "NOMBRES", "SUBS. POR\n ENFERMEDAD"))
    return _with_header(data, 6, header)


def leave_bronze(spark: SparkSession, folder: str) -> DataFrame:
    li = read_base(spark, folder, "lineitem")
    ship = F.col("l_shipdate").cast("date")
    sheet = (
        F.when(F.col("l_returnflag") == "A", "LICENCIA CON GOCE")
        .when(F.col("l_returnflag") == "R", "LICENCIA SIN GOCE")
        .otherwise("OTROS")
    )
    document = F.when(
        F.col("l_quantity") > 2,
        F.concat(_text("l_orderkey"), F.when(F.col("l_linestatus") == "F", ".0").otherwise("")),
    ).otherwise("  ")
    cells = F.array(
        F.when(F.col("l_quantity") < 50, F.date_format(ship, "yyyy-MM")),
        document,
        F.lit(None).cast("string"),
        F.lit("Paterno"), F.lit("Materno"), F.concat(F.lit("Nombre "), _text("l_orderkey")),
        F.when(F.col("l_discount") > 0.01, F.concat(F.lit("MOTIVO "), _text("l_linenumber"))).otherwise(" "),
    )
    data = li.select(
        F.concat(F.lit("CONTROL_DE_LICENCIAS "), F.year(ship).cast("string"), F.lit(".xlsx")).alias("source_file"),
        sheet.alias("sheet"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 3).alias("row_idx"),
        cells.alias("cells"),
    )
    reason = (
        F.when(F.col("sheet") == "LICENCIA CON GOCE", "MOTIVO DE LIC.CON GOCE").otherwise("MOTIVO DE LIC.S.G.H")
    )
    header = F.concat(
        _words("PERIODO", "DNI/CEX", None, "APELLIDO PATERNO", "APELLIDO MATERNO", "NOMBRES"), F.array(reason)
    )
    return _with_header(data, 2, header)


def interns_bronze(spark: SparkSession, folder: str) -> DataFrame:
    o = read_base(spark, folder, "orders")
    renewal = F.date_add(_odate(), F.floor(F.col("o_totalprice") / 600).cast("int"))
    cells = F.array(
        F.concat(_text("o_orderkey"), F.lit(".0")),
        F.when(F.col("o_totalprice") > 50000, F.concat(_text("o_custkey"), F.lit(".50"))).otherwise(" "),
        F.concat(F.lit(" Practicante "), _text("o_orderkey")),
        F.lit("PRACTICANTE PROFESIONAL"),
        F.when(F.col("o_orderstatus") == "F", _text(F.datediff(_odate(), F.lit("1899-12-30").cast("date"))))
        .when(F.col("o_orderstatus") == "O", _slashed(_odate()))
        .otherwise(F.date_format(_odate(), "dd.MM.yyyy")),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(renewal, "yyyy/MM/dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(_text(renewal), F.lit(" 00:00:00")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("31/02/2001"))
        .when(F.col("o_orderpriority") == "5-LOW", _text(renewal)),
        F.lit("Sede"), F.lit("U"), F.lit("Jefe"), F.lit("G"), F.lit("no pedido"),
    )
    data = o.select(
        F.concat(F.lit("BD Practicantes "), F.date_format(_odate(), "dd.MM.yyyy"), F.lit(".xlsx")).alias("source_file"),
        F.lit("Practicantes").alias("sheet"),
        (F.col("o_orderkey") + 5).alias("row_idx"), cells.alias("cells"),
    )
    header = _words(
        "N°", "DNI", "APELLIDOS\n Y NOMBRES ", "CONDICION", "FECHA  ING", "F. RENOVACION", "SEDE",
        "UNIVERSIDAD", "JEFE INMEDIATO", "GERENCIA", "OTRA",
    )
    return _with_header(data, 4, header)


def exams_bronze(spark: SparkSession, folder: str) -> DataFrame:
    o = read_base(spark, folder, "orders")
    cells = F.array(
        F.when(F.col("o_totalprice") >= 2000, F.concat(F.lit("Persona "), _text("o_orderkey"))).otherwise(" "),
        F.concat(_text("o_orderkey"), F.when(F.col("o_orderstatus") == "F", ".0").otherwise("")),
        F.when(F.col("o_orderstatus") == "P", _text(_odate())).otherwise(F.concat(_text(_odate()), F.lit(" 00:00:00"))),
        F.when(F.col("o_orderpriority") == "1-URGENT", "#N/A").otherwise("  RENUNCIA "),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority")),
        _text("o_totalprice"),
        F.concat(F.lit(" obs "), _text("o_custkey")),
    )
    data = o.select(
        F.concat(F.lit("Examenes "), F.date_format(_odate(), "yyyy-MM"), F.lit(".xlsx")).alias("source_file"),
        F.lit("DATA").alias("sheet"),
        (F.col("o_orderkey") + 4).alias("row_idx"), cells.alias("cells"),
    )
    known = _words("NOMBRE", "DNI", "FECHA DE CESE", "CAUSA DE SALIDA", "CARGO", "NOMBRE DE CC")
    # only the files of one month in four have this header
    more = F.when(F.substring("source_file", 15, 2).isin("03", "07", "11"), "OBSERVACION")
    return _with_header(data, 3, F.concat(known, F.array(more)))


INCOME_SHEET = ("AÑO", "MES", "DNI", "N° DOCUM.", "PROYECTO", "CODIGO SAP", "SEXO", "FECHA INICIO", "TURNO")
INCOME_INTERN_SHEET = ("AÑO", "MES", "Numero Documento", "CODIGO SAP", "Universidad de Procedencia", "Sexo")


def income_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """Two sheets in one file per month; a row that is blank under all headers (but not beside them) ends a sheet."""
    o = read_base(spark, folder, "orders")
    intern = F.col("o_orderpriority") == "5-LOW"
    blank = F.col("o_totalprice") < 2000
    year, month, document, none = _text(F.year(_odate())), _text(F.month(_odate())), _text("o_orderkey"), F.lit(None).cast("string")
    code = F.when(F.col("o_orderstatus") == "P", "#N/D").when(F.col("o_orderstatus") == "F", "x error").otherwise(_text("o_custkey"))
    project = F.when(F.col("o_orderpriority") == "1-URGENT", "0").when(F.col("o_orderpriority") == "2-HIGH", " ").otherwise("P")
    sex = F.when(F.col("o_orderstatus") == "F", "F").otherwise("M")
    people = F.array(F.lit("nota"), year, month, document, _text("o_custkey"), project, code, sex, F.concat(_text(_odate()), F.lit(" 00:00:00")), F.lit("T"))
    empty = F.concat(F.array(F.lit("nota")), F.array_repeat(F.lit(" "), len(INCOME_SHEET)))
    interns = F.array(year, month, document, code, F.when(F.col("o_orderstatus") != "O", "U"), sex)
    data = o.select(
        F.concat(F.lit("Ingresos "), F.date_format(_odate(), "yyyy-MM"), F.lit(".xlsx")).alias("source_file"),
        F.when(intern, "PRACTICANTES").otherwise("EMPLEADOS").alias("sheet"),
        (F.col("o_orderkey") + 3).alias("row_idx"),
        F.when(intern, F.when(blank, F.array(none, none)).otherwise(interns)).otherwise(F.when(blank, empty).otherwise(people)).alias("cells"),
    )
    header = F.when(F.col("sheet") == "EMPLEADOS", _words(None, *INCOME_SHEET)).otherwise(_words(*INCOME_INTERN_SHEET))
    return _with_header(data, 2, header)


MINING_SHEET = (
    "CÓDIGO CORPORATIVO", "DNI/CEX", "PUESTO", "FECHA DE INGRESO", "DIAS TRABAJADOS", "TOTAL INGRESOS", "TOTAL DESCUENTOS", "NETO", "TURNO",
)


def mining_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly sheets of the mining payroll, with a header that its spec does not know."""
    o = read_base(spark, folder, "orders")
    first = F.when(F.col("o_totalprice") > 490000, "TOTAL GENERAL DE LA PLANILLA").otherwise(F.concat(F.lit("C"), _text("o_custkey")))
    cells = F.array(
        first, F.when(F.col("o_totalprice") >= 5000, _text("o_orderkey")), F.concat(F.lit(" "), F.col("o_orderpriority")),
        F.concat(_text(_odate()), F.lit(" 00:00:00")), F.when(F.col("o_orderstatus") == "P", "31.0").otherwise(_text(F.col("o_custkey") % 40)),
        _text("o_totalprice"), _text(F.col("o_totalprice") / 4), _text(F.col("o_totalprice") - F.col("o_totalprice") / 4 + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)),
        F.lit("N"),
    )
    data = o.select(
        F.concat(F.lit("Planilla "), F.date_format(_odate(), "yyyy-MM"), F.lit(" minera.xlsx")).alias("source_file"),
        F.lit("Planilla").alias("sheet"), (F.col("o_orderkey") + 7).alias("row_idx"), cells.alias("cells"),
    )
    return _with_header(data, 6, _words(*MINING_SHEET))


def chat_bronze(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as sheets: one file each, the turn as row number, words as cells."""
    t = read_base(spark, folder, "conversations")
    return t.select(
        _text("conv_id").alias("source_file"), F.lit("chat").alias("sheet"),
        (F.col("turn") + 1).alias("row_idx"), F.split("text", r"[ \n]", -1).alias("cells"),
    )


BRONZE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "employees_bronze": employees_bronze,
    "payroll_bronze": payroll_bronze,
    "leave_bronze": leave_bronze,
    "interns_bronze": interns_bronze,
    "exams_bronze": exams_bronze,
    "income_bronze": income_bronze,
    "mining_bronze": mining_bronze,
    "chat_bronze": chat_bronze,
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in BRONZE:
        return BRONZE[name](spark, folder)
    if name in BASE:
        return read_base(spark, folder, name)
    sql = VIEW_SQL[name]
    used = set(re.findall(r"\bFROM (\w+)", sql))
    return spark.sql(_spark_sql(sql), **{t: read_base(spark, folder, t) for t in used})
