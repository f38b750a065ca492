"""Landing, preflight, layers and whole pipelines over workbooks on disk."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from staffloom.names import c
from staffloom.operators import quality
from staffloom.plans import pipelines
from staffloom.plans.employees import employee_flags
from staffloom.plans.payroll import skipped_files
from staffloom.session import RECOMMENDED, configure
from staffloom.sources import landing, layers, workbooks
from staffloom.sources.preflight import preflight
from staffloom.specs import contracts, tables
from tests.workbook import write_workbook

RUN = datetime(2026, 1, 2, 3, 4, 5)
EMPLOYEE_HEADER = list(contracts.EMPLOYEES.sheets[0].required) + ["CC", "NOMBRE CC", "CATEGORIA CC"]


def employee(document, contract, cc="100", end=datetime(2025, 12, 31)):
    return [
        document, "S1", "Ana Pérez", "G", "F", "Lima", "WHITE", contract, end, "nan", "R",
        datetime(2020, 1, 1), "1/2/1960", cc, f"Centro {document}", "SGA",
    ]


def land(spark, folder):
    landed = workbooks.land_workbooks(spark, str(folder))
    landed.write.mode("overwrite").parquet(f"{folder}/landed")
    stored = spark.read.parquet(f"{folder}/landed")
    return workbooks.bronze_rows(stored), workbooks.landing_errors(stored)


def files_of(spark, folder, errors):
    names = workbooks.discover_sources(spark, str(folder)).select("source_file")
    return names.join(errors.drop("source_path"), "source_file", "left")


def test_cells_as_text(spark, tmp_path):
    values = ["text ", 45000, 12.5, 7.0, True, datetime(2023, 3, 15, 10, 20, 30), "#N/A", "inline:in", None, "end"]
    write_workbook(f"{tmp_path}/a b+c ñ.xlsx", {"Hoja 1": {2: values, 5: [None, "x"]}, "Vacía": {}})
    write_workbook(f"{tmp_path}/~$lock.xlsx", {"S": {1: ["x"]}})
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    (tmp_path / "notes.txt").write_text("ignored")
    rows, errors = land(spark, tmp_path)
    got = {(r.source_file, r.sheet, r.row_idx): r.cells for r in rows.collect()}
    assert got == {
        ("a b+c ñ.xlsx", "Hoja 1", 0): [],
        ("a b+c ñ.xlsx", "Hoja 1", 2): [
            "text ", "45000", "12.5", "7.0", "True", "2023-03-15 10:20:30", "#N/A", "in", None, "end"
        ],
        ("a b+c ñ.xlsx", "Hoja 1", 1): [],  # the first row of each blank run is kept
        ("a b+c ñ.xlsx", "Hoja 1", 3): [],
        ("a b+c ñ.xlsx", "Hoja 1", 5): [None, "x"],
        ("a b+c ñ.xlsx", "Vacía", 0): [],
    }
    assert [r.source_file for r in errors.collect()] == ["broken.xlsx"]
    found = workbooks.discover_sources(spark, str(tmp_path), exclude=("~$", "broken"))
    assert [r.source_file for r in found.collect()] == ["a b+c ñ.xlsx"]


def test_payroll_sources_leave_out_earlier_output(spark, tmp_path):
    for name in ("Planilla 2024-05.xlsx", "~$Planilla 2024-05.xlsx", "Planilla Metso Consolidado 1.xlsx", "b.xls", "c.csv"):
        (tmp_path / name).write_bytes(b"x")
    found = workbooks.discover_sources(spark, str(tmp_path), contracts.PAYROLL_EXCLUDED)
    assert {r.source_file for r in found.collect()} == {"Planilla 2024-05.xlsx", "b.xls"}


def report(df):
    return {(r.source, r.rule, r.column) for r in df.collect()}


def test_preflight_of_employee_files(spark, tmp_path):
    good = {10: EMPLOYEE_HEADER, 11: employee("123", "PLAZO INDETERMINADO")}
    write_workbook(f"{tmp_path}/BD. 21.12.2025..xlsx", {"METSO": good})
    write_workbook(f"{tmp_path}/BD. 31.02.2025..xlsx", {"METSO": good})
    write_workbook(f"{tmp_path}/Otro.xlsx", {"Otra": {1: ["x"]}})
    write_workbook(f"{tmp_path}/BD. 22.12.2025..xlsx", {"METSO": {10: [None, " gerencia ", "SEXO"]}})
    (tmp_path / "BD. 23.12.2025..xlsx").write_bytes(b"bad")
    rows, errors = land(spark, tmp_path)
    got = preflight(files_of(spark, tmp_path, errors), rows, contracts.EMPLOYEES)
    found = report(got)
    assert not [f for f in found if f[0] == "BD. 21.12.2025..xlsx"]
    assert ("BD. 31.02.2025..xlsx", "document_date", None) in found
    assert {("Otro.xlsx", "file_name", None), ("Otro.xlsx", "missing_sheet", "METSO")} <= found
    assert ("BD. 22.12.2025..xlsx", "header_position", "METSO row 10 column 1") in found
    lacking = {f[2] for f in found if f[:2] == ("BD. 22.12.2025..xlsx", "missing_header")}
    assert lacking == set(contracts.EMPLOYEES.sheets[0].required) - {"GERENCIA", "SEXO"}
    assert {f for f in found if f[0] == "BD. 23.12.2025..xlsx"} == {("BD. 23.12.2025..xlsx", "unreadable", None)}
    with pytest.raises(quality.QualityError, match="31.02.2025"):
        quality.require(got)


def test_preflight_of_file_type_and_extra_sheets(spark):
    from dataclasses import replace

    files = spark.createDataFrame([("a.csv", None), ("b.xlsx", None)], "source_file string, error string")
    rows = spark.createDataFrame(
        [("b.xlsx", "DATA", 3, ["NOMBRE", "DNI", "FECHA  DE CESE"]), ("b.xlsx", "X", 1, ["x"])],
        "source_file string, sheet string, row_idx long, cells array<string>",
    )
    strict = replace(contracts.EXIT_EXAMS, enforce_allowed_sheets=True)
    assert report(preflight(files, rows, strict)) == {
        ("a.csv", "extension", None), ("b.xlsx", "unexpected_sheet", "X"),
    }
    assert report(preflight(files, rows, contracts.EXIT_EXAMS)) == {("a.csv", "extension", None)}


def test_pipelines_stop_on_preflight_errors(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    sheet = {10: EMPLOYEE_HEADER, 11: employee("1", "PLAZO INDETERMINADO")}
    write_workbook(f"{src}/BD. 31.02.2025..xlsx", {"METSO": sheet})
    rows, errors = land(spark, src)
    files = files_of(spark, src, errors)
    with pytest.raises(quality.QualityError, match="document_date"):
        pipelines.run_employees(rows, out, RUN, F.lit("2026-01-01").cast("date"), files)
    with pytest.raises(quality.QualityError, match="missing_sheet"):
        pipelines.run_interns(rows, out, RUN, files)


def test_employee_pipeline(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    people = [
        employee("1", "CONTRATO POR OBRA O SERVICIO ESPECIFICO"), employee("2", "TERMINO DE CONVENIO PRACTICAS", "200"),
        employee("3", None), employee(" ", "PLAZO INDETERMINADO"), employee("5", "PLAZO INDETERMINADO"),
    ]
    write_workbook(f"{src}/BD. 21.12.2025..xlsx", {"METSO": {10: EMPLOYEE_HEADER, **dict(enumerate(people, 11))}})
    rows, _ = land(spark, src)
    pipelines.run_employees(rows, out, RUN, F.lit("2026-01-01").cast("date"))
    silver = {r["NUMERO DE DOC"]: r for r in layers.read_current(spark, f"{out}/silver/employees").collect()}
    assert set(silver) == {"1", "2", "3"}
    assert silver["1"]["FECHA DE NAC."] == "1960-02-01 00:00:00" and silver["1"]["SERVICIO"] is None
    assert silver["1"]["FECHA_DOCUMENTO"] == "2025-12-21"
    centers = layers.read_current(spark, f"{out}/gold/cost_centers").collect()
    assert [(r["CC"], r["NOMBRE CC"]) for r in sorted(centers)] == [("100", "Centro 1"), ("200", "Centro 2")]
    flags = layers.read_current(spark, f"{out}/gold/employee_flags").collect()
    assert [(r["NUMERO DE DOC"], r.tiempo_servicio_texto, r.alerta_contrato_obra) for r in flags] == [
        ("1", "5 años, 11 meses", True)
    ]
    assert flags[0]["cumple_65_esteaño"] is False and flags[0]["FECH_INGR."] == date(2020, 1, 1)
    interns = layers.read_current(spark, f"{out}/gold/interns").collect()
    assert [r["NUMERO DE DOC"] for r in interns] == ["2"]
    history = layers.read_history(spark, f"{out}/gold/employee_flags")
    assert [str(r.run_ts) for r in history.select("run_ts").distinct().collect()] == ["20260102T030405"]


def test_flags_keep_other_columns_and_need_a_key(spark):
    schema = "`NUMERO DE DOC` string, `FECHA DE NAC.` date, `FECH_INGR.` date, `Fecha de Termino` date, `Modalidad de Contrato` string, FECHA_DOCUMENTO string"
    day = date(1960, 1, 1)
    df = spark.createDataFrame([("1", day, day, None, "x", "2025-12-21"), (None, day, day, None, "x", "d")], schema)
    got = employee_flags(df, F.lit("2025-06-01").cast("date")).collect()
    assert got[0]["FECHA_DOCUMENTO"] == "2025-12-21" and got[0]["cumple_65_esteaño"] is True
    assert list(got[1])[6:] == [None] * 7


def payroll_sheet(*people):
    header = ["CÓDIGO CORPORATIVO", "DNI/CEX", "NOMBRES", "DIAS GOCE HABER(D)", "SUBS. POR ACCIDENTE", "F. NACIMIENTO", "APELLIDO PATERNO", "TIPO DE DOCUMENTO"]
    return {6: header, **dict(enumerate(people, 7))}


def test_payroll_pipeline(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    birth = datetime(1980, 5, 6)
    write_workbook(f"{src}/Planilla 2024-05 Empleados.xlsx", {
        "Planilla": payroll_sheet(["C1", 111, " Ana ", 3, 1.5, birth], ["C2", None, "x", 1, 1.0, None],
                                  ["TOTAL GENERAL DE PLANILLA", 5, "x", 1, 1.0, None], [None, 9, "x", 1, 1.0, None]),
    })
    write_workbook(f"{src}/Planilla 2024-06 Empleados.xlsx", {
        "Planilla": {6: ["CÓDIGO CORPORATIVO", "NOMBRES", "DNI/CEX", "SEXO", "DIAS GOCE HABER(D)", "APELLIDO PATERNO", "TIPO DE DOCUMENTO", "BONO"],
                     7: ["C1", "Ana", 111, "X", "31.0", "P", "DNI", 7.5]},
    })
    write_workbook(f"{src}/Planilla vieja.xlsx", {"Planilla": payroll_sheet(["C9", 999, "y", 1, 1.0, None])})
    leave_rows = [["2024-05", 111.0, "P", "M", "Ana", "vacaciones"], ["2024-05", 111, "P", "M", "Ana", "duelo"],
                  [None, 111, "P", "M", "Ana", "x"], ["2024-05", 111, "P", "M", "Ana", "  "]]
    head = ["PERIODO", "DNI/CEX", "APELLIDO PATERNO", "APELLIDO MATERNO", "NOMBRES"]
    (tmp_path / "leave").mkdir()
    write_workbook(f"{tmp_path}/leave/CONTROL_DE_LICENCIAS.xlsx", {
        "LICENCIA CON GOCE": {2: [*head, "MOTIVO DE LIC.CON GOCE"], **dict(enumerate(leave_rows, 3))},
        "LICENCIA SIN GOCE": {2: [*head, "MOTIVO DE LIC.S.G.H"], 3: ["2024-06", "111", "P", "M", "Ana", "permiso"]},
    })
    rows, _ = land(spark, src)
    findings = pipelines.run_payroll(rows, land(spark, tmp_path / "leave")[0], out, RUN)
    assert {r.BONO for r in layers.read_current(spark, f"{out}/silver/payroll").collect()} == {None, "7.5"}
    got = {r.PERIODO: r for r in layers.read_current(spark, f"{out}/gold/payroll_with_leave").collect()}
    assert set(got) == {"2024-05", "2024-06"}
    may, june = got["2024-05"], got["2024-06"]
    assert (may.MOTIVO_CON_GOCE, may.MOTIVO_SIN_GOCE) == ("duelo | vacaciones", None)
    assert (june.MOTIVO_CON_GOCE, june.MOTIVO_SIN_GOCE) == (None, "permiso")
    assert (may["NOMBRES"], may["MES"], may["NOMBRE_MES"], may["F. NACIMIENTO"]) == ("Ana", 5, "May", date(1980, 5, 6))
    assert may["DIAS GOCE HABER(D)"] == "3" and may["SUBS. POR ACCIDENTE"] == 1.5  # one bad value keeps the text
    found = report(findings)
    assert ("payroll", "not_allowed", "SEXO") in found
    assert ("payroll", "wrong_type", "DIAS GOCE HABER(D)") in found
    assert ("payroll", "null", "APELLIDO PATERNO") in found
    skipped = findings.filter("rule = 'no_period'").collect()
    assert [(r.sample, r.severity) for r in skipped] == [("Planilla vieja.xlsx", "warning")]
    assert [r.source_file for r in skipped_files(rows.filter(c("sheet") == "Planilla")).collect()] == ["Planilla vieja.xlsx"]
    lost = {r["column"]: r.n_bad for r in findings.filter("rule = 'lost'").collect()}
    assert lost == {"first cell": 2, "DNI/CEX": 1}
    assert findings.filter("rule = 'not_allowed'").first().sample == "X"
    with pytest.raises(quality.QualityError, match="file_name"):
        pipelines.run_mining_payroll(rows, out, RUN)
    pipelines.run_mining_payroll(rows.filter(c("source_file") != "Planilla vieja.xlsx"), out, RUN)
    mining = layers.read_current(spark, f"{out}/gold/mining_payroll")
    assert mining.columns[:4] == ["PERIODO", "MES", "NOMBRE_MES", "AÑO"] and mining.count() == 2


def test_leave_validation_stops(spark):
    from staffloom.plans.leave import validated_leave

    row = ("2024-05", "1", None, "M", "N", "x", "OTRO")
    df = spark.createDataFrame([row], ", ".join(f"`{n}` string" for n in tables.LEAVE.names))
    with pytest.raises(quality.QualityError) as error:
        validated_leave(df)
    assert "null APELLIDO PATERNO (1)" in str(error.value) and "not_allowed TIPO_LICENCIA (1)" in str(error.value)


def test_income_pipeline(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    names = [*tables.INCOME_EMPLOYEE_HEADERS, "FECHA NACIMIENTO", "SERVICIO", "REGIMEN"]
    person = {n: "v" for n in names} | {
        "AÑO": 2024, "MES": 3, "DNI": "1", "PROYECTO": 0, "CODIGO SAP": "#N/D", "FECHA INICIO": datetime(2024, 3, 1),
        "FECHA NACIMIENTO": datetime(1990, 1, 2), "SERVICIO": None, "REGIMEN": "R",
    }
    line = [None, *[person[n] for n in names]]
    interns = [*tables.INCOME_INTERN_HEADERS, "Jefe Directo", "Lugar de Trabajo", "Modalidad"]
    intern = {n: "v" for n in interns} | {"AÑO": 2024, "MES": 13, "Universidad de Procedencia": None}
    write_workbook(f"{src}/Ingresos.xlsx", {
        "EMPLEADOS": {2: [None, *names], 3: line, 4: [None, None, " "], 5: line},
        "PRACTICANTES": {2: interns, 3: [intern[n] for n in interns]},
    })
    rows, errors = land(spark, src)
    assert preflight(files_of(spark, src, errors), rows, contracts.INCOME).isEmpty()
    pipelines.run_income(rows, out, RUN)
    silver = layers.read_current(spark, f"{out}/silver/income_employees").collect()
    assert [(r.PERIODO, r.PROYECTO, r["CODIGO SAP"]) for r in silver] == [("2024-03", "Staff", None)]
    gold = layers.read_current(spark, f"{out}/gold/income_employees").first()
    assert (gold["AÑO"], gold["NOMBRE_MES"], gold["SERVICIO"], gold["REGIMEN"]) == (2024, "March", "Personal_Interno", "R")
    assert gold["FECHA NACIMIENTO"] == date(1990, 1, 2)
    intern_gold = layers.read_current(spark, f"{out}/gold/income_interns").first()
    assert (intern_gold["NOMBRE_MES"], intern_gold["Universidad de Procedencia"]) == ("", "POR DEFINIR")


def test_intern_pipeline(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    people = [[1, 12345678, "Luis", "PRACTICANTE PROFESIONAL", datetime(2025, 4, 1), 46111, "S", "U", "J", "G"],
              [2, None, "sin documento", "x", None, None, "S", "U", "J", "G"],
              [3, 7.5, "Eva", "PRE", "01/02/2025", "x", "S", "U", "J", "G"]]
    header = ["N°", "DNI", "APELLIDOS\nY  NOMBRES", "CONDICION", "FECHA ING", "F. RENOVACION", "SEDE", "UNIVERSIDAD",
              "JEFE INMEDIATO", "GERENCIA"]
    write_workbook(f"{src}/BD Practicantes 30.03.2026.xlsx", {"Practicantes": {4: header, **dict(enumerate(people, 5))}})
    rows, _ = land(spark, src)
    assert pipelines.run_interns(rows, out, RUN).isEmpty()
    with pytest.raises(quality.QualityError, match="missing_sheet Practicantes"):
        pipelines.run_interns(rows.withColumn("sheet", F.lit("Otra")), out, RUN)
    got = {r.DNI: r for r in layers.read_current(spark, f"{out}/gold/intern_control").collect()}
    assert set(got) == {"12345678", "7.5"}
    luis = got["12345678"]
    assert (luis.dias_servicio, luis.por_cumplir_1, luis.tiempo_servicio) == (363, "SI", "1 año (En límite)")
    assert luis.FECHA_DOCUMENTO == "2026-03-30" and got["7.5"].Fecha_Ingreso == date(2025, 2, 1)


def test_exam_pipeline(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    people = [["Ana ", 1.0, datetime(2026, 1, 15), "#N/A", "OPERARIO", 100], ["Bea", 2, "2026-12-01", "x", "OPERARIO", None],
              ["Con", 3, "x", "x", "STUDENT INTERNAL", "Z"], [None], ["Dan", 4, None, "x", "OPERARIO", "Z"]]
    header = ["NOMBRE", "DNI", "FECHA DE CESE", "CAUSA DE SALIDA", "CARGO", "NOMBRE DE CC"]
    write_workbook(f"{src}/Examenes.xlsx", {"DATA": {3: header, **dict(enumerate(people, 4))}})
    rows, _ = land(spark, src)
    cc = "CC string, `NOMBRE CC` string, `CATEGORIA CC` string, GERENCIA string"
    current, old = spark.createDataFrame([("100", "Centro", "SGA", "G")], cc), spark.createDataFrame([], cc)
    pipelines.run_exit_exams(rows, current, old, out, RUN)
    got = layers.read_current(spark, f"{out}/gold/exit_exams_enriched").orderBy("NOMBRE").collect()
    assert [(r.NOMBRE, r.DNI, r.MES, r.NOMBRE_MES, r["CAUSA DE SALIDA"], r.nombre_cc_completo, r.status_match) for r in got] == [
        ("Ana", "1", 1, "January", "", "Centro", "OK"), ("Bea", "2", 12, "December", "x", None, "SIN_CODIGO"),
    ]


def test_layers(spark, tmp_path):
    df = spark.range(3)
    assert layers.write_if_nonempty(df, f"{tmp_path}/t", RUN) is True
    assert layers.write_if_nonempty(df.filter("id > 9"), f"{tmp_path}/t", datetime(2026, 1, 3)) is False
    assert layers.read_current(spark, f"{tmp_path}/t").count() == 3
    assert layers.write_if_nonempty(df.filter("id > 9"), f"{tmp_path}/e", RUN) is False
    with pytest.raises(FileNotFoundError):
        layers.read_current(spark, f"{tmp_path}/e")
    layers.write_current_and_history(df, f"{tmp_path}/h", RUN)
    layers.write_current_and_history(df.filter("id = 0"), f"{tmp_path}/h", datetime(2026, 1, 3))
    assert layers.read_current(spark, f"{tmp_path}/h").count() == 1
    assert layers.read_history(spark, f"{tmp_path}/h").groupBy("run_ts").count().count() == 2
    layers.write_current_and_history(df.withColumn("more", F.lit(1)), f"{tmp_path}/h", RUN)  # a run again
    assert {(r.run_ts, r.id, r.more) for r in layers.read_history(spark, f"{tmp_path}/h").collect()} == {
        ("20260103T000000", 0, None), *(("20260102T030405", i, 1) for i in range(3)),
    }


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    base = f"{tmp_path}/t"
    layers.write_current(spark.range(3), base)
    before = layers.read_current(spark, base)
    fails = spark.range(100, numPartitions=8).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        layers.write_current(fails, base)
    assert layers.read_current(spark, base).count() == before.count() == 3
    # a table can be written from itself, and a reader of the old version goes on
    layers.write_current(before.selectExpr("id + 1 AS id"), base)
    assert [sorted(r.id for r in df.collect()) for df in (before, layers.read_current(spark, base))] == [[0, 1, 2], [1, 2, 3]]
    assert layers.vacuum(spark, base, keep=1) >= 1
    assert layers.read_current(spark, base).count() == 3


def test_watch_counts_while_it_writes(spark, tmp_path):
    from staffloom.operators.watch import Watch
    from staffloom.specs import Col, TableSpec

    spec = TableSpec("t", (Col("k", nullable=False), Col("s", allowed=("M", "F")), Col("n", "integer", min_value=0)))
    df = spark.createDataFrame([("a", "M", 1), (None, "X", -1), ("b", "A", None), ("c", None, -2)], "k string, s string, n long")
    watch = Watch()
    watched = watch.losses(watch.table(df, spec), "t rows", {"k": c("k").isNotNull(), "n": c("n") >= 0})
    layers.write_current(watched.filter("k IS NOT NULL AND n >= 0"), f"{tmp_path}/t")
    got = {(r.source, r.rule, r["column"]): (r.n_bad, r.sample) for r in watch.report(spark).collect()}
    assert got == {
        ("t", "null", "k"): (1, None), ("t", "not_allowed", "s"): (2, "A, X"), ("t", "below_min", "n"): (2, None),
        ("t rows", "lost", "k"): (1, None), ("t rows", "lost", "n"): (2, None),
    }
    assert watch.rows() == {"t": 4, "t rows": 4}
    assert layers.read_current(spark, f"{tmp_path}/t").count() == 1


def test_landing_reads_only_what_is_new(spark, tmp_path):
    src, base = tmp_path / "in [1]{a}", str(tmp_path / "bronze")
    (src / "b").mkdir(parents=True)
    write_workbook(f"{src}/x.xlsx", {"S": {1: ["A", "B"], 2: ["1", "2"]}})
    write_workbook(f"{src}/b/x.xlsx", {"S": {1: ["B", "A"], 2: ["3", "4"]}})
    write_workbook(f"{src}/~$x.xlsx", {"S": {1: ["lock"]}})
    (src / "bad.xlsx").write_bytes(b"no")
    assert landing.land_new(spark, str(src).replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}"), base, RUN) == 3
    where = str(tmp_path).replace("[", "\\[") + "/in*"
    assert landing.land_new(spark, where, base, RUN) == 0  # nothing is new

    def values():
        rows = landing.bronze(spark, base)
        return sorted((r.source_file, *r.cells) for r in rows.where("row_idx = 2").collect())

    assert values() == [("x.xlsx", "1", "2"), ("x.xlsx", "3", "4")]
    assert {r.source_file: r.error is None for r in landing.landed_files(spark, base).collect()} == {"x.xlsx": True, "bad.xlsx": False}
    write_workbook(f"{src}/b/x.xlsx", {"S": {1: ["B", "A"], 2: ["3", "changed"]}})
    write_workbook(f"{src}/y.xlsx", {"S": {1: ["A"], 2: ["5"]}})
    assert landing.land_new(spark, where, base, datetime(2026, 1, 3)) == 2
    assert values() == [("x.xlsx", "1", "2"), ("x.xlsx", "3", "changed"), ("y.xlsx", "5")]
    assert landing.landings(spark, base).count() == 5


def test_rows_of_a_failed_landing_are_never_read(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "bronze")
    src.mkdir()
    write_workbook(f"{src}/x.xlsx", {"S": {1: ["A"], 2: ["1"]}})
    workbooks.land_workbooks(spark, str(src)).write.parquet(f"{base}/rows/landing=20250101T000000-dead")  # no manifest
    assert landing.landed_files(spark, base).isEmpty() and landing.bronze(spark, base).isEmpty()
    assert landing.land_new(spark, str(src), base, RUN) == 1 and landing.bronze(spark, base).count() == 3


def test_classified_files(spark):
    from staffloom.sources.preflight import classified, files_of, sound_rows

    schema = "source_path string, source_file string, sheet string, row_idx long, cells array<string>, error string"
    rows = spark.createDataFrame([
        ("/a/e.xlsx", "e.xlsx", "DATA", 3, ["NOMBRE", "DNI", "FECHA DE CESE"], None), ("/a/e.xlsx", "e.xlsx", "DATA", 4, ["x"], None),
        ("/b/e.xlsx", "e.xlsx", "DATA", 4, ["headless"], None), ("/c.xlsx", "c.xlsx", None, None, None, "broken"),
    ], schema)
    files, readable = files_of(rows), rows.where("error IS NULL").drop("error")
    got = {r.source_path: [(p.rule, p.column) for p in r.problems] for r in classified(files, readable, contracts.EXIT_EXAMS).collect()}
    assert got["/a/e.xlsx"] == [] and got["/c.xlsx"] == [("unreadable", None)]
    assert got["/b/e.xlsx"] == [("header_position", "DATA row 3 column 1"), *(("missing_header", n) for n in ("NOMBRE", "DNI", "FECHA DE CESE"))]
    assert {r.source_path for r in sound_rows(files, readable, contracts.EXIT_EXAMS).collect()} == {"/a/e.xlsx"}
    plan = classified(files, readable, contracts.EXIT_EXAMS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3


def test_session(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in RECOMMENDED}
    try:
        assert configure(spark).conf.get("spark.sql.caseSensitive") == "true"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
