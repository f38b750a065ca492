"""Header rules and crops, against plain Python on small random sheets."""

import random

import pytest
from pyspark.sql import functions as F

from staffloom.operators.projection import MissingColumns
from staffloom.plans.employees import employees_silver
from staffloom.plans.exams import exit_exams_silver
from staffloom.plans.payroll import payroll_sheets, payroll_silver
from staffloom.sources import layouts, sheets
from staffloom.sources.sheets import BRONZE_SCHEMA
from staffloom.specs import contracts, tables


def bronze(spark, data):
    """``{(file, sheet): {row number: cells}}`` as bronze rows, in no order, over several partitions."""
    rows = [(f, s, n, cells) for (f, s), table in data.items() for n, cells in table.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, BRONZE_SCHEMA).repartition(4)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(sheets, "CHUNK_ROWS", 7)


HEADERS = {
    "first_blank": (["A", " B\n x", None, "C"], ["A", "B x"]),
    "gap": (["A", None, "B", None, "", "C", None, "D"], ["A", None, "B", None, None, "C"]),
    "run": ([None, "A", None, None, "B", None, "", None, "C"], [None, "A", None, None, "B"]),
    "skip_blank": (["A", None, None, None, None, "B"], ["A", None, None, None, None, "B"]),
}


@pytest.mark.parametrize("stop", HEADERS)
def test_header_stop_rules(spark, stop):
    cells, want = HEADERS[stop]
    rows = bronze(spark, {("f", "s"): {2: cells, 3: ["x"]}})
    assert sheets.sheet_headers(rows, 2, 0, stop).first()["headers"] == want


def test_header_width_and_start(spark):
    rows = bronze(spark, {("f", "s"): {1: ["skip", "A", "B", "C"]}})
    assert sheets.sheet_headers(rows, 1, 1, "first_blank").first()["headers"] == ["A", "B", "C"]
    assert sheets.sheet_headers(rows, 1, 9, "first_blank").first()["headers"] == []
    assert [r["header"] for r in sheets.header_scan(rows, 1, 1).orderBy("pos").collect()] == ["A", "B", "C"]


def test_promote_many_differing_sheets(spark, small_chunks):
    data = {
        ("f1", "s"): {2: ["A", "B", "A"], **{n: [f"a{n}", f"b{n}", f"last{n}"] for n in range(3, 40)}},
        ("f2", "s"): {2: ["B", None, "Z"], 3: ["b", "gap", "z"], 1: ["above"]},
        ("f3", "s"): {3: ["no header"]},
        ("f4", "s"): {2: ["OLD A"], 5: ["renamed"], 6: []},
    }
    got = layouts.promote_header(bronze(spark, data), ["A", "Z", "N"], 2, aliases={"OLD A": "A"})
    rows = {(r.source_file, r.row_idx): (r.A, r.Z, r.N) for r in got.collect()}
    want = {("f1", n): (f"last{n}", None, None) for n in range(3, 40)}
    want |= {("f2", 3): (None, "z", None), ("f4", 5): ("renamed", None, None), ("f4", 6): (None, None, None)}
    assert rows == want


def test_promote_from_a_later_column(spark):
    rows = bronze(spark, {("f", "s"): {2: ["x", "A", "B"], 3: ["0", "1", "2"]}})
    assert layouts.promote_header(rows, ["A", "B"], 2, 1).select("A", "B").first()[:] == ("1", "2")


def test_discover_headers(spark):
    rows = bronze(spark, {("f", "s"): {1: ["A", "B"]}, ("g", "s"): {1: ["B", None, "C"]}})
    found = layouts.discover(rows, 1)
    assert found.names() == ["A", "B", "C"] and found.undeclared(["B"], ["C"]) == ["A"]
    sets = {(tuple(r.headers), r.sheets) for r in found.header_sets().collect()}
    assert sets == {(("A", "B"), 1), (("B", None, "C"), 1)}


def test_select_by_header_names_what_is_missing(spark):
    rows = bronze(spark, {("f", "s"): {1: ["A  x", "B"], 2: ["1", "2"]}})
    assert layouts.select_by_header(rows, ["A x"], 1).first()["A x"] == "1"
    with pytest.raises(MissingColumns) as error:
        layouts.select_by_header(rows, ["B", "Z", "Y"], 1)
    assert error.value.columns == ["Y", "Z"]


def random_sheets(seed):
    rng = random.Random(seed)
    data = {}
    for i in range(6):
        height = rng.choice([3, 20, 60])
        table = {1: ["K", "V"]}
        for n in range(2, height):
            if rng.random() < 0.15:
                continue  # absent, as a blank row of a sheet is
            table[n] = [rng.choice(["k", "k", "k", None, " "]), str(n)]
        data[(f"f{i}", "s")] = table
    return data


def assert_sums_up(found, data, header_row, want):
    for r in found.accounting().collect():
        landed = [n for n in data[r.source_file, r.sheet] if n > header_row]
        assert r.landed == len(landed) == r.headless + r.cut + r.no_key + r.footer + r.no_first_cell + r.kept
        assert r.kept == sum(file == r.source_file for file, _ in want)
        assert r.first_cut == (min((n for n in landed if (r.source_file, n) not in want), default=None) if r.no_key == 0 else r.first_cut)


def kept(df):
    return {(r.source_file, r.row_idx) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_crop_at_first_blank(spark, small_chunks, seed):
    data = random_sheets(seed)
    want = set()
    for (file, _), table in data.items():
        for n in sorted(table):
            if n > 1 and not (table[n][0] or "").strip():
                break
            if n > 1:
                want.add((file, n))
    found = layouts.discover(bronze(spark, data), 1, key="K", cut="first_blank")
    assert kept(found.table(["K", "V"])) == want
    assert_sums_up(found, data, 1, want)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("run", [2, 5, 11])
def test_crop_after_blank_run(spark, small_chunks, seed, run):
    data = random_sheets(seed)
    want = set()
    for (file, _), table in data.items():
        blanks, found = 0, False
        for n in range(2, max(table) + 1):
            if (table.get(n, [None])[0] or "").strip():
                want.add((file, n))
                blanks, found = 0, True
            elif found:
                blanks += 1
                if blanks >= run:
                    break
    found = layouts.discover(bronze(spark, data), 1, key="K", cut="blank_run", run=run)
    assert kept(found.table(["K", "V"])) == want
    assert_sums_up(found, data, 1, want)


@pytest.mark.parametrize(("blanks", "rows"), [(999, 2), (1000, 1)])
def test_blank_run_limit(spark, blanks, rows):
    data = {("f", "s"): {1: ["K"], 2: ["a"], 3 + blanks: ["b"]}}
    assert layouts.discover(bronze(spark, data), 1, key="K", cut="blank_run").table(["K"]).count() == rows


def test_crop_at_fully_blank_row(spark):
    data = {("f", "s"): {1: ["A", "B", None, "C"], 2: ["1", None], 3: [" ", "2"], 4: ["", None, "9", "9"], 5: ["3", "3"]}}
    found = layouts.discover(bronze(spark, data), 1, stop="first_blank", cut="blank_row")
    assert kept(found.table(["A"])) == {("f", 2), ("f", 3)}


def test_footers(spark):
    data = {("f", "s"): {1: ["x" * 20], 2: ["x" * 21], 3: [None, "x"], 4: ["7"], 5: [], 6: ["", "x"], 7: ["1" * 25], 8: ["-1.5e" + "1" * 25]}}
    assert kept(sheets.drop_non_data_rows(bronze(spark, data))) == {("f", 1), ("f", 4), ("f", 6), ("f", 7), ("f", 8)}


def test_skip_blank_key_goes_on(spark):
    data = {("f", "s"): {1: ["a"], 2: [" "], 3: [None], 4: ["b"]}}
    rows = sheets.skip_blank_key(bronze(spark, data), F.get("cells", F.lit(0)))
    assert kept(rows) == {("f", 1), ("f", 4)}


@pytest.mark.parametrize("most", [layouts.BROADCAST_POSITIONS, 0])
def test_big_sheet_is_read_twice_and_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(layouts, "BROADCAST_POSITIONS", most)
    monkeypatch.setattr(layouts, "BROADCAST_SHEETS", most)
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in keys}
    header = spark.createDataFrame([("f", "s", 1, ["K"])], BRONZE_SCHEMA)
    body = spark.range(2, 1_000_001).selectExpr("'f' AS source_file", "'s' AS sheet", "id AS row_idx", "array('k') AS cells")
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        cropped = layouts.discover(header.unionByName(body), 1, key="K", cut="first_blank").table(["K"])
        sizes = [r["count"] for r in cropped.groupBy(F.spark_partition_id()).count().collect()]
        plan = cropped._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 999_999 and max(sizes) < 400_000  # spread over tasks either way
    assert plan.count("Exchange hashpartitioning") == (0 if most else 2)


def test_missing_headers_are_named(spark):
    data = {("b", "s"): {1: ["A"]}, ("a", "s"): {1: ["B"]}}
    with pytest.raises(MissingColumns, match="a \\[s\\]"):
        layouts.select_by_header(bronze(spark, data), ["A", "C"], 1)


PATHED = "source_path string, source_file string, sheet string, row_idx long, cells array<string>"


def pathed(spark, rows):
    return spark.createDataFrame(rows, PATHED).repartition(3)


def test_files_of_one_name_stay_apart(spark):
    rows = pathed(spark, [
        ("/a/x.xlsx", "x.xlsx", "s", 1, ["A", "B"]), ("/a/x.xlsx", "x.xlsx", "s", 2, ["1", "2"]),
        ("/b/x.xlsx", "x.xlsx", "s", 1, ["B", "A"]), ("/b/x.xlsx", "x.xlsx", "s", 2, ["3", "4"]),
    ])
    got = layouts.promote_header(rows, ["A", "B"], 1)
    assert sorted((r.source_path, r.source_file, r.A, r.B) for r in got.collect()) == [("/a/x.xlsx", "x.xlsx", "1", "2"), ("/b/x.xlsx", "x.xlsx", "4", "3")]


def test_headless_sheets_and_sheets_without_the_key_are_findings(spark):
    data = {("f", "s"): {1: ["K"], 2: ["a"]}, ("g", "s"): {2: ["b"]}, ("h", "s"): {1: [None], 2: ["c"]}, ("i", "s"): {1: ["V"], 2: ["d"], 3: [None]}}
    found = layouts.discover(bronze(spark, data), 1, key="K", cut="first_blank")
    assert {r.source_file for r in found.headless().collect()} == {"g", "h"}
    assert kept(found.table(["V"])) == {("f", 2), ("h", 2), ("i", 2), ("i", 3)}
    with pytest.raises(MissingColumns, match="g \\[s\\]"):
        found.require_key("K")
    assert {r.source_file: r.headless for r in found.accounting().collect()} == {"f": 0, "g": 1, "h": 0, "i": 0}


def employee_rows(spark, *files):
    """``files`` of (name, header, data rows)."""
    return pathed(spark, [
        ("/in/" + name, name, "METSO", 10 + k, cells) for name, header, data in files for k, cells in enumerate([header, *data])
    ])


def test_employees_keep_undeclared_headers_and_find_the_document(spark):
    rows = employee_rows(
        spark,
        ("BD. 01.02.2025..xlsx", ["NUMERO DE DOC", "SEXO", "CORREO"], [["1", "F", "a@x"], ["2", "M", "nan"], [" ", "M", "cut"]]),
        ("BD. 01.03.2025..xlsx", ["sexo 2", "Numero de Doc.", "SEXO"], [["x", "3", "F"]]),
    )
    got = employees_silver(rows)
    declared = [n for n in tables.EMPLOYEES.names if n != "FECHA_DOCUMENTO"]
    assert got.columns == ["source_file", "row_idx", *declared, "sexo 2", "Numero de Doc.", "CORREO", "FECHA_DOCUMENTO"]
    assert sorted((r["NUMERO DE DOC"], r.SEXO, r.CORREO, r["sexo 2"], r["Numero de Doc."]) for r in got.collect()) == [
        ("1", "F", "a@x", None, None), ("2", "M", None, None, None), ("3", "F", None, "x", "3"),
    ]
    with pytest.raises(MissingColumns, match="NUMERO DE DOC"):
        employees_silver(employee_rows(spark, ("BD. 01.02.2025..xlsx", ["SEXO"], [["F"]])))


def test_names_that_differ_by_case_are_one_column_where_the_session_says_so(spark):
    rows = bronze(spark, {("f", "s"): {1: ["K", "Nota"], 2: ["1", "x"]}, ("g", "s"): {1: ["NOTA", "K"], 2: ["y", "2"]}})
    found = layouts.discover(rows, 1)
    names = found.undeclared(["K"])
    assert names == ["NOTA"] and {(r.K, r.NOTA) for r in found.table(["K", *names]).collect()} == {("1", "x"), ("2", "y")}
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        names = found.undeclared(["K"])
        got = {(r[2 + 1], r[2 + 2], r[2 + 3]) for r in found.table(["K", *names]).collect()}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert names == ["NOTA", "Nota"] and got == {("1", None, "x"), ("2", "y", None)}


def test_payroll_keeps_undeclared_headers_and_leaves_out_earlier_output(spark):
    row = lambda name, n, cells: ("/in/" + name, name, "Planilla", n, cells)
    rows = pathed(spark, [
        row("Planilla 2024-05.xlsx", 6, ["CÓDIGO CORPORATIVO", "DNI/CEX", None, "BONO"]), row("Planilla 2024-05.xlsx", 7, ["C1", "11", None, "5"]),
        row("Planilla 2024-05.xlsx", 8, ["TOTAL GENERAL DE LA PLANILLA", "9", None, "5"]), row("Planilla 2024-05.xlsx", 9, [None, "9", None, "5"]),
        row("Planilla 2024-06.xlsx", 6, ["DNI/CEX", "MES"]), row("Planilla 2024-06.xlsx", 7, ["22", "no"]),
        row("Planilla Metso Consolidado 2024-06.xlsx", 6, ["DNI/CEX"]), row("Planilla Metso Consolidado 2024-06.xlsx", 7, ["33"]),
        row("Planilla 2024-07.xlsx", 7, ["no header"]),
    ])
    got = payroll_silver(rows)
    assert got.columns[:3] == ["PERIODO", "AÑO", "MES"] and got.columns[-1] == "BONO"
    assert sorted((r["DNI/CEX"], r.MES, r.BONO) for r in got.collect()) == [("11", 5, "5"), ("22", 6, None)]
    told = {r.source_file: r for r in payroll_sheets(rows, every=True).accounting(footers=True).collect()}
    may, july = told["Planilla 2024-05.xlsx"], told["Planilla 2024-07.xlsx"]
    assert (may.landed, may.footer, may.no_first_cell, may.kept) == (3, 1, 1, 1) and (july.landed, july.headless) == (1, 1)
    assert all(r.landed == r.headless + r.cut + r.no_key + r.footer + r.no_first_cell + r.kept for r in told.values())


def test_exams_keep_undeclared_headers(spark):
    header = list(contracts.EXIT_EXAMS.sheets[0].required)
    rows = pathed(spark, [("/e.xlsx", "e.xlsx", "DATA", 3, [*header, "NOTA", "AÑO"]), ("/e.xlsx", "e.xlsx", "DATA", 4, ["Ana", "1.0", "2026-01-15", " n ", "x"])])
    got = exit_exams_silver(rows)
    assert "NOTA" in got.columns and "AÑO" not in got.columns and got.first().NOTA == "n"


def test_layouts_of_no_rows(spark):
    rows = spark.createDataFrame([], PATHED)
    for cut in (None, "first_blank", "blank_row", "blank_run"):
        found = layouts.discover(rows, 1, key="K", cut=cut)
        assert found.names() == [] and found.table(["K"]).collect() == [] and found.accounting().collect() == []
