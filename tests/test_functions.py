"""Boundary values of the scalar functions."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from staffloom.functions import dates, flags, periods, service, text
from staffloom.specs import contracts, rules


def apply(spark, fn, values, kind="string"):
    """Result of ``fn`` on each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_takes_any_white_space(spark):
    assert apply(spark, text.strip, [" a b\t", "\n x　", "", " \t", None]) == ["a b", "x", "", "", None]


def test_is_blank(spark):
    assert apply(spark, text.is_blank, [None, "", " \t ", "x"]) == [True, True, True, False]


def test_headers(spark):
    raw = [" N° ", "A\r\n B", "a   b\t c", None]
    assert apply(spark, text.normalize_header, raw) == ["N°", "A B", "a b c", None]
    assert apply(spark, text.header_key, raw) == ["N°", "A B", "A B C", None]


def test_null_tokens(spark):
    assert apply(spark, text.null_tokens, ["None", "nan", "NaT", "none", "x", None]) == [None, None, None, "none", "x", None]


def test_system_codes(spark):
    raw = ["#N/D", "x#N/A", "#n/d", "Error", "ERRor 7", None, "123"]
    assert apply(spark, text.sentinel_to_null, raw) == [None, None, "#n/d", None, None, None, "123"]


def test_error_cells(spark):
    assert apply(spark, text.error_cells_to_null, ["#N/A", "#REF!", "a#", None]) == [None, None, "a#", None]


def test_project_default(spark):
    raw = ["0", " 0 ", "", "  ", None, "P1"]
    assert apply(spark, text.default_if_blank, raw) == ["Staff", " 0 ", "Staff", "Staff", "Staff", "P1"]


def test_impute_and_fill(spark):
    assert apply(spark, text.impute, [None, "", " ", "S"]) == ["Personal_Interno", "Personal_Interno", " ", "S"]
    assert apply(spark, lambda c: text.fill_null(c, "X"), [None, "", "S"]) == ["X", "", "S"]


def test_document_numbers(spark):
    raw = ["123.0", "1230", "12.05", "a.0", ".0", "1.0.0", None]
    assert apply(spark, text.strip_dot_zero, raw) == ["123", "1230", "12.05", "a", "", "1.0", None]


def test_numbers_to_text(spark):
    raw = [3.0, 3.5, 0.25, -7.0, 1e20, 0.1234567, 100.0, None]
    got = apply(spark, text.number_to_text, raw, "double")
    assert got == ["3", "3.5", "0.25", "-7", "100000000000000000000", "0.123457", "100", None]
    cells = ["3.0", "3.50", "1e3", "abc", "12", "1.2.3", None]
    assert apply(spark, text.float_text_to_text, cells) == ["3", "3.5", "1000", "abc", "12", "1.2.3", None]
    assert apply(spark, text.whole_float_text, cells) == ["3", "3.50", "1000", "abc", "12", "1.2.3", None]


def test_slashed_dates(spark):
    raw = ["1/2/2024", " 31/12/1999 ", "31/02/2024", "2024-01-01", "x", None]
    want = ["2024-02-01 00:00:00", "1999-12-31 00:00:00", "31/02/2024", "2024-01-01", "x", None]
    assert apply(spark, dates.ddmmyyyy_to_iso, raw) == want


def test_stamps(spark):
    raw = ["2024-01-05 00:00:00", "2024-01-05 10:11:12.5", "2024-01-05", "2024-02-30 00:00:00", "2024-01-05 25:00:00", None]
    day = date(2024, 1, 5)
    assert apply(spark, dates.parse_stamp, raw) == [day, day, None, None, None, None]
    assert apply(spark, lambda c: dates.parse_stamp(c, False), raw) == [day, None, None, None, None, None]
    assert apply(spark, dates.parse_stamp_or_date, raw) == [day, None, day, None, None, None]


def test_excel_dates(spark):
    raw = ["45000", "45000.9", "2023-03-15", "15/03/2023", "15-03-2023", "2023/03/15", "15.03.2023", "5/3/2023",
           "2023-03-15 08:00:00", "31/02/2025", "2023-03/15", " ", "x", None, "9999999"]
    day = date(2023, 3, 15)
    want = [day, day, day, day, day, day, day, date(2023, 3, 5), day, None, None, None, None, None, None]
    assert apply(spark, dates.parse_excel_date, raw) == want


def test_periods(spark):
    df = spark.createDataFrame(
        [("2024", "1"), ("2024", "01"), ("2024", "12"), ("2024", "123"), ("2024", None), (None, "1")], "y string, m string"
    )
    got = [r[0] for r in df.select(periods.make_period(F.col("y"), F.col("m"))).collect()]
    assert got == ["2024-01", "2024-01", "2024-12", "2024-123", None, None]
    assert apply(spark, periods.period_year, ["2024-07", None]) == ["2024", None]
    assert apply(spark, periods.period_month, ["2024-07", "2024-x1", "2024", None]) == [7, None, None, None]


def test_months(spark):
    assert apply(spark, dates.month_name, list(range(1, 13)), "long") == list(rules.MONTH_NAMES)
    assert apply(spark, dates.month_name, [0, 13, None], "long") == [None, None, None]
    assert apply(spark, lambda c: dates.month_name(c, ""), [1, None, 13], "int") == ["January", "", ""]


@pytest.mark.parametrize(
    ("pattern", "name", "want"),
    [
        (contracts.EMPLOYEE_FILE, "BD. 21.12.2025..xlsx", "2025-12-21"),
        (contracts.EMPLOYEE_FILE, "BD. 21.12.2025..xlsm", "2025-12-21"),
        (contracts.EMPLOYEE_FILE, "bd.21.12.2025..XLS", "2025-12-21"),
        (contracts.EMPLOYEE_FILE, "Base de Datos 21.12.2025.xlsm", None),
        (contracts.EMPLOYEE_FILE, "BD. 31.02.2025..xlsm", None),
        (contracts.INTERN_FILE, "BD Practicantes 30.03.2026.xlsx", "2026-03-30"),
        (contracts.INTERN_FILE, "BD Practicantes 30.03.2026.xls", "2026-03-30"),
        (contracts.INTERN_FILE, "Control Practicantes 30.03.2026.xlsx", None),
        (contracts.INTERN_FILE, "BD Practicantes 31.02.2026.xlsx", None),
    ],
)
def test_document_dates(spark, pattern, name, want):
    assert apply(spark, lambda c: dates.document_date_from_filename(c, pattern), [name]) == [want]


def test_file_periods(spark):
    raw = ["Planilla 2024-05 Empleados.xlsx", "Planilla.xlsx", "2023-01 2024-02.xlsx", None]
    assert apply(spark, dates.period_from_filename, raw) == ["2024-05", None, "2023-01", None]
    assert apply(spark, dates.has_document_date_fragment, ["a 01.02.2024 b", "1.2.2024", None]) == [True, False, None]


def test_service_text(spark):
    def one(start, end, as_of):
        years = service.service_years(
            F.lit(start).cast("date"), F.lit(end).cast("date"), F.lit(as_of).cast("date")
        )
        return spark.range(1).select(service.service_text(years)).first()[0]

    assert one("2020-01-01", "2025-12-31", "2026-06-30") == "5 años, 11 meses"
    assert one("2020-01-01", None, "2021-01-01") == "1 años, 0 meses"
    assert one(None, None, "2021-01-01") == " años,  meses"


def intern_row(spark, days, condition=rules.PROFESSIONAL_INTERN):
    from staffloom.plans.interns import intern_control_gold

    start = date(2024, 1, 1)
    end = None if days is None else start + timedelta(days=days)
    df = spark.createDataFrame(
        [("1", condition, start, end, "2026-03-30", "S", "U", "J", "G")],
        "DNI string, CONDICION string, `FECHA ING` date, `F. RENOVACION` date, FECHA_DOCUMENTO string, SEDE string, "
        "UNIVERSIDAD string, `JEFE INMEDIATO` string, GERENCIA string",
    )
    r = intern_control_gold(df).first()
    return r.dias_servicio, r.por_cumplir_1, r.cumplio_1, r.por_cumplir_2, r.tiempo_servicio


@pytest.mark.parametrize(
    ("days", "want"),
    [
        (0, ("NO", "NO", "NO", "0 meses")),
        (334, ("NO", "NO", "NO", "10 meses")),
        (335, ("SI", "NO", "NO", "1 año (En límite)")),
        (364, ("SI", "NO", "NO", "1 año (En límite)")),
        (365, ("NO", "SI", "NO", "11 meses")),
        (366, ("NO", "SI", "NO", "1 año")),
        (400, ("NO", "SI", "NO", "1 año y 1 meses")),
        (639, ("NO", "SI", "NO", "1 año y 8 meses")),
        (640, ("NO", "SI", "SI", "2 años (Límite Máximo)")),
        (729, ("NO", "SI", "SI", "2 años (Límite Máximo)")),
        (730, ("NO", "SI", "NO", "1 año y 11 meses")),
        (731, ("NO", "SI", "NO", "2 años")),
        (800, ("NO", "SI", "NO", "2 años y 2 meses")),
        (None, (None, None, None, None)),
    ],
)
def test_intern_days(spark, days, want):
    assert intern_row(spark, days) == (days, *want)


def test_other_interns_have_no_flag(spark):
    assert intern_row(spark, 340, "PRE PROFESIONAL")[1:] == ("NO", "NO", "NO", "11 meses")


def test_contract_limits(spark):
    work, increase = rules.CONTRACT_RULES

    def flag(rule, modality, days):
        years = F.lit(days).cast("int") / F.lit(rules.DAYS_PER_YEAR)
        return spark.range(1).select(flags.contract_alert(F.lit(modality), years, rule)).first()[0]

    assert [flag(work, work.modality, d) for d in (1643, 1644, None)] == [False, True, None]
    assert [flag(increase, increase.modality, d) for d in (913, 914)] == [False, True]
    assert flag(work, "otro", None) is False
    assert flag(work, None, 1644) is None


def test_ages(spark):
    births = [date(2026 - n, 6, 1) for n in (64, 65, 66, 69, 70, 71)] + [None]
    as_of = lambda: F.lit("2026-03-01").cast("date")
    got = {r.column: apply(spark, lambda c: flags.age_flag(c, as_of(), r), births, "date") for r in rules.AGE_RULES}
    hit = lambda *ages: [n in ages for n in (64, 65, 66, 69, 70, 71)] + [None]
    assert got == {
        "cumple_65_esteaño": hit(65), "cumple_65_proximoaño": hit(64),
        "cumple_70_esteaño": hit(70), "cumple_70_proximoaño": hit(69),
    }
