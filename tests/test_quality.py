"""Reports on small tables."""

import pytest
from pyspark.sql import functions as F

from staffloom.functions.text import is_blank
from staffloom.names import c
from staffloom.operators import quality
from staffloom.plans.income import cleaning_rules
from staffloom.specs import Col, TableSpec, tables

SPEC = TableSpec(
    "t",
    (
        Col("K", nullable=False), Col("S", allowed=("M", "F")), Col("N", "integer", min_value=0, max_value=31),
        Col("T", "float", min_value=0), Col("Z", "date"),
    ),
    primary_key=("K", "P"),
)
DATA = [("a", "M", -1, "x"), ("a", "X", 0, "x"), (None, None, None, "x"), ("b", "Y", 32, "x"), ("c", "X", 31, None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(DATA, "K string, S string, N long, T string")


def found(report):
    return {(r.rule, r.column): (r.n_bad, r.severity, r.sample) for r in report.collect()}


def test_metadata_checks(df):
    assert found(quality.check_columns(df, SPEC)) == {("missing_column", "Z"): (1, "error", None)}
    assert set(found(quality.check_types(df, SPEC))) == {("wrong_type", "T")}


def test_counted_checks(df):
    assert found(quality.check_not_null(df, SPEC)) == {("null", "K"): (1, "error", None)}
    assert found(quality.check_allowed(df, SPEC)) == {("not_allowed", "S"): (3, "warning", "X, Y")}
    assert found(quality.check_range(df, SPEC)) == {
        ("below_min", "N"): (1, "warning", None), ("above_max", "N"): (1, "warning", None),
    }
    assert found(quality.check_unique(df, ["K", "P"])) == {("duplicate_key", "K"): (1, "warning", None)}
    assert found(quality.check_unique(df, ["K", "N"])) == {("duplicate_key", "K, N"): (0, "error", None)}


def test_all_checks_of_a_table(df):
    assert set(found(quality.check_table(df, SPEC))) == {
        ("missing_column", "Z"), ("wrong_type", "T"), ("null", "K"), ("not_allowed", "S"), ("below_min", "N"),
        ("above_max", "N"), ("duplicate_key", "K"),
    }


def test_samples_are_the_first_distinct_values(spark):
    df = spark.range(1000).select(F.format_string("v%03d", c("id") % 100).alias("S"))
    assert quality.invalid_samples(df, SPEC).first()["sample"] == "v000, v001, v002, v003, v004"


def test_require(df):
    with pytest.raises(quality.QualityError, match="null K"):
        quality.require(quality.check_not_null(df, SPEC))
    quality.require(quality.check_allowed(df, SPEC))  # warnings pass


def test_profiles(spark, df):
    assert {r.column: (r.n_null, r.pct_null) for r in quality.null_profile(df).collect()} == {
        "K": (1, 20.0), "S": (1, 20.0), "N": (1, 20.0), "T": (1, 20.0),
    }
    steps = {"K": ~is_blank(c("K")), "N": c("N") >= 0}
    assert {r.step: r.n_lost for r in quality.row_loss(df, steps).collect()} == {"K": 1, "N": 1}
    raw = spark.createDataFrame([("0", "#N/D"), ("P", None), (None, "xERROR")], "PROYECTO string, `CODIGO SAP` string")
    assert {r.rule: r.n_changed for r in quality.change_profile(raw, cleaning_rules()).collect()} == {
        "PROYECTO": 2, "CODIGO SAP": 2,
    }
    assert {r.S: (r.cantidad, r.porcentaje) for r in quality.shares(df, "S").collect()} == {
        "M": (1, 20.0), "X": (2, 40.0), "Y": (1, 20.0), None: (1, 20.0),
    }


def test_payroll_limits_come_from_the_spec(spark):
    gold = spark.createDataFrame([(0,), (13,), (5,)], "MES long")
    assert found(quality.check_range(gold, tables.PAYROLL)) == {
        ("below_min", "MES"): (1, "warning", None), ("above_max", "MES"): (1, "warning", None),
    }
