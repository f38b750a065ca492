"""Physical plans: what the queries read, shuffle and sort."""

import re

import pytest
from pyspark.sql import functions as F

from staffloom.plans.payroll import PERSON_PERIOD, leave_reasons
from staffloom.operators.joins import left_join
from staffloom.operators.quality import check_unique
from staffloom.registry import QUERIES
from staffloom.sources import buckets
from staffloom.sources.buckets import open_bucketed, write_bucketed


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["A3_dedup_keep_first", "W1_first_value_by_priority", "Q3_cost_centers", "Q15_exit_exams_enriched"])
def test_no_sort_aggregate(spark, folder, name):
    assert "SortAggregate" not in final_plan(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["Q1_employees_silver", "Q4_payroll_silver", "Q11_intern_control_silver", "Q13_exit_exams_silver"])
def test_sheet_rows_are_not_shuffled(spark, folder, name):
    """Over the written facts there is one pass of the rows (the fixture reads its table once for data and once for headers)."""
    plan = final_plan(QUERIES[name](spark, folder))
    assert len(re.findall(r"FileScan parquet.*orders", plan)) <= 2
    assert "SortMergeJoin" not in plan and "Window" not in plan
    # the only exchange is the fixture's own, of header rows
    assert len(re.findall(r"Exchange hashpartitioning\((?!.*source_file)", plan)) == 0


def test_preflight_in_three_scans(spark, folder):
    plan = final_plan(QUERIES["V12_preflight"](spark, folder))
    assert len(re.findall(r"\bScan parquet|FileScan parquet", plan)) <= 7  # three of the fixture, each a union with its headers


def test_bucketed_layers_meet_without_an_exchange(spark, tmp_path):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        payroll = spark.range(200).select(F.col("id").cast("string").alias("DNI/CEX"), F.lit("2024-05").alias("PERIODO"), F.lit(1).alias("v"))
        leave = spark.range(300).select(
            (F.col("id") % 150).cast("string").alias("DNI/CEX"), F.lit("2024-05").alias("PERIODO"),
            F.concat(F.lit("m"), F.col("id").cast("string")).alias("MOTIVO"), F.lit("CON_GOCE").alias("TIPO_LICENCIA"),
        )
        a = write_bucketed(payroll, f"{tmp_path}/payroll", PERSON_PERIOD, 4)
        write_bucketed(leave, f"{tmp_path}/leave", PERSON_PERIOD, 4)
        b = open_bucketed(spark, f"{tmp_path}/leave", ", ".join(f"`{n}` {k}" for n, k in leave.dtypes), PERSON_PERIOD, 4)
        joined = left_join(a, leave_reasons(b), PERSON_PERIOD)
        assert "Exchange" not in final_plan(joined)
        assert {r["DNI/CEX"]: r.MOTIVO_CON_GOCE for r in joined.collect()}["7"] == "m157 | m7"
        groups = final_plan(check_unique(a, PERSON_PERIOD))
        assert "Exchange hashpartitioning" not in groups and "Exchange SinglePartition" in groups
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["J1_bucketed_layers", "V6_bucketed_key"])
def test_buckets_grow_with_the_layer(spark, folder, monkeypatch, name):
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", n // 20, raising=False)
    before = {t.name for t in spark.catalog.listTables()}
    QUERIES[name](spark, folder)
    made = {t.name for t in spark.catalog.listTables()} - before
    numbers = {r.data_type for t in made for r in spark.sql(f"DESCRIBE FORMATTED {t}").collect() if r.col_name == "Num Buckets"}
    assert numbers == {"32"}
