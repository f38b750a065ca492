"""Projection, casts, filters, joins, aggregates and ordering on small tables."""

from collections import Counter
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from staffloom.names import c, q
from staffloom.operators import aggregates, casting, filters, joins, projection, sets
from staffloom.plans.exams import unified_cost_centers
from staffloom.plans.payroll import leave_reasons, payroll_with_leave
from staffloom.specs import Col, RowFilter, TableSpec, tables

SPEC = TableSpec("t", (Col("A.1"), Col("N", "integer"), Col("X", "float"), Col("D", "date"), Col("Y", derived_from="D")))


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_names(spark):
    df = spark.createDataFrame([("x", 1)], ["F. RENOVACION", "a`b"])
    assert df.select(c("F. RENOVACION"), c("a`b")).first()[:] == ("x", 1)
    assert q("a`b") == "`a``b`"


def test_select_spec(spark):
    df = spark.createDataFrame([("d", "n", "a", "z")], ["D", "N", "A.1", "Z"])
    with pytest.warns(UserWarning, match="X"):
        assert projection.select_spec(df, SPEC).columns == ["A.1", "N", "D"]
    with pytest.warns(UserWarning):
        assert projection.select_spec(df, SPEC, order="source").columns == ["D", "N", "A.1"]
    with pytest.raises(projection.MissingColumns) as error:
        projection.select_spec(df, SPEC, missing="error", skip_derived=True)
    assert error.value.columns == ["X"]


def test_reordering(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["ID", "MES", "OTRA"])
    added = projection.insert_after(df, "NOMBRE_MES", F.lit("x"), "MES")
    assert added.columns == ["ID", "MES", "NOMBRE_MES", "OTRA"]
    assert projection.insert_after(added, "ID", F.lit(9), "OTRA").columns == ["MES", "NOMBRE_MES", "OTRA", "ID"]
    assert projection.move_first(df, ["OTRA", "MES"]).columns == ["OTRA", "MES", "ID"]
    with pytest.raises(projection.MissingColumns):
        projection.insert_after(df, "x", F.lit(1), "nope")
    assert projection.with_constant(df, "K", "v").first()["K"] == "v"
    assert projection.rename(df, {"MES": "M", "nope": "n"}).columns == ["ID", "M", "OTRA"]


RAW = [("a", "31", "1.5", "2024-01-05 00:00:00.5"), ("b", "31.0", "1d", "2024-01-05"), ("c", " 31 ", "-.5e1", None),
       ("d", "x", "nan", "bad"), ("e", None, None, None)]


def raw(spark):
    return spark.createDataFrame(RAW, "`A.1` string, N string, X string, D string")


def test_lenient_casts(spark):
    got = [tuple(r) for r in casting.cast_spec(raw(spark), SPEC).orderBy(c("A.1")).collect()]
    assert [r[1] for r in got] == [31, None, None, None, None]
    assert got[0][2:] == (1.5, date(2024, 1, 5))
    assert got[1][2:] == (None, None)
    assert got[2][2:] == (-5.0, None)
    assert got[3][2] != got[3][2]  # nan


def test_strict_casts_keep_the_whole_column(spark):
    assert dict(casting.cast_spec(raw(spark), SPEC, "keep_on_failure").dtypes) == {
        "A.1": "string", "N": "string", "X": "string", "D": "date",
    }
    good = raw(spark).filter(c("A.1") == "a")
    assert dict(casting.cast_spec(good, SPEC, "keep_on_failure").dtypes)["N"] == "bigint"
    assert dict(casting.cast_spec(good.limit(0), SPEC, "keep_on_failure").dtypes)["X"] == "double"


def test_cast_all_string(spark):
    df = spark.createDataFrame([(1, 2.5, True)], ["a", "b", "c"])
    assert [k for _, k in casting.cast_all_string(df, ["a"]).dtypes] == ["bigint", "string", "string"]


def test_filters(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), (" ", 3), ("y", 4)], "k string, n int")
    assert [r.n for r in filters.filter_not_null(df, "k").collect()] == [1, 3, 4]
    assert filters.filter_not_null(df, "nope").count() == 4
    assert [r.n for r in filters.filter_not_blank(df, ["k"]).collect()] == [1, 4]
    yes, no = filters.split_by(df, c("k") == "x")
    assert [r.n for r in yes.collect()] == [1] and [r.n for r in no.collect()] == [3, 4]
    apply = lambda *rules: [r.n for r in filters.apply_filters(df, rules).collect()]
    assert apply(RowFilter("k", "NOT_EQUAL", "x")) == [3, 4]
    assert apply(RowFilter("k", "EQUAL", "x")) == [1]
    assert apply(RowFilter("k", "IS_NULL")) == [2]
    assert apply(RowFilter("k", "IS_NOT_NULL"), RowFilter("nope", "EQUAL", "x")) == [1, 3, 4]
    assert [r.n for r in df.filter(filters.not_in(c("k"), ["x"])).collect()] == [3, 4]
    empty = spark.createDataFrame([(None, None), (None, 1)], "a string, b int")
    assert filters.drop_all_null_rows(empty).count() == 1


def test_wide_all_null_filter_plans_fast(spark):
    """The predicate over all columns is not pushed below the projection that makes them."""
    from time import perf_counter

    wide = spark.range(5).select(*[F.when(c("id") > i % 3, F.lit("x")).alias(f"c{i}") for i in range(40)])
    start = perf_counter()
    assert filters.drop_all_null_rows(wide).count() == 4
    assert perf_counter() - start < 60


def skewed(spark):
    """A third of the rows under one key, a third of them copies of one row, some without a key."""
    data = [("hot", "p", "same") for _ in range(3000)] + [("hot", "p", str(i)) for i in range(3000)]
    data += [(f"k{i % 500}", "p", str(i)) for i in range(2500)] + [(None, "p", str(i)) for i in range(500)]
    return spark.createDataFrame(data, "k string, p string, v string").repartition(6)


def test_skewed_left_join_equals_plain_join(spark):
    left = skewed(spark)
    right = spark.createDataFrame(
        [("hot", "p", 1)] + [(f"k{i}", "p", i) for i in range(0, 600, 2)], "k string, p string, w int"
    )
    got = joins.left_join(left, right, ["k", "p"])
    plain = left.join(right, ["k", "p"], "left").select("k", "p", "v", "w")
    assert got.columns == plain.columns
    assert rows(got) == rows(plain)
    twice = right.unionByName(right)
    assert rows(joins.left_join(left, twice, ["k", "p"])) == rows(
        left.join(twice, ["k", "p"], "left").select("k", "p", "v", "w")
    )


def test_skewed_left_join_without_broadcast(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", "p", 1), ("k2", "p", 2)], "k string, p string, w int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.left_join(left, right, ["k", "p"])
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == rows(left.join(right, ["k", "p"], "left").select("k", "p", "v", "w"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_left_join_of_different_key_types(spark):
    """A hot int key meets a long key, whatever the number of rows."""
    left = spark.range(2000).select(F.when(c("id") < 1000, 7).otherwise(c("id")).cast("int").alias("k"))
    right = spark.createDataFrame([(7, 1), (1500, 2)], "k long, w int")
    got = joins.left_join(left, right, ["k"])
    assert got.filter("w = 1").count() == 1000 and got.filter("w = 2").count() == 1 and got.count() == 2000


def test_lookup_join_deals_rows_without_a_code(spark):
    """Blank and null codes are most rows; no task gets them all, and rows are those of a plain left join."""
    code = F.when(c("id") % 3 == 0, "").when(c("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (c("id") % 50).cast("string")))
    left = spark.range(6000).select(code.alias("k"), c("id").alias("v")).repartition(4)
    right = spark.createDataFrame([("", 0), (None, 9), ("k2", 2), ("k5", 5)], "k string, w int")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("-1", "false")):
            spark.conf.set(k, v)
        got = joins.lookup_join(left, right, "k")
        plain = left.join(right, ["k"], "left").select("k", "v", "w")
        assert got.columns == plain.columns and rows(got) == rows(plain)
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_match_status(spark):
    df = spark.createDataFrame([("", None), ("", "x"), ("a", None), (None, None), ("a", "a")], "code string, cc string")
    got = [r[0] for r in df.select(joins.match_status(c("code"), c("cc"))).collect()]
    assert got == ["SIN_CODIGO", "SIN_CODIGO", "CODIGO_NO_ENCONTRADO", "CODIGO_NO_ENCONTRADO", "OK"]


LEAVE = "`DNI/CEX` string, PERIODO string, MOTIVO string, TIPO_LICENCIA string"


def test_leave_reasons(spark):
    data = [("1", "p", m, "CON_GOCE") for m in ("b", "a", "b", None)] + [("1", "p", "z", "SIN_GOCE")]
    data += [("2", "p", None, "CON_GOCE"), ("3", "p", "x", "SIN_GOCE"), ("4", "p", "", "CON_GOCE")]
    leave = spark.createDataFrame(data, LEAVE)
    got = {r[0]: r[2:] for r in map(tuple, leave_reasons(leave).collect())}
    assert got == {"1": ("a | b | b", "z"), "2": (None, None), "3": (None, "x"), "4": ("", None)}
    payroll = spark.createDataFrame([("1", "p", 1), ("1", "q", 2), ("9", "p", 3), (None, "p", 4)], "`DNI/CEX` string, PERIODO string, n int")
    enriched = {r.n: (r.MOTIVO_CON_GOCE, r.MOTIVO_SIN_GOCE) for r in payroll_with_leave(payroll, leave).collect()}
    assert enriched == {1: ("a | b | b", "z"), 2: (None, None), 3: (None, None), 4: (None, None)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.one_of(st.none(), st.text("ab |", max_size=3))), min_size=1, max_size=30))
def test_string_agg_property(spark, data):
    df = spark.createDataFrame(data, "k string, v string")
    got = {r.k: r.o for r in aggregates.string_agg_ordered(df, ["k"], "v", {"o": F.lit(True)}).collect()}
    want = {}
    for key in {k for k, _ in data}:
        values = sorted((v for k, v in data if k == key and v is not None), key=lambda v: v.encode())
        want[key] = " | ".join(values) if values else None
    assert got == want


def test_dedup_keeps_the_first_in_order(spark):
    data = [("a", "second", 2), ("a", "first", 1), ("b", "only", 3), (None, "null", 5), (None, "null first", 4)]
    df = spark.createDataFrame(data, "k string, v string, i int").repartition(3)
    got = aggregates.dedup_keep_first(df, "k", ["i"])
    assert got.columns == ["k", "v", "i"]
    assert {(r.k, r.v) for r in got.collect()} == {("a", "first"), ("b", "only"), (None, "null first")}


CC = "CC string, `NOMBRE CC` string, `CATEGORIA CC` string, GERENCIA string"


def test_cost_center_priority(spark):
    current = spark.createDataFrame([("1", None, "new", "g"), ("2", "cur", "c", "g")], CC)
    old = spark.createDataFrame([("1", "old", "old", "old"), ("3", "old", "o", "o")], CC)
    got = {r.CC: tuple(r)[1:] for r in unified_cost_centers(current, old).collect()}
    assert got == {"1": (None, "new", "g"), "2": ("cur", "c", "g"), "3": ("old", "o", "o")}


def test_counts(spark):
    df = spark.createDataFrame([("a", True), ("a", None), (None, False), ("b", True)], "k string, f boolean")
    assert [tuple(r) for r in aggregates.group_count(df, ["k"]).collect()] == [("a", 2), (None, 1), ("b", 1)]
    assert [tuple(r) for r in aggregates.value_counts(df, "k").collect()] == [(None, 1), ("a", 2), ("b", 1)]
    assert [r.k for r in aggregates.distinct_sorted(df, "k").collect()] == [None, "a", "b"]
    assert aggregates.count_distinct(df, "k").first()[0] == 3
    assert aggregates.count_distinct(df, "k", null_is_value=False).first()[0] == 2
    assert aggregates.count_true(df, {"f": c("f")}).first()[:] == ("f", 2, 50.0)
    assert aggregates.count_true(df.limit(0), {"f": c("f")}).first()[:] == ("f", 0, 0.0)


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "i int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, i int")
    got = sets.union_diagonal(a, b)
    assert got.columns == ["i", "a", "b"]
    assert rows(got) == Counter([(1, "x", None), (2, None, "y")])
    assert sets.union_all(a, a, a).count() == 3


def test_order_spreads_equal_keys(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.lit("same").alias("k"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sets.order_by(df, [c("k").asc_nulls_last()])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40_000 and max(sizes) < 20_000
    back = sets.order_by(spark.createDataFrame([(2,), (None,), (1,)], "i int"), [c("i").desc_nulls_last()])
    assert [r.i for r in back.collect()] == [2, 1, None]


def test_spec_lookup():
    assert tables.PAYROLL["MES"].max_value == 12
    assert "NETO" in tables.MINING_PAYROLL and "NETO" not in tables.PAYROLL
    assert tables.EXIT_EXAMS.to_struct()["FECHA DE CESE"].nullable is False
    with pytest.raises(KeyError):
        tables.PAYROLL["nope"]
