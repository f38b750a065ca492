"""Data-quality reports.

A report is a DataFrame with one row per finding: ``(source, rule, column,
severity, n_bad, sample)``.  Counts of all columns and rules of a table come
from one aggregate over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from staffloom.names import c
from staffloom.operators.aggregates import count_true, share_of
from staffloom.operators.casting import typed_column
from staffloom.operators.filters import not_in
from staffloom.specs import TableSpec

REPORT_SCHEMA = "source string, rule string, column string, severity string, n_bad long, sample string"
SAMPLE_SIZE = 5

ERROR, WARNING = "error", "warning"


class QualityError(ValueError):
    """A table broke rules of severity ``error``."""


# --- metadata checks: no job -------------------------------------------------


def check_columns(df: DataFrame, spec: TableSpec, severity: str = ERROR) -> DataFrame:
    """Columns of the spec that the table lacks."""
    rows = [
        (spec.name, "missing_column", col, severity, 1, None)
        for col in spec.source_names
        if col not in df.columns
    ]
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def check_types(df: DataFrame, spec: TableSpec, severity: str = ERROR) -> DataFrame:
    """Columns whose type is not the declared one (any integer width passes as integer)."""
    actual = dict(df.dtypes)
    accepted = {
        "string": {"string"},
        "integer": {"bigint", "int", "smallint", "tinyint"},
        "float": {"double", "float"},
        "boolean": {"boolean"},
        "date": {"date", "timestamp", "timestamp_ntz"},
    }
    rows = [
        (spec.name, "wrong_type", col.name, severity, 1, f"{col.type} expected, {actual[col.name]} found")
        for col in spec.columns
        if col.name in actual and actual[col.name] not in accepted[col.type]
    ]
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def check_headers(missing: DataFrame, source: str, severity: str = ERROR) -> DataFrame:
    """Headers that sheets lack (``source_file, header``, one row per sheet), with the number of sheets and one file of them."""
    return missing.groupBy("header").agg(F.count(F.lit(1)).alias("n_bad"), F.min("source_file").alias("sample")).select(
        F.lit(source).alias("source"), F.lit("missing_column").alias("rule"), F.col("header").alias("column"),
        F.lit(severity).alias("severity"), "n_bad", "sample",
    )


# --- counted checks: one aggregate ---------------------------------------------


def _count_rules(df: DataFrame, rules: Sequence[tuple[str, str, str, Column]], source: str) -> DataFrame:
    """One row per (rule, column, severity, condition) with the rows that meet the condition."""
    if not rules:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
    counts = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (*_, cond) in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.lit(col).alias("column"),
                F.lit(severity).alias("severity"), c(f"c{i}").alias("n_bad"),
            )
            for i, (rule, col, severity, _) in enumerate(rules)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select(
        F.lit(source).alias("source"), "r.rule", "r.column", "r.severity", "r.n_bad",
        F.lit(None).cast("string").alias("sample"),
    )


def _present(df: DataFrame, spec: TableSpec):
    return [col for col in spec.columns if col.name in df.columns]


def not_null_rules(df: DataFrame, spec: TableSpec) -> list[tuple[str, str, str, Column]]:
    return [
        ("null", col.name, ERROR, c(col.name).isNull()) for col in _present(df, spec) if not col.nullable
    ]


def allowed_rules(df: DataFrame, spec: TableSpec, severity: str) -> list[tuple[str, str, str, Column]]:
    return [
        ("not_allowed", col.name, severity, not_in(c(col.name), col.allowed))
        for col in _present(df, spec)
        if col.allowed
    ]


def range_rules(df: DataFrame, spec: TableSpec, severity: str) -> list[tuple[str, str, str, Column]]:
    """Below the minimum and above the maximum.  A numeric column still typed as text is skipped."""
    kinds = dict(df.dtypes)
    rules = []
    for col in _present(df, spec):
        if kinds[col.name] == "string":
            continue
        if col.min_value is not None:
            rules.append(("below_min", col.name, severity, c(col.name) < F.lit(col.min_value)))
        if col.max_value is not None:
            rules.append(("above_max", col.name, severity, c(col.name) > F.lit(col.max_value)))
    return rules


def row_rules(df: DataFrame, spec: TableSpec, severity: str = WARNING) -> list[tuple[str, str, str, Column]]:
    """Rules over several columns.  One whose columns are absent, or not typed as it needs them, is skipped."""
    kinds = {name: kind.partition("(")[0] for name, kind in df.dtypes}
    return [
        (rule.rule, rule.reported, severity, rule.broken())
        for rule in spec.row_rules
        if all(name in kinds and (not need or kinds[name] in need) for name, need in rule.columns.items())
    ]


def counted_rules(df: DataFrame, spec: TableSpec, list_severity: str = WARNING) -> list[tuple[str, str, str, Column]]:
    """All rules of a spec that are a condition on one row."""
    return [
        *not_null_rules(df, spec),
        *allowed_rules(df, spec, list_severity),
        *range_rules(df, spec, list_severity),
        *row_rules(df, spec),
    ]


def check_rows(df: DataFrame, spec: TableSpec, severity: str = WARNING) -> DataFrame:
    """Rows that break each rule over several columns."""
    return _count_rules(df, row_rules(df, spec, severity), spec.name)


def check_not_null(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _count_rules(df, not_null_rules(df, spec), spec.name)


def check_range(df: DataFrame, spec: TableSpec, severity: str = WARNING) -> DataFrame:
    return _count_rules(df, range_rules(df, spec, severity), spec.name)


def invalid_samples(df: DataFrame, spec: TableSpec, size: int = SAMPLE_SIZE) -> DataFrame:
    """First ``size`` distinct values outside each list, as one text per column.

    Bad values are made distinct with map-side partials, and the rank filter is
    applied before the shuffle too, so no task collects all bad values.
    """
    checked = [col for col in _present(df, spec) if col.allowed]
    cells = F.array(
        *[
            F.when(not_in(c(col.name), col.allowed), F.struct(F.lit(col.name).alias("column"), c(col.name).alias("v")))
            for col in checked
        ]
    )
    bad = df.select(F.explode(F.array_compact(cells)).alias("r")).select("r.column", "r.v").distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("v"))
    kept = bad.withColumn("k", rank).filter(F.col("k") <= size)
    return kept.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("sample"))


def check_allowed(df: DataFrame, spec: TableSpec, severity: str = WARNING) -> DataFrame:
    """Values outside the allowed list: count and up to five samples; nulls are exempt."""
    counts = _count_rules(df, allowed_rules(df, spec, severity), spec.name).drop("sample")
    if not any(col.allowed for col in _present(df, spec)):
        return counts.withColumn("sample", F.lit(None).cast("string"))
    return counts.join(invalid_samples(df, spec), "column", "left").select(
        "source", "rule", "column", "severity", "n_bad", "sample"
    )


def check_castable(df: DataFrame, spec: TableSpec, severity: str = ERROR) -> DataFrame:
    """Text columns of a table that are declared otherwise: values that do not cast to the declared type."""
    kinds = dict(df.dtypes)
    rules = [
        ("wrong_type", col.name, severity, c(col.name).isNotNull() & typed_column(df, col, True).isNull())
        for col in _present(df, spec)
        if col.type != "string" and kinds[col.name] == "string"
    ]
    return _count_rules(df, rules, spec.name)


def check_unique(df: DataFrame, keys: Sequence[str], source: str = "") -> DataFrame:
    """Number of key groups with more than one row; absent key columns shorten the key."""
    present = [k for k in keys if k in df.columns]
    groups = df.groupBy(*[c(k) for k in present]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.count_if(F.col("__n") > 1).alias("n_bad")).select(
        F.lit(source).alias("source"), F.lit("duplicate_key").alias("rule"),
        F.lit(", ".join(present)).alias("column"),
        F.lit(ERROR if len(present) == len(keys) else WARNING).alias("severity"),
        "n_bad", F.lit(None).cast("string").alias("sample"),
    )


def check_table(df: DataFrame, spec: TableSpec, list_severity: str = WARNING) -> DataFrame:
    """All counted checks of a spec; null, list, range and row-rule counts share one scan."""
    rules = counted_rules(df, spec, list_severity)
    parts = [check_columns(df, spec), check_types(df, spec), _count_rules(df, rules, spec.name)]
    if spec.primary_key and any(k in df.columns for k in spec.primary_key):
        parts.append(check_unique(df, spec.primary_key, spec.name))
    return reduce(DataFrame.unionByName, parts).filter(F.col("n_bad") > 0)


def require(report: DataFrame) -> DataFrame:
    """Raise when the report has errors; return it otherwise.

    A report has one row per rule, column and source, never per data row, and
    only a first page of it goes into the message.
    """
    errors = report.filter((F.col("severity") == ERROR) & (F.col("n_bad") > 0))
    failed = errors.take(50)
    if failed:
        count = errors.count() if len(failed) == 50 else len(failed)
        raise QualityError(f"{count} findings: " + "; ".join(f"{r.source}: {r.rule} {r.column} ({r.n_bad})" for r in failed))
    return report


# --- profiles ------------------------------------------------------------------


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent of every column, in long form, from one aggregate."""
    names = df.columns
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c(n).isNull()).alias(f"c{i}") for i, n in enumerate(names)],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("column"), c(f"c{i}").alias("n_null")) for i, n in enumerate(names)])
    return totals.select("total", F.explode(rows).alias("r")).select(
        "r.column", "r.n_null", share_of(F.col("r.n_null"), F.col("total")).alias("pct_null")
    )


def change_profile(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows each cleaning rule touches, counted with the rule's own predicate."""
    return count_true(df, rules).select(
        F.col("flag").alias("rule"), F.col("cantidad").alias("n_changed"), F.col("porcentaje").alias("pct_changed")
    )


def row_loss(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows lost at each filter of a chain, all from one aggregate.

    ``steps`` maps a step name to its keep-predicate; a row counts as lost at
    the first step whose predicate is not true.
    """
    named = list(steps.items())
    lost = F.lit(len(named))
    for i, (_, keep) in reversed(list(enumerate(named))):
        lost = F.when(~F.coalesce(keep, F.lit(False)), i).otherwise(lost)
    at = df.select(lost.alias("at"))
    totals = at.agg(*[F.count_if(F.col("at") == i).alias(f"c{i}") for i in range(len(named))])
    rows = F.array(*[F.struct(F.lit(n).alias("step"), c(f"c{i}").alias("n_lost")) for i, (n, _) in enumerate(named)])
    return totals.select(F.explode(rows).alias("r")).select("r.step", "r.n_lost")


def shares(df: DataFrame, key: str) -> DataFrame:
    """Count and percent per value of ``key``.

    The total is the sum of the grouped counts.
    """
    counts = df.groupBy(c(key)).agg(F.count(F.lit(1)).alias("cantidad"))
    total = counts.agg(F.sum("cantidad").alias("total")).scalar()
    return counts.select(c(key), "cantidad", share_of(F.col("cantidad"), total).alias("porcentaje"))


def join_quality(df: DataFrame, key: str = "status_match") -> DataFrame:
    return shares(df, key)


def flag_summary(df: DataFrame, flags: Sequence[str], group: str) -> DataFrame:
    """Counts and percent per flag and per group value, in one long table."""
    by_flag = count_true(df, {f: c(f) for f in flags}).select(
        F.lit("flag").alias("kind"), F.col("flag").alias("name"), "cantidad", "porcentaje"
    )
    by_group = shares(df, group).select(
        F.lit(group).alias("kind"), c(group).alias("name"), "cantidad", "porcentaje"
    )
    return by_flag.unionByName(by_group)
