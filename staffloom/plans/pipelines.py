"""Whole pipelines: landed rows to published silver and gold tables.

Every run begins with the gate: the landed files are classified against their contract, and a run stops on problems.  Counts of
the reports come with the writes; only the uniqueness of a key reads a table again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from staffloom.operators.quality import check_unique, require
from staffloom.operators.watch import Watch
from staffloom.plans.employees import cost_centers, employee_flags, employees_silver, split_employees
from staffloom.plans.exams import exit_exams_enriched, exit_exams_gold, exit_exams_silver
from staffloom.plans.income import (
    income_employees_gold,
    income_employees_silver,
    income_interns_gold,
    income_interns_silver,
)
from staffloom.plans.interns import intern_control_gold, intern_control_silver
from staffloom.plans.leave import leave_silver, validated_leave
from staffloom.plans.payroll import mining_payroll_gold, not_earlier_output, payroll_gold, payroll_silver, payroll_with_leave, skipped_report
from staffloom.sources.layers import read_current, write_current, write_current_and_history, write_if_nonempty
from staffloom.sources.preflight import files_of, preflight
from staffloom.specs import SourceContract, TableSpec, contracts, tables


def _gate(landed: DataFrame, contract: SourceContract, files: DataFrame | None) -> DataFrame:
    """The readable rows, once no landed file breaks the contract.

    The files are those of ``landed`` (with the errors of unreadable ones, if it has a column ``error``), unless given.
    """
    rows = landed.filter("error IS NULL").drop("error") if "error" in landed.columns else landed
    require(preflight(files_of(landed) if files is None else files, rows, contract))
    return rows


def _stored(df: DataFrame, base: str) -> DataFrame:
    """Publish a layer and go on from the written table, so nothing upstream runs twice."""
    write_current(df, base)
    return read_current(df.sparkSession, base)


def _report(watch: Watch, gold: DataFrame, spec: TableSpec) -> DataFrame:
    """What the writes counted, and the one check that reads the table: its key."""
    found = watch.report(gold.sparkSession)
    if spec.primary_key:
        found = found.unionByName(check_unique(gold, spec.primary_key, spec.name))
    return found.filter("n_bad > 0")


def run_payroll(
    payroll_rows: DataFrame,
    leave_rows: DataFrame,
    base: str,
    run_ts: datetime,
    payroll_files: DataFrame | None = None,
    leave_files: DataFrame | None = None,
) -> DataFrame:
    """Payroll and leave to the enriched payroll; returns the payroll report (it never stops the run).

    The report names the payroll files that were left out for want of a period, and counts the rows left out.
    """
    payroll_rows = _gate(not_earlier_output(payroll_rows), contracts.PAYROLL, payroll_files)
    leave_rows = _gate(leave_rows, contracts.LEAVE, leave_files)
    watch = Watch()
    silver = _stored(payroll_silver(payroll_rows, watch=watch), f"{base}/silver/payroll")
    leave = validated_leave(_stored(leave_silver(leave_rows), f"{base}/silver/leave"))
    gold = _stored(watch.table(payroll_gold(silver), tables.PAYROLL), f"{base}/gold/payroll")
    write_current_and_history(payroll_with_leave(gold, leave), f"{base}/gold/payroll_with_leave", run_ts)
    return _report(watch, gold, tables.PAYROLL).unionByName(skipped_report(payroll_rows))


def run_mining_payroll(rows: DataFrame, base: str, run_ts: datetime, files: DataFrame | None = None) -> DataFrame:
    """Mining payroll; returns its report, which never stops the run."""
    rows = _gate(rows, contracts.MINING_PAYROLL, files)
    watch, spec = Watch(), tables.MINING_PAYROLL
    silver = _stored(payroll_silver(rows, spec, watch=watch), f"{base}/silver/mining_payroll")
    write_current_and_history(watch.table(mining_payroll_gold(silver), spec), f"{base}/gold/mining_payroll", run_ts)
    return _report(watch, read_current(rows.sparkSession, f"{base}/gold/mining_payroll"), spec)


def run_employees(
    rows: DataFrame, base: str, run_ts: datetime, as_of: Column, files: DataFrame | None = None
) -> DataFrame:
    """Employee master: silver, cost centres, gold split, flags; returns the report of the employees.

    Document numbers that repeat stop the run before the flags.
    """
    rows = _gate(rows, contracts.EMPLOYEES, files)
    spark, watch, spec = rows.sparkSession, Watch(), tables.EMPLOYEES
    centers = [n for n in tables.COST_CENTERS.names if n not in spec.names]
    silver = _stored(employees_silver(rows, extra=centers), f"{base}/silver/employees")
    write_current_and_history(
        cost_centers(silver, ["source_file", "row_idx"]), f"{base}/gold/cost_centers", run_ts
    )
    employees, interns = split_employees(silver)
    written = write_if_nonempty(watch.table(employees, spec), f"{base}/gold/employees", run_ts)
    write_if_nonempty(interns, f"{base}/gold/interns", run_ts)
    if written:
        gold = read_current(spark, f"{base}/gold/employees")
        require(check_unique(gold, spec.primary_key, spec.name))
        write_current_and_history(employee_flags(gold, as_of), f"{base}/gold/employee_flags", run_ts)
    return watch.report(spark)


def run_income(rows: DataFrame, base: str, run_ts: datetime, files: DataFrame | None = None) -> DataFrame:
    """Both income tables; returns their report: rows changed by cleaning, and broken rules."""
    rows = _gate(rows, contracts.INCOME, files)
    report = None
    for name, to_silver, to_gold, spec in (
        ("income_employees", income_employees_silver, income_employees_gold, tables.INCOME_EMPLOYEES),
        ("income_interns", income_interns_silver, income_interns_gold, tables.INCOME_INTERNS),
    ):
        watch = Watch()
        silver = _stored(to_silver(rows, watch=watch), f"{base}/silver/{name}")
        write_current_and_history(watch.table(to_gold(silver), spec), f"{base}/gold/{name}", run_ts)
        found = _report(watch, read_current(rows.sparkSession, f"{base}/gold/{name}"), spec)
        report = found if report is None else report.unionByName(found)
    return report


def run_interns(rows: DataFrame, base: str, run_ts: datetime, files: DataFrame | None = None) -> DataFrame:
    """Intern control; returns the report of its silver table, which never stops the run."""
    rows = _gate(rows, contracts.INTERNS, files)
    watch = Watch()
    silver = _stored(watch.table(intern_control_silver(rows), tables.INTERN_CONTROL), f"{base}/silver/intern_control")
    write_current_and_history(intern_control_gold(silver), f"{base}/gold/intern_control", run_ts)
    return watch.report(rows.sparkSession)


def run_exit_exams(
    rows: DataFrame, current: DataFrame, old: DataFrame, base: str, run_ts: datetime, files: DataFrame | None = None
) -> DataFrame:
    """Exit exams and their cost centres; returns the report of the exams."""
    rows = _gate(rows, contracts.EXIT_EXAMS, files)
    watch, spec = Watch(), tables.EXIT_EXAMS
    silver = _stored(exit_exams_silver(rows), f"{base}/silver/exit_exams")
    write_current_and_history(watch.table(exit_exams_gold(silver), spec), f"{base}/gold/exit_exams", run_ts)
    gold = read_current(rows.sparkSession, f"{base}/gold/exit_exams")
    write_current_and_history(exit_exams_enriched(gold, current, old), f"{base}/gold/exit_exams_enriched", run_ts)
    return _report(watch, gold, spec)
