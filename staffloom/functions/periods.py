"""Payroll periods: ``YYYY-MM`` text, year text and month number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffloom.functions.text import INTEGER_TEXT


def make_period(year: Column, month: Column) -> Column:
    """``year-month`` with a month of at least two digits; null if either is null."""
    month = month.cast("string")
    padded = F.when(F.length(month) < 2, F.lpad(month, 2, "0")).otherwise(month)
    return F.concat(year.cast("string"), F.lit("-"), padded)


def period_year(col: Column) -> Column:
    return F.substring(col, 1, 4)


def period_month(col: Column) -> Column:
    """Month number (int) of a period; null when it is not a number."""
    month = F.substring(col, 6, 2)
    return F.when(month.rlike(INTEGER_TEXT), month.try_cast("int"))
