"""Length of service, in days, years and as a label.

All arithmetic stays in DOUBLE, and "today" is always an argument, so that a
rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffloom.specs import rules


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def service_years(start: Column, end: Column, as_of: Column) -> Column:
    """Years from ``start`` to ``end``, or to ``as_of`` while there is no end date."""
    return days_between(start, F.coalesce(end, as_of)) / F.lit(rules.DAYS_PER_YEAR)


def service_text(years: Column) -> Column:
    """``"<y> años, <m> meses"``; a missing number leaves its place empty."""
    whole = F.floor(years)
    months = F.floor((years - whole) * 12)
    return F.concat_ws(
        "", whole.cast("int").cast("string"), F.lit(" años, "),
        months.cast("int").cast("string"), F.lit(" meses"),
    )


def whole_years(days: Column) -> Column:
    return F.floor(days / F.lit(rules.DAYS_PER_YEAR)).cast("int")


def remaining_months(days: Column) -> Column:
    rest = days % F.lit(rules.DAYS_PER_YEAR)
    return F.floor(rest / F.lit(rules.DAYS_PER_MONTH)).cast("int")


def term_flag(condition: Column, days: Column, low: int, high: int | None) -> Column:
    """``SI``/``NO`` for a professional intern within the day range; null without days."""
    in_range = days >= low if high is None else days.between(low, high)
    return F.when(
        days.isNotNull(),
        F.when((condition == rules.PROFESSIONAL_INTERN) & in_range, "SI").otherwise("NO"),
    )


def service_label(years: Column, months: Column, near_one: Column, near_two: Column) -> Column:
    """Readable service time; the limit labels go before the plain ones."""
    text_years, text_months = years.cast("string"), months.cast("string")
    return (
        F.when(years.isNull(), F.lit(None).cast("string"))
        .when(near_one == "SI", "1 año (En límite)")
        .when(near_two == "SI", "2 años (Límite Máximo)")
        .when(years == 0, F.concat(text_months, F.lit(" meses")))
        .when((years == 1) & (months == 0), "1 año")
        .when(years == 1, F.concat(F.lit("1 año y "), text_months, F.lit(" meses")))
        .when(months == 0, F.concat(text_years, F.lit(" años")))
        .otherwise(F.concat(text_years, F.lit(" años y "), text_months, F.lit(" meses")))
    )
