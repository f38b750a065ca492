"""Rules over several columns of one row, each as the condition that a row breaks.  Nulls break no rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from staffloom.names import c

NUMBERS = ("bigint", "int", "double", "float", "decimal")


@dataclass(frozen=True)
class After:
    """``later`` comes after ``earlier`` (both dates)."""

    later: str
    earlier: str
    rule = "not_after"

    @property
    def columns(self) -> dict[str, tuple[str, ...]]:
        return {self.later: ("date",), self.earlier: ("date",)}

    @property
    def reported(self) -> str:
        return f"{self.later}, {self.earlier}"

    def broken(self) -> Column:
        return c(self.later) <= c(self.earlier)


@dataclass(frozen=True)
class WithinPeriod:
    """A date lies in or before the month that a ``yyyy-MM`` column names."""

    date: str
    period: str
    rule = "after_period"

    @property
    def columns(self) -> dict[str, tuple[str, ...]]:
        return {self.date: ("date",), self.period: ("string",)}

    @property
    def reported(self) -> str:
        return f"{self.date}, {self.period}"

    def broken(self) -> Column:
        return F.date_format(c(self.date), "yyyy-MM") > c(self.period)


@dataclass(frozen=True)
class OnlyWith:
    """A filled column needs another one."""

    column: str
    needs: str
    rule = "without"

    @property
    def columns(self) -> dict[str, tuple[str, ...]]:
        return {self.column: (), self.needs: ()}

    @property
    def reported(self) -> str:
        return f"{self.column}, {self.needs}"

    def broken(self) -> Column:
        return (F.trim(c(self.column).cast("string")) != "") & c(self.needs).isNull()


@dataclass(frozen=True)
class Balance:
    """``total`` is ``plus`` less ``minus``, within a tolerance."""

    total: str
    plus: str
    minus: str
    tolerance: float
    rule = "no_balance"

    @property
    def columns(self) -> dict[str, tuple[str, ...]]:
        return dict.fromkeys((self.total, self.plus, self.minus), NUMBERS)

    @property
    def reported(self) -> str:
        return self.total

    def broken(self) -> Column:
        return F.abs(c(self.total) - (c(self.plus) - c(self.minus))) > F.lit(self.tolerance)


@dataclass(frozen=True)
class NotNegative:
    """An amount is zero or more."""

    column: str
    rule = "negative"

    @property
    def columns(self) -> dict[str, tuple[str, ...]]:
        return {self.column: NUMBERS}

    @property
    def reported(self) -> str:
        return self.column

    def broken(self) -> Column:
        return c(self.column) < 0


@dataclass(frozen=True)
class Pattern:
    """A text matches a regular expression as a whole."""

    column: str
    regex: str
    rule = "pattern"

    @property
    def columns(self) -> dict[str, tuple[str, ...]]:
        return {self.column: ("string",)}

    @property
    def reported(self) -> str:
        return self.column

    def broken(self) -> Column:
        return ~c(self.column).rlike(rf"\A(?:{self.regex})\z")


@dataclass(frozen=True)
class OneOf:
    """A text is one of ``values``, or holds one of ``parts``."""

    column: str
    values: tuple[str, ...]
    parts: tuple[str, ...] = ()
    rule = "no_rule"

    @property
    def columns(self) -> dict[str, tuple[str, ...]]:
        return {self.column: ("string",)}

    @property
    def reported(self) -> str:
        return self.column

    def broken(self) -> Column:
        known = c(self.column).isin(*self.values)
        for part in self.parts:
            known = known | c(self.column).contains(part)
        return ~known


RowRule = After | WithinPeriod | OnlyWith | Balance | NotNegative | Pattern | OneOf
