"""Dates out of text, file names and spreadsheet serial numbers.

All parsers test the shape with one regular expression and leave the calendar
check to ``try_cast``: a bad value is null, and no row pays for an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staffloom.functions.text import strip
from staffloom.specs import rules

_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
STAMP_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} " + _CLOCK + r"\z"
STAMP_FRACTION_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} " + _CLOCK + r"(?:\.[0-9]+)?\z"
ISO_DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DAY_FIRST_SLASH = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z"

# --- fixed values: accepted text forms of an intern date ---
YEAR_FIRST = r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})\z"  # Y-m-d, Y/m/d
DAY_FIRST = r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})\z"  # d-m-Y, d/m/Y, d.m.Y
SERIAL = r"^-?[0-9]{1,7}(?:\.[0-9]+)?\z"
MIN_SERIAL, MAX_SERIAL = -693593, 2958465  # 0001-01-01 and 9999-12-31

DATE_FRAGMENT = r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.when(year != "0000", F.concat_ws("-", year, month, day).try_cast("date"))


def parse_stamp(col: Column, fraction: bool = True) -> Column:
    """``YYYY-MM-DD HH:MM:SS[.f]`` text to date; anything else, date-only text too, is null."""
    pattern = STAMP_FRACTION_TEXT if fraction else STAMP_TEXT
    return F.when(col.rlike(pattern), F.substring(col, 1, 10).try_cast("date"))


def parse_stamp_or_date(col: Column) -> Column:
    """``parse_stamp`` that takes plain ``YYYY-MM-DD`` as well."""
    shape = col.rlike(STAMP_TEXT) | col.rlike(ISO_DATE_TEXT)
    return F.when(shape, F.substring(col, 1, 10).try_cast("date"))


def ddmmyyyy_to_iso(col: Column) -> Column:
    """``d/m/yyyy`` text to ``YYYY-MM-DD 00:00:00`` text; other or impossible text is kept."""
    text = strip(col)
    turned = F.regexp_replace(text, DAY_FIRST_SLASH, "$3-$2-$1").try_cast("date")
    iso = F.concat(turned.cast("string"), F.lit(" 00:00:00"))
    # few cells hold a slash: the others are not matched at all
    return F.when(F.contains(col, F.lit("/")) & text.rlike(DAY_FIRST_SLASH), F.coalesce(iso, text)).otherwise(text)


def parse_excel_date(col: Column) -> Column:
    """Serial number, landed timestamp or one of five text forms to date, else null."""
    text = strip(col)
    first = lambda p, i: F.regexp_extract(text, p, i)
    serial = F.when(text.rlike(SERIAL), text.try_cast("double").cast("int"))
    from_serial = F.when(
        serial.between(MIN_SERIAL, MAX_SERIAL),
        F.date_add(F.lit(rules.EXCEL_EPOCH).cast("date"), serial),
    )
    return F.coalesce(
        F.when(
            text.rlike(YEAR_FIRST),
            _date(first(YEAR_FIRST, 1), first(YEAR_FIRST, 3), first(YEAR_FIRST, 4)),
        ),
        F.when(
            text.rlike(DAY_FIRST),
            _date(first(DAY_FIRST, 4), first(DAY_FIRST, 3), first(DAY_FIRST, 1)),
        ),
        from_serial,
        parse_stamp(text),
    )


def year_of(col: Column) -> Column:
    return F.year(col)


def month_of(col: Column) -> Column:
    return F.month(col)


def month_name(col: Column, default: str | None = None) -> Column:
    """Month number to its English name; null and numbers outside 1-12 give ``default``."""
    names = F.array(*[F.lit(name) for name in rules.MONTH_NAMES])
    number = F.when(col.between(1, len(rules.MONTH_NAMES)), col.cast("int"))
    return F.coalesce(F.try_element_at(names, number), F.lit(default))


def period_from_filename(col: Column) -> Column:
    """First ``YYYY-MM`` in a file name, null when there is none."""
    return F.nullif(F.regexp_extract(col, r"([0-9]{4}-[0-9]{2})", 1), F.lit(""))


def document_date_from_filename(col: Column, pattern: str) -> Column:
    """Document date as ``YYYY-MM-DD`` text; group 1 of ``pattern`` is ``dd.mm.yyyy``.

    Null when the name does not match or the day does not exist.
    """
    raw = F.regexp_extract(col, pattern, 1)
    parsed = _date(F.substring(raw, 7, 4), F.substring(raw, 4, 2), F.substring(raw, 1, 2))
    return F.when(F.length(raw) == 10, parsed.cast("string"))


def has_document_date_fragment(col: Column) -> Column:
    return col.rlike(DATE_FRAGMENT)
