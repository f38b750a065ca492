"""Checks of landed files against a source contract, for any number of files at once.

``classified`` has one row for each file: its error, and all its problems in one array.  Three scans: the files, the sheets (two
short columns of the rows), and the header rows (their filter reaches the scan).  ``preflight`` is the same row by row, as
a report; ``sound_rows`` uses it as a filter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.functions.dates import document_date_from_filename
from staffloom.functions.text import header_key, is_blank
from staffloom.operators.quality import ERROR
from staffloom.sources.sheets import PATH, sheet_headers
from staffloom.specs import SheetContract, SourceContract

PROBLEM = "struct<rule:string,column:string,sample:string>"


def file_key(df: DataFrame) -> list[str]:
    """The columns that name a file."""
    return [*([PATH] if PATH in df.columns else []), "source_file"]


def files_of(landed: DataFrame) -> DataFrame:
    """The files of landed rows, with the error of those that could not be read."""
    error = F.max("error") if "error" in landed.columns else F.lit(None).cast("string")
    return landed.groupBy(*file_key(landed)).agg(error.alias("error"))


def _by_sheet(contract: SourceContract, value: Callable[[SheetContract], object]) -> Column:
    """What ``value`` gives for the contract of the row's sheet; null on other sheets."""
    first, *rest = contract.sheets
    out = F.when(F.col("sheet") == first.sheet, _literal(value(first)))
    for sheet in rest:
        out = out.when(F.col("sheet") == sheet.sheet, _literal(value(sheet)))
    return out


def _literal(value: object) -> Column:
    return F.array(*[F.lit(v) for v in value]).cast("array<string>") if isinstance(value, (list, tuple)) else F.lit(value)


def _problem(rule: str, column: Column, sample: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), column.cast("string").alias("column"), sample.cast("string").alias("sample"))


def _sheet_problems(contract: SourceContract) -> Column:
    """Problems of one sheet, from its name and its headers."""
    at = lambda value: _by_sheet(contract, value)
    known = F.col("sheet").isin(*[s.sheet for s in contract.sheets])
    found = F.coalesce(F.col("headers"), F.array().cast("array<string>"))
    keys = F.transform(F.filter(found, lambda h: h.isNotNull()), header_key)
    asked = F.coalesce(at(lambda s: s.required), F.array().cast("array<string>"))
    lacking = F.filter(asked, lambda n: ~F.array_contains(keys, header_key(n)))
    where = at(lambda s: f"{s.sheet} row {s.header_row} column {s.start_col + 1}")
    none = F.lit(None)
    problems = [
        F.array(F.when(known & is_blank(F.get(found, F.lit(0))), _problem("header_position", where, none))),
        F.transform(lacking, lambda n: _problem("missing_header", n, F.col("sheet"))),
    ]
    if contract.enforce_allowed_sheets:
        problems.append(F.array(F.when(~known, _problem("unexpected_sheet", F.col("sheet"), none))))
    return F.array_compact(F.concat(*problems))


def classified(files: DataFrame, rows: DataFrame, contract: SourceContract) -> DataFrame:
    """One row per file: ``error`` and ``problems``, an array of (rule, column, sample).

    ``files`` is ``(source_path, source_file, error)``, the path if it is known; ``error`` is null for a readable file.  A file
    of the wrong type has that problem only, and one that cannot be read has no problems of sheets.
    """
    at = lambda value: _by_sheet(contract, value)
    header_rows = reduce(
        Column.__or__, [(F.col("sheet") == s.sheet) & (F.col("row_idx") == s.header_row) for s in contract.sheets]
    )
    by = file_key(rows)
    headers = sheet_headers(rows.filter(header_rows), at(lambda s: s.header_row), at(lambda s: s.start_col), "run")
    no_header = F.lit(None).cast("array<string>").alias("headers")
    both = rows.select(*by, "sheet", no_header).distinct().unionByName(headers.select(*by, "sheet", "headers"))
    sheets = both.groupBy(*by, "sheet").agg(F.get(F.collect_list("headers"), F.lit(0)).alias("headers"))
    of_file = sheets.select(*by, "sheet", _sheet_problems(contract).alias("p")).groupBy(*by).agg(
        F.collect_list("sheet").alias("sheets"), F.flatten(F.collect_list("p")).alias("sheet_problems")
    )
    key = [k for k in file_key(files) if k in by]
    of_file = of_file.select(*key, "sheets", "sheet_problems")

    name, none = F.col("source_file"), F.lit(None)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    checks = []
    if contract.filename_regex:
        named = name.rlike(contract.filename_regex)
        checks.append(F.when(~named, _problem("file_name", none, name)))
        if contract.document_date:
            date = document_date_from_filename(name, contract.filename_regex)
            checks.append(F.when(named & date.isNull(), _problem("document_date", none, name)))
    checks.append(F.when(F.col("error").isNotNull(), _problem("unreadable", none, F.col("error"))))
    own = F.array_compact(F.array(*checks))
    present = F.coalesce(F.col("sheets"), F.array().cast("array<string>"))
    expected = F.array(*[F.lit(s.sheet) for s in contract.sheets])
    absent = F.transform(F.filter(expected, lambda s: ~F.array_contains(present, s)), lambda s: _problem("missing_sheet", s, none))
    nothing = F.array().cast(f"array<{PROBLEM}>")
    inside = F.when(F.col("error").isNull(), F.concat(absent, F.coalesce(F.col("sheet_problems"), nothing))).otherwise(nothing)
    problems = F.when(extension.isin(*contract.extensions), F.concat(own, inside)).otherwise(F.array(_problem("extension", none, extension)))
    joined = files.join(of_file, key, "left")
    return joined.select(*file_key(files), "error", problems.cast(f"array<{PROBLEM}>").alias("problems"))


def preflight(files: DataFrame, rows: DataFrame, contract: SourceContract) -> DataFrame:
    """Report with one row per broken rule and file."""
    each = classified(files, rows, contract).select("source_file", F.explode("problems").alias("p"))
    return each.select(
        F.col("source_file").alias("source"), "p.rule", "p.column", F.lit(ERROR).alias("severity"),
        F.lit(1).cast("long").alias("n_bad"), "p.sample",
    )


def sound_rows(files: DataFrame, rows: DataFrame, contract: SourceContract) -> DataFrame:
    """Rows of the files without a problem."""
    bad = classified(files, rows, contract).where(F.size("problems") > 0)
    key = [k for k in file_key(rows) if k in file_key(files)]
    return rows.join(bad.select(*key), key, "left_anti")
