"""Employee master, its flags, and the cost-centre catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.functions.dates import ddmmyyyy_to_iso, document_date_from_filename
from staffloom.functions.flags import age_flag, contract_alert
from staffloom.functions.service import service_text, service_years
from staffloom.functions.text import null_tokens
from staffloom.names import c
from staffloom.operators.aggregates import dedup_keep_first
from staffloom.operators.casting import cast_spec
from staffloom.operators.filters import split_by
from staffloom.operators.projection import select_spec
from staffloom.sources.layouts import FIRST_BLANK, Sheets, discover, first_with_words
from staffloom.specs import contracts, rules, tables

DOCUMENT, DOCUMENT_DATE = "NUMERO DE DOC", "FECHA_DOCUMENTO"


def employee_sheets(rows: DataFrame) -> Sheets:
    """The layouts of the employee sheets, whose data ends at the first blank document number.

    The document's header is the first one with both words, in any case; a sheet without one is an error.
    """
    sheet = contracts.EMPLOYEES.sheets[0]
    mine = rows.filter(F.col("sheet") == sheet.sheet)
    key = first_with_words(*rules.DOCUMENT_WORDS)
    return discover(mine, sheet.header_row, sheet.start_col, "first_blank", key, FIRST_BLANK).require_key(DOCUMENT)


def employees_silver(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Sheet rows up to the first blank document number, as clean text: declared columns, then those of any other header.

    ``extra`` names headers that are columns even if no file has them.
    """
    contract = contracts.EMPLOYEES
    sheets = employee_sheets(rows)
    wanted = [*[n for n in tables.EMPLOYEES.names if n != DOCUMENT_DATE], *extra]
    wanted += sheets.undeclared(wanted, [DOCUMENT_DATE])
    data = sheets.table(wanted, keyed=DOCUMENT)
    return data.select(
        "source_file",
        "row_idx",
        *[null_tokens(ddmmyyyy_to_iso(c(n))).alias(n) for n in wanted],
        document_date_from_filename(F.col("source_file"), contract.filename_regex).alias(DOCUMENT_DATE),
    )


def employees_typed(silver: DataFrame) -> DataFrame:
    """Spec columns in source order, dates typed."""
    kept = select_spec(silver, tables.EMPLOYEES, order="source")
    return cast_spec(kept, tables.EMPLOYEES, fraction=False)


def is_intern() -> Column:
    return c("Modalidad de Contrato").contains(rules.INTERN_CONTRACT)


def split_employees(silver: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(employees, interns); rows without a contract type are in neither."""
    interns, employees = split_by(employees_typed(silver), is_intern())
    return employees, interns


def employees_gold(silver: DataFrame) -> DataFrame:
    return split_employees(silver)[0]


def interns_gold(silver: DataFrame) -> DataFrame:
    return split_employees(silver)[1]


def employee_flags(
    employees: DataFrame,
    as_of: Column,
    age_rules: Sequence[rules.AgeRule] = rules.AGE_RULES,
    contract_rules: Sequence[rules.ContractRule] = rules.CONTRACT_RULES,
) -> DataFrame:
    """All columns, plus service time and one boolean per rule.

    One projection without a shuffle.  Document numbers must be unique
    (``check_unique``); a row without one gets null flags.
    """
    years = service_years(c("FECH_INGR."), c("Fecha de Termino"), as_of)
    flags = {
        "tiempo_servicio_texto": service_text(years),
        **{r.column: age_flag(c("FECHA DE NAC."), as_of, r) for r in age_rules},
        **{r.column: contract_alert(c("Modalidad de Contrato"), years, r) for r in contract_rules},
    }
    known = c("NUMERO DE DOC").isNotNull()
    return employees.select("*", *[F.when(known, value).alias(name) for name, value in flags.items()])


def flag_columns() -> list[str]:
    return [r.column for r in (*rules.AGE_RULES, *rules.CONTRACT_RULES)]


def cost_centers(silver: DataFrame, order: Sequence[str] = ("row_idx",)) -> DataFrame:
    """One row per cost-centre code, the first in source order, sorted by code."""
    spec = tables.COST_CENTERS
    select_spec(silver, spec, missing="error")
    source = silver.select(*[c(n) for n in [*spec.names, *order]])
    first = dedup_keep_first(source, spec.primary_key[0], list(order))
    return first.select(*[c(n) for n in spec.names]).orderBy(c(spec.primary_key[0]))
