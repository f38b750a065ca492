"""Headers of sheets, and rules for their rows.

``bronze_rows`` is ``(source_path, source_file, sheet, row_idx, cells array<string>)``;
the full path, which tells files of one name apart, may be absent.  Row numbers
are 1-based as in the spreadsheet.  A run of blank rows is there with its first
row; the others may be absent.  No operator relies on file or partition order:
order always means ``row_idx``.

Facts about very many sheets are joined to their rows on the sheet and a
``chunk``: fixed stretches of row numbers are dealt over ``CHUNKS`` numbers in
turn.  A sheet with a third of all rows is so split over many tasks, and its
facts are repeated ``CHUNKS`` times, without a look at the rows.
``staffloom.sources.layouts`` turns rows into tables with named columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.functions.text import FLOAT_TEXT, is_blank, normalize_header
from staffloom.specs import rules

BRONZE_SCHEMA = "source_file string, sheet string, row_idx long, cells array<string>"
PATH = "source_path"
CHUNK_ROWS = 65_536
CHUNKS = 16  # a full spreadsheet of 1,048,576 rows has one stretch per number

_CHUNK = "chunk"


def sheet_key(rows: DataFrame) -> list[str]:
    """The columns that name a sheet: the full path, where it is known, tells files of one name apart."""
    return [*([PATH] if PATH in rows.columns else []), "source_file", "sheet"]


def _stretch(row: str) -> Column:
    return F.expr(f"{row} div {CHUNK_ROWS}L")


def with_chunk(rows: DataFrame) -> DataFrame:
    """Rows with their ``chunk``, which is kept when it is there."""
    return rows if _CHUNK in rows.columns else rows.withColumn(_CHUNK, F.pmod(_stretch("row_idx"), F.lit(CHUNKS)))


def join_sheet_facts(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Give every row of ``with_chunk`` the facts of its sheet; ``facts`` has one row per sheet."""
    chunks = F.sequence(F.lit(0).cast("long"), F.lit(CHUNKS - 1).cast("long"))
    return rows.join(facts.withColumn(_CHUNK, F.explode(chunks)), [*sheet_key(rows), _CHUNK], how)


# --- headers --------------------------------------------------------------------


def header_end(names: Column, stop: str) -> Column:
    """Header names up to where the stop rule ends the header; later ones become absent."""
    gaps = F.filter(
        F.transform(names, lambda name, i: F.when(name.isNull(), i)), lambda i: i.isNotNull()
    )
    if stop == "first_blank":
        end = F.try_element_at(gaps, F.lit(1))
    elif stop == "gap":  # the fourth empty cell ends the header
        end = F.try_element_at(gaps, F.lit(4))
    elif stop == "run":  # three empty cells in a row, once the header has begun
        first = F.try_element_at(
            F.filter(F.transform(names, lambda n, i: F.when(n.isNotNull(), i)), lambda i: i.isNotNull()),
            F.lit(1),
        )
        end = F.try_element_at(
            F.filter(
                gaps,
                lambda i: (i > first) & F.array_contains(gaps, i + 1) & F.array_contains(gaps, i + 2),
            ),
            F.lit(1),
        )
    elif stop == "skip_blank":
        return names
    else:
        raise ValueError(f"unknown stop rule {stop!r}")
    return F.slice(names, F.lit(1), F.coalesce(end, F.size(names)))


def sheet_headers(
    rows: DataFrame,
    header_row: int | Column,
    start_col: int | Column = 0,
    stop: str = "skip_blank",
) -> DataFrame:
    """One row per sheet: ``headers``, an array with the name (or null) at each cell position.

    Position 0 is ``start_col``.  The filter on the row number reaches the scan.
    """
    cells = F.col("cells")
    window = F.slice(cells, F.lit(start_col) + 1, F.greatest(F.size(cells) - start_col, F.lit(0)))
    names = F.transform(window, lambda v: F.when(~is_blank(v), normalize_header(v)))
    by = sheet_key(rows)
    heads = rows.filter(F.col("row_idx") == header_row).select(*by, names.alias("headers"))
    return heads.select(*by, header_end(F.col("headers"), stop).alias("headers"))


def header_scan(rows: DataFrame, header_row: int, start_col: int = 0) -> DataFrame:
    """Long form of the header: one row per non-empty header cell, with its position."""
    headers = sheet_headers(rows, header_row, start_col, "run")
    return headers.select(*sheet_key(rows), F.posexplode("headers").alias("pos", "header")).filter(
        F.col("header").isNotNull()
    )


# --- row rules -------------------------------------------------------------------


def skip_blank_key(df: DataFrame, key: Column) -> DataFrame:
    """Drop rows with a blank key, and go on after them."""
    return df.filter(~is_blank(key))


def is_footer(cells: Column, max_len: int = rules.FOOTER_LENGTH) -> Column:
    """A first cell of more than ``max_len`` characters that is no number: a title or a total, not data."""
    first = F.get(cells, F.lit(0))
    return F.coalesce((F.length(first) > max_len) & ~first.rlike(FLOAT_TEXT), F.lit(False))


def is_data_row(cells: Column, max_len: int = rules.FOOTER_LENGTH) -> Column:
    """A first cell that is there and no footer."""
    return F.get(cells, F.lit(0)).isNotNull() & ~is_footer(cells, max_len)


def drop_non_data_rows(rows: DataFrame, max_len: int = rules.FOOTER_LENGTH) -> DataFrame:
    return rows.filter(is_data_row(F.col("cells"), max_len))
