"""Text cleaning as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from staffloom.specs import rules

# The characters with the Unicode White_Space property.  ``btrim`` with this list
# only looks at both ends of the text, unlike a regular expression.
WHITESPACE = "".join(
    map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

INTEGER_TEXT = r"^[+-]?[0-9]+\z"
FLOAT_TEXT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def _begins_visibly(col: Column) -> Column:
    """The first character is an ASCII one that shows: one comparison of bytes at each end."""
    return (col >= "!") & (col < "\x7f")


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends; text that shows at both ends is not looked at further."""
    plain = _begins_visibly(col) & _begins_visibly(F.substring(col, -1, 1))
    return F.when(plain, col).otherwise(F.btrim(col, F.lit(WHITESPACE)))


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text; never null."""
    filled = F.coalesce(_begins_visibly(col), F.lit(False))
    return ~(filled | F.coalesce(F.length(F.btrim(col, F.lit(WHITESPACE))) > 0, F.lit(False)))


def normalize_header(col: Column) -> Column:
    """Strip, and make every run of white space (line breaks too) one space."""
    return F.regexp_replace(strip(col), r"(?U)\s+", " ")


def header_key(col: Column) -> Column:
    """Form in which two headers are compared."""
    return F.upper(normalize_header(col))


def null_tokens(col: Column, tokens: Sequence[str] = rules.NULL_TOKENS) -> Column:
    """Textual nulls left by other tools become real nulls."""
    return F.when(~col.isin(*tokens), col)


def error_cells_to_null(col: Column) -> Column:
    """Spreadsheet error cells (``#N/A``, ``#REF!``, ...) become null."""
    return F.when(~col.startswith("#"), col)


def is_sentinel(col: Column) -> Column:
    """True where a system code holds an error marker; null for null."""
    hit = F.lower(col).contains(rules.SAP_SENTINEL_ANY_CASE)
    for token in rules.SAP_SENTINELS:
        hit = hit | col.contains(token)
    return hit


def sentinel_to_null(col: Column) -> Column:
    return F.when(~is_sentinel(col), col)


def needs_default(col: Column) -> Column:
    """True for null, blank or exactly ``0``."""
    return is_blank(col) | F.coalesce(col == "0", F.lit(False))


def default_if_blank(col: Column, value: str = rules.DEFAULT_PROJECT) -> Column:
    return F.when(needs_default(col), F.lit(value)).otherwise(col)


def impute(col: Column, value: str = rules.DEFAULT_SERVICE) -> Column:
    """Null or empty (not blank) text becomes ``value``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(value))


def fill_null(col: Column, value: str) -> Column:
    return F.coalesce(col, F.lit(value))


def strip_dot_zero(col: Column) -> Column:
    """Drop the ``.0`` a document number gets when it was stored as a float."""
    return F.when(col.endswith(".0"), F.substring(col, F.lit(1), F.length(col) - 2)).otherwise(col)


def number_to_text(col: Column) -> Column:
    """Double as text: no decimals when whole, else at most six without trailing zeros."""
    fixed = F.coalesce(
        col.try_cast("decimal(28,6)").cast("string"),
        F.when(col.isNotNull(), F.format_string("%.6f", col)),
    )
    return F.when(
        (col == F.floor(col)) & (F.abs(col) < 9e18), col.cast("long").cast("string")
    ).otherwise(F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit(".")))


def float_text_to_text(col: Column) -> Column:
    """``number_to_text`` for cells that landed as float text; other text is kept."""
    is_float = col.rlike(FLOAT_TEXT) & col.rlike("[.eE]")
    return F.when(is_float, number_to_text(col.try_cast("double"))).otherwise(col)


def whole_float_text(col: Column) -> Column:
    """Float text with a whole value loses its decimals; other text is kept."""
    value = F.when(col.rlike(FLOAT_TEXT) & col.rlike("[.eE]"), col.try_cast("double"))
    whole = (value == F.floor(value)) & (F.abs(value) < 9e18)
    return F.when(whole, value.cast("long").cast("string")).otherwise(col)
