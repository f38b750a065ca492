"""Leave: two sheets, one table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, functions as F

from staffloom.functions.text import strip_dot_zero
from staffloom.names import c
from staffloom.operators.filters import filter_not_blank
from staffloom.operators.quality import ERROR, check_table, require
from staffloom.sources.layouts import promote_header
from staffloom.sources.sheets import skip_blank_key
from staffloom.specs import contracts, tables


def leave_silver(rows: DataFrame) -> DataFrame:
    """Leave rows of both sheets; the sheet gives the leave type.

    A row counts when its first cell, its reason, its document and its period
    are filled.
    """
    spec, kinds = tables.LEAVE, contracts.LEAVE_TYPES
    wanted = [n for n in spec.names if n != "TIPO_LICENCIA"]
    mine = rows.filter(F.col("sheet").isin(*kinds))
    header_row = contracts.LEAVE.sheets[0].header_row
    data = promote_header(mine, wanted, header_row, aliases=spec.renames, keep_cells=True)
    data = skip_blank_key(data, F.get(F.col("cells"), F.lit(0)))
    kind = F.create_map(*[F.lit(x) for x in chain.from_iterable(kinds.items())])
    data = data.withColumn("DNI/CEX", strip_dot_zero(c("DNI/CEX")))
    data = filter_not_blank(data, ["MOTIVO", "DNI/CEX", "PERIODO"])
    return data.select(*[c(n) for n in wanted], F.try_element_at(kind, F.col("sheet")).alias("TIPO_LICENCIA"))


def validated_leave(silver: DataFrame) -> DataFrame:
    """The table itself, after its checks passed; leave findings of any rule are errors."""
    require(check_table(silver, tables.LEAVE, list_severity=ERROR))
    return silver
