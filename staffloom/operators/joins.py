"""Left joins; skewed keys are left to Spark's adaptive execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from staffloom.names import c


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left LEFT JOIN right USING (keys)``: the left columns, then the right ones besides the keys.

    Neither side is hinted or repartitioned: Spark broadcasts the right side
    when its measured size is under the session's threshold, and else may split
    a hot key's left rows over many tasks (``session.RECOMMENDED`` turns that on).
    """
    joined = left.join(right, [*keys], "left")
    return joined.select(*[left[f"`{n}`"] for n in left.columns], *[c(n) for n in right.columns if n not in set(keys)])


#: Shares over which rows without a code are dealt.
SHARES = 1024
_SHARE = "__share"


def lookup_join(left: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """:func:`left_join` on a code (text) that many rows lack: more than half of the exams have a blank one.

    Rows with a blank or null code are dealt over ``SHARES`` by a hash of their values, so they never meet in one task.
    Catalogue rows with a blank code, of which there is one at most in a catalogue by code, go to every share.
    """
    code, one, last = c(key), F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")
    lacking = code.isNull() | (code == "")
    dealt = left.withColumn(_SHARE, F.when(lacking, F.pmod(F.xxhash64(*[c(n) for n in left.columns]), F.lit(SHARES))).otherwise(one))
    shares = F.when(code == "", F.sequence(one, last)).otherwise(F.array(one))
    return left_join(dealt, catalog.withColumn(_SHARE, F.explode(shares)), [key, _SHARE]).drop(_SHARE)


def match_status(code: Column, matched: Column) -> Column:
    """Outcome of a catalogue lookup: blank code, unknown (or null) code, or found."""
    return F.when(code == "", "SIN_CODIGO").when(matched.isNull(), "CODIGO_NO_ENCONTRADO").otherwise("OK")
