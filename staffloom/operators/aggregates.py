"""Aggregates that combine on the map side, so a hot group never meets one task whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from staffloom.names import c
from staffloom.specs import rules

_N, _PAIR = "__c", "__pair"
#: Row numbers of a sheet are below this (a spreadsheet has 2^20 rows; a bronze sheet may have more).
_ROWS_PER_FILE = 1 << 34


def joined_text(pairs: Column, sep: str) -> Column:
    """Ordered text of ``array<struct<v, n>>``, every value written ``n`` times."""

    def written(pair: Column) -> Column:
        value, times = pair.getField("v"), pair.getField("n")
        return F.concat(F.repeat(F.concat(value, F.lit(sep)), times.cast("int") - 1), value)

    return F.array_join(F.transform(F.sort_array(pairs), written), sep)


def string_agg_ordered(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    outputs: Mapping[str, Column],
    sep: str = rules.REASON_SEPARATOR,
) -> DataFrame:
    """Sorted, separated text of ``value`` per key, once per filter in ``outputs``.

    Duplicates are kept and nulls ignored; a group without values gives null.
    Equal values are counted first, with map-side partials, so the second step
    collects only distinct (value, count) pairs: never more than the text it
    has to write.  All outputs come from one scan and one pair of shuffles.
    """
    named = list(outputs.items())
    marks = [F.count_if(cond & c(value).isNotNull()).alias(f"{_N}{i}") for i, (_, cond) in enumerate(named)]
    counted = df.groupBy(*[c(k) for k in keys], c(value)).agg(*marks)
    lists = [
        F.collect_list(F.when(c(f"{_N}{i}") > 0, F.struct(c(value).alias("v"), c(f"{_N}{i}").alias("n")))).alias(
            name
        )
        for i, (name, _) in enumerate(named)
    ]
    grouped = counted.groupBy(*[c(k) for k in keys]).agg(*lists)
    return grouped.select(
        *[c(k) for k in keys],
        *[F.when(F.size(c(name)) > 0, joined_text(c(name), sep)).alias(name) for name, _ in named],
    )


def filtered_count(df: DataFrame, keys: Sequence[str], outputs: Mapping[str, Column]) -> DataFrame:
    """Several filtered counts per key in one scan."""
    return df.groupBy(*[c(k) for k in keys]).agg(*[F.count_if(cond).alias(n) for n, cond in outputs.items()])


def row_mark(names: Sequence[str]) -> Column:
    """A number below 2^60 that tells rows apart by their values: the first 15 digits of the md5 of all of them as text."""
    fields = []
    for name in names:
        text = c(name).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.conv(F.substring(F.md5(F.concat(*fields).cast("binary")), 1, 15), 16, 10).cast("long")


def first_rows(df: DataFrame, key: str, order: str, names: Sequence[str]) -> DataFrame:
    """Per key, the row with the least ``order`` (a column of whole numbers); rows that tie are told apart by ``row_mark``.

    The least order of a key is a hash aggregate of one number, with partials before the shuffle, and texts stay out of it.
    A semi-join then fetches the rows that have it, which are few; where a key has several, Spark keeps one of each task
    before it shuffles them.  Null is a key of its own, and an order before all others only where a key has no other.
    """
    best = df.groupBy(c(key)).agg(F.min(c(order)).alias("__least")).select(c(key).alias("__key"), "__least")
    won = df.join(best, c(key).eqNullSafe(F.col("__key")) & c(order).eqNullSafe(F.col("__least")), "left_semi")
    place = F.row_number().over(Window.partitionBy(c(key)).orderBy(F.col("__mark")))
    picked = won.select(*[c(n) for n in dict.fromkeys([key, *names])], row_mark(names).alias("__mark"))
    return picked.withColumn("__place", place).filter(F.col("__place") == 1).drop("__mark", "__place")


def dedup_keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes first by ``order``, columns of whole numbers or text (see ``first_rows``).

    Text columns of the order are numbered first, by their distinct values: files, of which there are few against their rows.
    """
    names, place = df.columns, None
    for i, name in enumerate(order):
        if dict(df.dtypes)[name] == "string":
            values = df.select(c(name)).distinct()
            numbered = values.select(c(name).alias("__value"), F.row_number().over(Window.orderBy(c(name))).alias(f"__n{i}"))
            df = df.join(numbered, c(name).eqNullSafe(F.col("__value"))).drop("__value")
        else:
            df = df.withColumn(f"__n{i}", c(name))
        own = F.col(f"__n{i}").cast("long")
        place = own if place is None else place * _ROWS_PER_FILE + own
    return first_rows(df.withColumn("__order", place), key, "__order", names).select(*[c(n) for n in names])


def first_value_by_priority(
    df: DataFrame, key: str, values: Mapping[str, str], priority: str
) -> DataFrame:
    """Per key, the values of the row with the highest priority (nulls respected).

    ``values`` maps source to output name.  Rows that tie on priority are told apart by the mark of their values.
    """
    best = first_rows(df.withColumn("__order", -c(priority)), key, "__order", list(values))
    return best.select(c(key), *[c(n).alias(out) for n, out in values.items()])


def group_count(df: DataFrame, keys: Sequence[str], name: str = "cantidad") -> DataFrame:
    counted = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))
    return counted.orderBy(c(name).desc(), *[c(k) for k in keys])


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    return df.groupBy(c(col)).agg(F.count(F.lit(1)).alias(name)).orderBy(c(col))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(c(col)).distinct().orderBy(c(col))


def select_distinct(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[c(n) for n in names]).distinct()


def count_distinct(df: DataFrame, col: str, name: str = "n_distinct", null_is_value: bool = True) -> DataFrame:
    """Number of distinct values; null counts as one of them, as in the source system."""
    distinct = df.select(c(col).alias("v")).distinct()
    return distinct.agg((F.count(F.lit(1)) if null_is_value else F.count("v")).alias(name))


def share_of(part: Column, total: Column) -> Column:
    """Percent with two decimals, 0 for an empty table."""
    return F.when(total > 0, F.round(part / total * 100, 2)).otherwise(F.lit(0.0))


def count_true(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Rows and percent per condition, in long form, from one aggregate."""
    named = list(conditions.items())
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(named)],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("name"), c(f"c{i}").alias("n")) for i, (n, _) in enumerate(named)])
    return totals.select("total", F.explode(rows).alias("r")).select(
        c("r").getField("name").alias("flag"),
        c("r").getField("n").alias("cantidad"),
        share_of(c("r").getField("n"), F.col("total")).alias("porcentaje"),
    )
