"""Layers that are bucketed by a key once, so that joins, grouped texts and uniqueness by that key run without a shuffle.

Payroll and leave meet on person and period every month, over the whole history.  Written in buckets, each of these jobs reads
its bucket's files and nothing travels; only the month that is new was shuffled, when it was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from staffloom.names import q


#: Rows that one bucket holds at most, if the keys are spread: a task sorts or groups them in some hundred megabytes.
ROWS_PER_BUCKET = 1 << 21
LEAST_BUCKETS = 8


def buckets_for(*layers: DataFrame) -> int:
    """A number of buckets for layers that are to meet: a power of two that grows with the rows of the largest.

    A task works on one bucket, so its memory stays the same when the layers grow.
    """
    rows, buckets = max(layer.count() for layer in layers), LEAST_BUCKETS
    while buckets * ROWS_PER_BUCKET < rows:
        buckets *= 2
    return buckets


def bucketed_name(name: str) -> str:
    """A table name of its own for the session's catalogue."""
    return f"{name}_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, name: str = "layer") -> DataFrame:
    """Write ``df`` to ``path`` (which must be new) in ``buckets`` by ``keys``, sorted, and give it back as a table.

    Rows are dealt by the keys before they are written, so each bucket is one file.  Tables that are to meet need the same keys in
    the same order, and the same number of buckets: enough for the layer's final size, as it is fixed (``buckets_for``).
    """
    table = bucketed_name(name)
    dealt = df.repartition(buckets, *[df[q(k)] for k in keys])
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int, name: str = "layer") -> DataFrame:
    """A layer that ``write_bucketed`` wrote in another session: the buckets are known from the files' names."""
    table, by = bucketed_name(name), ", ".join(q(k) for k in keys)
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)
