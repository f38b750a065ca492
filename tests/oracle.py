"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb

from staffloom.registry import ORACLES, QUERIES
from staffloom.registry.views import BASE


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


SIZES: dict[str, int] = {}


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
}


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when rows, names and types agree, else what differs."""
    df = QUERIES[name](spark, folder)
    got_names, got = bag(df.columns, [tuple(r) for r in df.collect()])
    SIZES[name] = sum(got.values())
    if name not in ORACLES:
        return None
    rel = con.sql(ORACLES[name])
    want_names, want = bag(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {list(extra.items())[:3]}; "
            f"only SQL {list(lacking.items())[:3]}"
        )
    kinds = {n: SPARK_TO_DUCK.get(k, k) for n, k in df.dtypes}
    other = {n: str(k) for n, k in zip(rel.columns, rel.types)}
    uneven = {n: (kinds[n], other[n]) for n in kinds if kinds[n] != other[n]}
    return f"types {uneven}" if uneven else None


def main(folder: str, names: list[str]) -> int:
    from tests.conftest import make_session

    spark, con, bad = make_session(), connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} {SIZES.get(name)} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
