"""Silver and gold tables on shared storage, published by a pointer.

A published table is a folder with its versions and a ``manifest``, one small file for each version that counts.  A version is
written whole before its line of the manifest is, and a reader takes the version of the last line: it sees the old table
or the new one, never a part, also when a run fails half way or while another one reads.  One run writes a table at a time.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from staffloom.sources.scratch import exists

MANIFEST = "seq long, version string, run_ts string"
HISTORY, VERSIONS = "history", "versions"


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stamp_of(run_ts: datetime) -> str:
    """A text that sorts as the time does."""
    return run_ts.strftime("%Y%m%dT%H%M%S")


def published(spark: SparkSession, base: str) -> DataFrame:
    """The manifest of a table: ``seq, version`` (its folder), ``run_ts``; empty before the first run."""
    if not exists(spark, f"{base}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def _last(spark: SparkSession, base: str):
    return published(spark, base).orderBy(F.col("seq").desc()).first()


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The table as last published."""
    last = _last(spark, base)
    if last is None:
        raise FileNotFoundError(f"{base}: nothing is published")
    return read_layer(spark, f"{base}/{last['version']}")


def point_to(spark: SparkSession, base: str, version: str, run_ts: str | None = None) -> None:
    """Make a version that is written the current one: one file, which is there or not."""
    last = _last(spark, base)
    line = [((last["seq"] if last else 0) + 1, version, run_ts)]
    spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def publish(df: DataFrame, base: str, version: str, run_ts: str | None = None) -> None:
    """Write ``df`` as ``base/version``, then point to it."""
    df.write.option("compression", "snappy").parquet(f"{base}/{version}")
    point_to(df.sparkSession, base, version, run_ts)


def write_current(df: DataFrame, base: str) -> None:
    """The stable table, replaced on every run; ``vacuum`` clears what is no longer pointed to."""
    publish(df, base, f"{VERSIONS}/{uuid.uuid4().hex}")


def write_current_and_history(df: DataFrame, base: str, run_ts: datetime) -> None:
    """The stable table is the newest part of its history: ``base/history/run_ts=<stamp>/<id>``.

    The plan runs once, nothing is copied, and a second run of one stamp leaves the first one in place until it is whole.
    """
    stamp = stamp_of(run_ts)
    publish(df, base, f"{HISTORY}/run_ts={stamp}/{uuid.uuid4().hex[:8]}", stamp)


def read_history(spark: SparkSession, base: str) -> DataFrame:
    """All runs of a table, each as last published, with their ``run_ts``; columns that a run lacks are null.

    The manifest's lines come to the driver: one for each run.
    """
    last = {}
    for line in published(spark, base).where(F.col("run_ts").isNotNull()).orderBy("seq").collect():
        last[line["run_ts"]] = line["version"]
    runs = [read_layer(spark, f"{base}/{version}").withColumn("run_ts", F.lit(stamp)) for stamp, version in last.items()]
    if not runs:
        raise FileNotFoundError(f"{base}: no history is published")
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_if_nonempty(df: DataFrame, base: str, run_ts: datetime) -> bool:
    """``write_current_and_history`` when there are rows; says whether there were.

    The rows are counted while they are written (``observe``), so the plan runs once; a version without rows is
    written, but never pointed to.
    """
    seen = Observation()
    stamp = stamp_of(run_ts)
    version = f"{HISTORY}/run_ts={stamp}/{uuid.uuid4().hex[:8]}"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "snappy").parquet(f"{base}/{version}")
    if not seen.get["rows"]:
        return False
    point_to(df.sparkSession, base, version, stamp)
    return True


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Delete versions of a stable table but for the last ``keep`` (one may still be read); says how many folders went.

    History is never deleted.
    """
    lines = published(spark, base).where(F.col("version").startswith(f"{VERSIONS}/")).orderBy(F.col("seq").desc()).collect()
    held = {line["version"].split("/")[1] for line in lines[:keep]}
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{base}/{VERSIONS}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in held] if fs.exists(folder) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
