"""Incremental landing: bronze is append-only by file, and a file is read once.

A bronze folder holds ``rows/landing=<id>`` and ``files/landing=<id>``.  The second is the manifest: path, length and modification
time of every file that a landing has read, and its error if it could not be read.  A landing reads what the manifest does not
have; a changed file is new.  Its rows are written before its manifest, so rows of a landing that failed half way belong to
no file and are never read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from staffloom.sources.scratch import exists
from staffloom.sources.workbooks import LANDED_SCHEMA, discover_sources, land_workbooks

MANIFEST = "source_path string, source_file string, length long, modificationTime timestamp, error string, landing string"
#: Versions of files are sent to every task while they are no more; a row has a path and an id.
BROADCAST_FILES = 50_000
_GLOB = re.compile(r"([\\\[\]{}*?])")


def landings(spark: SparkSession, base: str) -> DataFrame:
    """The manifest: every version of every file that was read; empty before the first landing."""
    if not exists(spark, f"{base}/files"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{base}/files")


def landed_files(spark: SparkSession, base: str) -> DataFrame:
    """The version of each file that counts: of its last landing."""
    seen = landings(spark, base)
    last = seen.groupBy("source_path").agg(F.max("landing").alias("landing"))
    return seen.join(last, ["source_path", "landing"], "left_semi")


def new_files(spark: SparkSession, path: str, base: str, exclude: Sequence[str] = ("~$",)) -> DataFrame:
    """Files under ``path`` whose path, length and modification time the manifest does not have."""
    found = discover_sources(spark, path, exclude)
    return found.join(landings(spark, base), ["source_path", "length", "modificationTime"], "left_anti")


def land_new(spark: SparkSession, path: str, base: str, run_ts: datetime, exclude: Sequence[str] = ("~$",)) -> int:
    """Read the new files under ``path`` into the bronze folder ``base``; says how many there were.

    The paths of the new files come to the driver, which has listed the folder.  A file that has gone keeps its rows.
    """
    found = new_files(spark, path, base, exclude)
    new = found.collect()
    if not new:
        return 0
    landing = f"{run_ts:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    rows_path = f"{base}/rows/landing={landing}"
    land_workbooks(spark, [_GLOB.sub(r"\\\1", row["source_path"]) for row in new], exclude).write.parquet(rows_path)
    errors = spark.read.schema(LANDED_SCHEMA).parquet(rows_path).where(F.col("error").isNotNull()).select("source_path", "error")
    files = spark.createDataFrame(new, found.schema).join(errors, "source_path", "left")
    files.coalesce(1).write.parquet(f"{base}/files/landing={landing}")
    return len(new)


def bronze(spark: SparkSession, base: str) -> DataFrame:
    """Landed rows of the files' versions that count, with the error of files that could not be read.

    Only the landings of these versions are read.
    """
    current = landed_files(spark, base).select("source_path", "landing")
    if current.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        current = F.broadcast(current)
    rows = spark.read.schema(f"{LANDED_SCHEMA}, landing string").parquet(f"{base}/rows")
    return rows.join(current, ["source_path", "landing"], "left_semi").drop("landing")
