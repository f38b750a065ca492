"""Small tables that a plan needs to know before it can be written down, on storage that all tasks share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="staffloom-"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on any storage that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    path = f"{shared_folder(df.sparkSession)}/staffloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
