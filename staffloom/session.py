"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    # two headers of one sheet may differ by case only
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # wide cleaning projections make methods that the JVM would not compile; beyond this size Spark splits them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark
