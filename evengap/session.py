"""Session settings the plans here profit from. All can be set on a running session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a hot stop or trip on the large side of a shuffled join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A generated method over 8000 bytes is never compiled by the JVM. Wide model-table stages reach that; past the
    # limit Spark runs their operators one by one, each of which does get compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
