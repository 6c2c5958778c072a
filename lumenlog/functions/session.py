"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """UTC timestamps, adaptive execution, and skew-join splitting even where it costs a shuffle.

    The last setting matters for plain joins of rows with per-group tables: without it a later
    aggregation on the same keys stops Spark from splitting a hot key.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark
