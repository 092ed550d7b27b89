"""Sessions with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "braidline", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution decides partition counts and skew; everything else follows the cluster's own settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    return builder.config(map=settings).getOrCreate()
