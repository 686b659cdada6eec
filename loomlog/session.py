"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "loomlog", **conf) -> SparkSession:
    """UTC times, adaptive execution with skew joins, bounded scan splits; keyword settings win (a_b for a.b)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
