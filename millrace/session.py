"""A session with the settings the library is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow transfer. Partition counts are the cluster's business: pass them in ``conf``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
