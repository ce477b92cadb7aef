"""The session that this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "wickwork", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
