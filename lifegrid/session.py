"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lifegrid", **conf: str) -> SparkSession:
    """The current session, or one with adaptive execution, skew joins and Arrow on. Partition sizes are left to the cluster."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
