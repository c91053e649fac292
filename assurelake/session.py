"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI semantics and adaptive execution. Partition counts and memory are left to
    the cluster, or to `conf`."""
    builder = SparkSession.builder.appName("assurelake")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | conf
    return builder.config(map=settings).getOrCreate()
