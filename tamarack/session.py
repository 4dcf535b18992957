"""A session with the settings that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC, checkpoints removed with what read them; ``conf`` with dots as double underscores goes on top."""
    b = SparkSession.builder.appName("tamarack").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
