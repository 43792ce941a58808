"""Session factory and the few settings that every plan in the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI is Spark 4's default and stays on; UTC makes timestamps comparable with other engines.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def get_session(app: str = "loomwell", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one with the engine's settings. ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
