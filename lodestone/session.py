"""Session defaults for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the engine relies on: adaptive plans, Arrow transfer, UTC, and Kryo for what is still serialised by the JVM.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(app_name: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name).config(map=DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
