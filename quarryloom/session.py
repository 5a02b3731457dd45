"""Session defaults. Every setting here can be overridden by the caller's own builder."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quarryloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``master`` only for local use."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
