"""Spark sessions with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "flowgauge", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC, and adaptive execution; ``conf`` with ``_`` for ``.``."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
