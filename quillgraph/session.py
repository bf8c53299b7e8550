"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quillgraph", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution.  Further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
