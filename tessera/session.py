"""A Spark session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
