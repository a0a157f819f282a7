"""A session with the settings the operators assume: UTC, ANSI, adaptive execution."""

from pyspark.sql import SparkSession


def session(name: str = "panelyard", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
