"""A Spark session with the settings the library expects."""

from pyspark.sql import SparkSession


def session(app: str = "siltstone", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; further settings as keyword arguments with _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
