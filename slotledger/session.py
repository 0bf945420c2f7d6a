"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession

UTC_NAMES = {"UTC", "Etc/UTC", "Z", "GMT", "Etc/GMT", "+00:00"}


def build_session(app_name: str = "slotledger", master: str | None = None, **conf) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Truncations and date parts follow the session zone, and the data model is UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"spark.sql.session.timeZone must be UTC, found {zone}")
