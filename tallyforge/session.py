"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
