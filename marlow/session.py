"""A session with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **options: str) -> SparkSession:
    """AQE on, UTC, Arrow batches; shuffle partitions from the cores on a local master only."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
        conf["spark.driver.memory"] = "8g"
    builder = SparkSession.builder.appName("marlow")
    if master:
        builder = builder.master(master)
    return builder.config(map=conf | options).getOrCreate()
