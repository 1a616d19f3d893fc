"""The session that bench, command line and examples use; on a cluster its settings come from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "curvemill", cores: str | None = None) -> SparkSession:
    """The session that there is, or a new one: local with so many cores if cores are given, else wherever spark-submit says."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if cores is None:
        return builder.getOrCreate()
    local = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    return builder.master(f"local[{cores}]").config(map=local).getOrCreate()
