"""The session the engine expects: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "orelake", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """``shuffle_partitions`` is a starting point; adaptive execution merges small ones and splits skewed ones."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
