"""The session that the engine expects: adaptive plans, Arrow, ANSI arithmetic and UTC."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session with the settings above; `shuffle_partitions` should grow with the data."""
    builder = SparkSession.builder.master(master).appName("atlasforge").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()
