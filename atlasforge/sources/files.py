"""Listings, hashes and sinks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, sha256) of files, read by Spark wherever they are."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_once(df: DataFrame, path: str) -> None:
    """Fails where there is output already."""
    df.write.mode("errorifexists").parquet(path)


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet, for runs that resume."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def checkpoint_tiles(df: DataFrame, tile: str) -> DataFrame:
    """Writes one folder a tile to the shared folder, and reads all of them as one table."""
    from atlasforge.staging import shared_path

    spark, path = df.sparkSession, shared_path(df.sparkSession, "tiles")
    df.write.partitionBy(tile).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_layers(layers: dict[str, DataFrame], folder: str) -> list[str]:
    """One Parquet folder a layer; empty layers are left out. Returns the names written."""
    written = []
    for name, df in layers.items():
        if df.limit(1).count():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            written.append(name)
    return written
