"""Tile grids as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"))


def stride_grid(spark: SparkSession, width: int, height: int, stride: int, margin: int) -> DataFrame:
    """Tiles at a stride with a margin read around each, clipped to the raster."""
    lo = lambda k: F.greatest(F.lit(0), F.col(k) * stride - margin)
    hi = lambda k, most: F.least(F.lit(most), (F.col(k) + 1) * stride + margin)
    return _grid(spark, -(-height // stride), -(-width // stride)).select("r", "c", lo("c").alias("col0"), lo("r").alias("row0"), (hi("c", width) - lo("c")).alias("w"), (hi("r", height) - lo("r")).alias("h"))


def overlapping_tiles(spark: SparkSession, width: int, height: int, size: int, step: int, least: int) -> DataFrame:
    """Tiles of a size at a smaller step; those with a side under `least` are left out."""
    g = _grid(spark, -(-height // step), -(-width // step)).select((F.col("c") * step).alias("col0"), (F.col("r") * step).alias("row0"))
    sized = g.withColumn("w", F.least(F.lit(size), F.lit(width) - F.col("col0"))).withColumn("h", F.least(F.lit(size), F.lit(height) - F.col("row0")))
    return sized.where((F.col("w") >= least) & (F.col("h") >= least))


def flush_starts(length: int, size: int, overlap: int) -> Column:
    """Starts of sliding windows; the last one ends flush with the raster."""
    last = max(0, length - size)
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"), F.lit(size - overlap).cast("bigint")), F.array(F.lit(last).cast("bigint"))))
