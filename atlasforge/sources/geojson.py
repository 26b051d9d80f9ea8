"""GeoJSON feature collections as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(text: DataFrame, properties: str) -> DataFrame:
    """Features of collections in column `value`; polygons keep their rings in `coordinates`."""
    schema = f"features array<struct<properties struct<{properties.replace(' ', ':', 1)}>, geometry struct<type string, coordinates array<array<array<double>>>>>>"
    rows = text.select(F.explode_outer(F.from_json("value", schema)["features"]).alias("f")).where("f is not null")
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def boxes(rows: DataFrame, *keep: str) -> DataFrame:
    """Bounding boxes of polygons as longs."""
    ring = F.flatten("coordinates")
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    sides = [(F.array_min(xs), "x0"), (F.array_min(ys), "y0"), (F.array_max(xs), "x1"), (F.array_max(ys), "y1")]
    return rows.select(*keep, *(c.cast("bigint").alias(n) for c, n in sides))


def read(spark: SparkSession, path: str, properties: str) -> DataFrame:
    return features(spark.read.text(path, wholetext=True), properties)
