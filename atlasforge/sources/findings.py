"""Findings from JSON lines, tolerant of bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id bigint, tile_no bigint, error string, findings array<struct<category string, bbox_px array<double>, confidence string>>"


def parse_lines(lines: DataFrame, categories: list[str], least_side: float = 8) -> DataFrame:
    """One row a finding; skips blank and malformed lines, error rows, unknown categories, boxes without
    four sides or under `least_side`. A missing confidence is low."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", SCHEMA).alias("j")).where("j is not null and j.error is null")
    each = parsed.select("j.id", "j.tile_no", F.explode_outer("j.findings").alias("f")).where("f is not null").select("id", "tile_no", "f.*")
    box = F.col("bbox_px")
    ok = F.col("category").isin(*categories) & (F.size(box) == 4)
    sized = each.where(ok).where((F.get(box, F.lit(2)) - F.get(box, F.lit(0)) >= least_side) & (F.get(box, F.lit(3)) - F.get(box, F.lit(1)) >= least_side))
    sides = [F.get(box, F.lit(k)).cast("bigint").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return sized.select("id", "tile_no", "category", *sides, F.coalesce("confidence", F.lit("low")).alias("confidence"))


def read(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    return parse_lines(spark.read.text(path), categories)
