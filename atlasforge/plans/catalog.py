"""All registered queries of the spatial and raster operators, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasforge.plans.registry import ORACLES, QUERIES
from atlasforge.plans import extras, kernels, relational, spatial, vectors  # noqa: F401  (they register themselves)

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels against candidates: best overlap, class and summary."""
    return QUERIES["parcel_qa_summary"](spark, sf_dir)
