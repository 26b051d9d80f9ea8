"""The evidence-gated edit loop: dispositions, and versioned application of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasforge.functions.columns import ladder


def disposition(category: Column, hatch: Column, dark: Column, fit: Column) -> Column:
    """From the evidence in percent; for missing features fit is the share covered already, for shape
    mismatches dark is the overhang and fit the missed share."""
    false_positive = ladder(((dark >= 50) & (fit >= 70), "dismissed"), (dark >= 50, "fixed_delete"), (hatch < 6, "fixed_delete"), (hatch < 15, "needs_review"), default="dismissed")
    missing = ladder((fit > 75, "dismissed"), ((hatch >= 22) | (dark >= 50), "fixed_add"), (hatch >= 10, "needs_review"), default="dismissed")
    shape = ladder(((dark > 80) | (fit > 75), "fixed_reshape"), (dark > 60, "needs_review"), default="dismissed")
    split = ladder((hatch >= 50, "fixed_split"), default="needs_review")
    return F.when(category == "false_positive", false_positive).when(category == "missing_feature", missing).when(category == "shape_mismatch", shape).otherwise(split)


def apply_edits(layer: DataFrame, deletes: DataFrame, reshapes: DataFrame, adds: DataFrame, key: str, version: int) -> DataFrame:
    """Version n + 1 of a layer: deleted keys go, reshaped ones take the new columns, new rows follow.
    A key that is both deleted and reshaped is deleted; of several reshapes of a key the first by its
    columns' order holds."""
    columns = [c for c in layer.columns if c not in (key, "action", "version")]
    new = reshapes.groupBy(key).agg(F.min(F.struct(*columns)).alias("__new"))
    kept = layer.join(deletes.select(key).distinct(), key, "left_anti").join(new, key, "left")
    shaped = kept.select(key, *(F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) for c in columns), F.when(F.col("__new").isNotNull(), "reshaped").otherwise("kept").alias("action"))
    added = adds.select(key, *columns, F.lit("added").alias("action"))
    return shaped.unionByName(added).withColumn("version", F.lit(version))
