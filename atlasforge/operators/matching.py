"""One-to-one matching of predictions and references over sparse pairs, component by component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasforge.functions.columns import area, iou
from atlasforge.operators.graph import connected
from atlasforge.operators.spatial import overlapping, points_in


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest one-to-one assignment of the smaller side, by shortest augmenting paths."""
    flipped = cost.shape[0] > cost.shape[1]
    a = cost.T if flipped else cost
    n, m = a.shape
    u, v, row_of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = a[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]] = reduced[better]
            way[free[better]] = j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    pairs = [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return [(j, i) for i, j in pairs] if flipped else pairs


def match(pairs: DataFrame, threshold: float, most_pairs: bool = True) -> DataFrame:
    """(pred, ref, iou) matched one to one from pairs (pred, ref, iou). most_pairs: as many pairs at the
    threshold as can be, then the greatest sum; else the greatest sum of all, cut at the threshold after."""
    near = pairs.where(F.col("iou") >= threshold) if most_pairs else pairs.where("iou > 0")
    roots = connected(near.select(F.concat(F.lit("p"), "pred").alias("u"), F.concat(F.lit("r"), "ref").alias("v")))
    keyed = near.join(roots.select(F.col("node").alias("n"), "component"), F.concat(F.lit("p"), "pred") == F.col("n")).select("pred", "ref", "iou", "component")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pred", "ref"])
        preds, p = np.unique(pdf["pred"], return_inverse=True)
        refs, r = np.unique(pdf["ref"], return_inverse=True)
        w = np.zeros((len(preds), len(refs)))
        w[p, r] = pdf["iou"] + (min(w.shape) + 1 if most_pairs else 0)
        iou = np.zeros_like(w)
        iou[p, r] = pdf["iou"]
        found = [(preds[i], refs[j], iou[i, j]) for i, j in assignment(-w) if iou[i, j] > 0 and iou[i, j] >= threshold]
        return pd.DataFrame(found, columns=["pred", "ref", "iou"]).astype({"pred": "int64", "ref": "int64", "iou": "float64"})

    return keyed.groupBy("component").applyInPandas(solve, "pred bigint, ref bigint, iou double")


def match_flags(refs: DataFrame, preds: DataFrame, threshold: float = 0.5, cover: float = 0.3) -> DataFrame:
    """For each reference box (id, x0..y1): matched and pred of the assignment with the greatest sum of
    IoU, cut at the threshold; best_iou, any_overlap; split_flag: two predictions lie mostly in it and the
    predictions together cover half of it; merge_flag and oversize_flag: its match, or else the best that
    covers `cover` of it, covers that much of two references, or has over twice its area."""
    pairs = overlapping(refs.select("id", "x0", "y0", "x1", "y1"), preds.select("id", "x0", "y0", "x1", "y1"))
    shared = F.col("inter")
    f = pairs.select(F.col("a_id").alias("ref"), F.col("b_id").alias("pred"), iou(shared, area("a_"), area("b_")).alias("iou"), (shared / area("a_")).alias("of_ref"), (shared / area("b_")).alias("of_pred"), area("a_").alias("ref_area"), area("b_").alias("pred_area"))
    pred = f.groupBy("pred").agg(F.count_if(F.col("of_ref") >= cover).alias("covers"), F.max("pred_area").alias("pred_area"))
    order = F.struct("iou", -F.col("pred"))
    ref = f.groupBy("ref").agg(F.max("iou").alias("best"), F.max_by("pred", F.when(F.col("of_ref") >= cover, order)).alias("covering"), F.count_if(F.col("of_pred") >= 0.5).alias("inside"), F.sum("of_ref").alias("covered"), F.max("ref_area").alias("ref_area"))
    found = match(f.select("pred", "ref", "iou"), threshold, most_pairs=False).select("ref", F.col("pred").alias("match"))
    j = refs.select(F.col("id").alias("ref")).join(ref, "ref", "left").join(found, "ref", "left")
    j = j.withColumn("pred", F.coalesce("match", "covering")).join(pred, "pred", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.select(
        F.col("ref").alias("id"), F.col("match").isNotNull().alias("matched"), F.col("match").alias("pred"), F.coalesce("best", F.lit(0.0)).alias("best_iou"), F.col("best").isNotNull().alias("any_overlap"),
        no((F.col("inside") >= 2) & (F.col("covered") >= 0.5)).alias("split_flag"), no(F.col("covers") >= 2).alias("merge_flag"), no(F.col("pred_area") > 2 * F.col("ref_area")).alias("oversize_flag"),
    )


def block_scores(refs: DataFrame, preds: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """(block_id, tp, fp, fn, precision, recall): one-to-one matches within each block, to which a box
    belongs by its middle. Refused where references repeat an id or have no area."""
    bad = refs.agg((F.count("*") - F.count_distinct("id") + F.count_if(area() <= 0)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} references repeat an id or have no area")
    at = lambda d: points_in(d.select("id", "x0", "y0", "x1", "y1", F.floor((F.col("x0") + F.col("x1")) / 2).alias("px"), F.floor((F.col("y0") + F.col("y1")) / 2).alias("py")), blocks, "px", "py", "block_id").where("block_id >= 0")
    r, p = at(refs), at(preds)
    pairs = overlapping(r, p, also=["block_id"]).select(F.col("b_id").alias("pred"), F.col("a_id").alias("ref"), iou(F.col("inter"), area("a_"), area("b_")).alias("iou"))
    found = match(pairs, threshold).select(F.col("ref").alias("id")).join(r.select("id", "block_id"), "id")
    count = lambda d, name: d.groupBy("block_id").agg(F.count("*").alias(name))
    j = blocks.select("block_id").join(count(found, "tp"), "block_id", "left").join(count(p, "preds"), "block_id", "left").join(count(r, "refs"), "block_id", "left").fillna(0)
    part = lambda n: F.col("tp") / F.nullif(F.col(n), F.lit(0))
    return j.select("block_id", "tp", (F.col("preds") - F.col("tp")).alias("fp"), (F.col("refs") - F.col("tp")).alias("fn"), part("preds").alias("precision"), part("refs").alias("recall"))
