"""Greedy suppression of overlapping boxes, best first, within groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasforge.functions.columns import area, iou
from atlasforge.operators.graph import connected
from atlasforge.operators.spatial import CELL, overlapping
from atlasforge.staging import staged

GONE, STAYS, OPEN = 0, 1, 2
ROUNDS = 16
STEP = 512  # boxes that are settled at once


def keep_greedy(box: np.ndarray, score: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes stay; equal scores keep their order."""
    order = np.argsort(-score, kind="stable")
    areas = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    keep: list[int] = []
    for k in order:
        got = np.array(keep, dtype=int)
        w = np.clip(np.minimum(box[got, 2], box[k, 2]) - np.maximum(box[got, 0], box[k, 0]), 0, None)
        h = np.clip(np.minimum(box[got, 3], box[k, 3]) - np.maximum(box[got, 1], box[k, 1]), 0, None)
        shared = w * h
        if not (shared > threshold * (areas[got] + areas[k] - shared)).any():
            keep.append(k)
    out = np.zeros(len(box), dtype=bool)
    out[keep] = True
    return out


def _over(box: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """A row a box: whether it overlaps each of the others by more than the threshold."""
    w = np.clip(np.minimum(box[:, None, 2], other[None, :, 2]) - np.maximum(box[:, None, 0], other[None, :, 0]), 0, None)
    h = np.clip(np.minimum(box[:, None, 3], other[None, :, 3]) - np.maximum(box[:, None, 1], other[None, :, 1]), 0, None)
    shared = w * h
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    return shared > threshold * (size(other)[None, :] + size(box)[:, None] - shared)


def _reach(threshold: float) -> float:
    """How far apart the centres of two boxes are that overlap by more than a threshold, as a share of either's side."""
    return max(1 - threshold, 0.5 / threshold - 0.5) + 1e-9


def hit(box: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each box overlaps any of the others by more than the threshold. Boxes are halved by place, and each
    half meets only those whose centre and area allow it."""
    out = np.zeros(len(box), bool)
    if len(box) * len(other) <= 4096 or len(box) <= 32:
        for lo in range(0, len(other), 4096):
            left = np.flatnonzero(~out)
            out[left] = _over(box[left], other[lo : lo + 4096], threshold).any(axis=1)
        return out
    mid, side = (box[:, :2] + box[:, 2:]) / 2, box[:, 2:] - box[:, :2]
    away, areas = side * _reach(threshold), side[:, 0] * side[:, 1]
    at, size = (other[:, :2] + other[:, 2:]) / 2, (other[:, 2] - other[:, 0]) * (other[:, 3] - other[:, 1])
    axis = int(np.ptp(mid, axis=0).argmax())
    order = np.argpartition(mid[:, axis], len(mid) // 2)
    for half in (order[: len(mid) // 2], order[len(mid) // 2 :]):
        low, high = np.fmin.reduce(mid[half] - away[half]), np.fmax.reduce(mid[half] + away[half])
        some = (at[:, 0] >= low[0]) & (at[:, 0] <= high[0]) & (at[:, 1] >= low[1]) & (at[:, 1] <= high[1])
        some &= (size >= np.fmin.reduce(areas[half]) * threshold * (1 - 1e-9)) & (size * threshold * (1 - 1e-9) <= np.fmax.reduce(areas[half]))
        out[half] = hit(box[half], other[some], threshold)
    return out


def settle(box: np.ndarray, own: np.ndarray, kept: np.ndarray, threshold: float) -> np.ndarray:
    """What is certain of boxes, best first: GONE if one that stays hides it, STAYS if it is an own one that no
    better one hides that stays or may stay, else OPEN. All that may hide an own box must be there; the
    `kept` ones are known to stay."""
    out = np.full(len(box), OPEN)
    known, unsure, at = [kept], [np.zeros((0, 4))], 0
    while at < len(box):
        to = min(len(box), at + min(max(at, 64), STEP))
        some = np.arange(at, to)
        known, unsure = [np.concatenate(known)], [np.concatenate(unsure)]
        hidden = hit(box[some], known[0], threshold)
        out[some[hidden]] = GONE
        some = some[~hidden]
        doubt, mine = np.zeros(len(some), bool), np.flatnonzero(own[some])
        doubt[mine] = hit(box[some[mine]], unsure[0], threshold)
        among, hidden = _over(box[some], box[some], threshold), np.zeros(len(some), bool)
        for j, i in enumerate(some.tolist()):
            if hidden[j]:
                out[i] = GONE
            elif own[i] and not doubt[j]:
                out[i] = STAYS
                hidden |= among[j]
            else:
                doubt |= among[j]
        known.append(box[some[out[some] == STAYS]])
        unsure.append(box[some[out[some] == OPEN]])
        at = to
    return out


def suppress(df: DataFrame, groups: list[str], threshold: float, key: str = "id", cell: float = 4 * CELL) -> DataFrame:
    """The keys of rows (key, x0..y1, score) that stay: of a group's boxes the best first, equal scores by key, unless
    one that stays overlaps it by more than the threshold. Boxes are dealt to the cell of their centre, which owns
    them, and to those whose boxes they may hide. A cell settles what it can; what hangs on boxes of other cells
    waits for the next round, to which only new boxes that stay and open ones go, and whose cells are twice as
    wide and lie elsewhere. Pairs are never made into rows. What is open after `ROUNDS`, in chains through many cells, is settled component by component."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    box = ["x0", "y0", "x1", "y1"]
    real = F.expr("x0 < x1 AND y0 < y1")
    for c in groups:
        real = real & F.col(c).isNotNull()
    real = F.coalesce(real, F.lit(False))
    out = df.where(~real).select(key)  # without an area or a group nothing is hidden
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score")
    live = df.where(real).select(F.col(key).alias("__key"), *(F.col(c).alias(f"__g{k}") for k, c in enumerate(groups)), *(F.col(c).cast("double").alias(c) for c in box), score, F.lit(OPEN).alias("state"))
    names, keys = live.columns, [f"__g{k}" for k in range(len(groups))]
    reach = _reach(threshold)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["__key"].to_numpy(), -pdf["score"].to_numpy(float)))]
        state, own, boxes = pdf["state"].to_numpy().copy(), pdf["__own"].to_numpy(bool), pdf[box].to_numpy(float)
        stay = state == STAYS
        for at in pdf.groupby([*keys, "__cx", "__cy"], sort=False).indices.values():
            new = at[~stay[at]]
            state[new] = settle(boxes[new], own[new], boxes[at[stay[at]]], threshold)
        return pdf.assign(state=state)[own & ~stay & (state != GONE)][names]

    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of several cells, as a group costs time
    for k in range(ROUNDS):
        dealt, wide = live, cell * 2**k
        move = wide * (0.382 * k % 1)
        for c, low, high in (("x", "x0", "x1"), ("y", "y0", "y1")):
            mid, far = (F.col(low) + F.col(high)) / 2 - move, (F.col(high) - F.col(low)) * reach
            dealt = dealt.withColumn(f"__{c}", F.floor(mid / wide)).withColumn(f"__c{c}", F.explode(F.sequence(F.floor((mid - far) / wide), F.floor((mid + far) / wide))))
        dealt = dealt.withColumn("__own", F.expr("__x = __cx AND __y = __cy")).drop("__x", "__y")
        dealt = dealt.withColumn("__part", F.pmod(F.xxhash64(*keys, "__cx", "__cy"), F.lit(parts)))
        live = staged(dealt.groupBy("__part").applyInPandas(decide, live.schema), "greedy-round")
        out = out.unionByName(live.where(F.col("state") == STAYS).select(F.col("__key").alias(key)))
        if not live.where(F.col("state") == OPEN).limit(1).count():
            return out
    rest = live.withColumn("score", F.when(F.col("state") == STAYS, float("inf")).otherwise(F.col("score")))
    stays = _by_component(rest, keys, threshold, "__key").join(rest.where(F.col("state") == OPEN).select("__key"), "__key", "left_semi")
    return out.unionByName(stays.select(F.col("__key").alias(key)))


def _by_component(df: DataFrame, groups: list[str], threshold: float, key: str) -> DataFrame:
    """The same, from all pairs that overlap: boxes linked by an overlap over the threshold are decided together, so
    a task holds one component and not a whole group."""
    linked = overlapping(df, df, also=groups).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    edges = linked.where(iou(F.col("inter"), area("a_"), area("b_")) > threshold).select(F.col(f"a_{key}").alias("u"), F.col(f"b_{key}").alias("v"))
    roots = connected(edges).select(F.col("node").alias(key), "component")
    tied = df.join(roots, key)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        keep = keep_greedy(pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), pdf["score"].to_numpy(float), threshold)
        return pdf[keep][[key]]

    kept = tied.groupBy("component").applyInPandas(decide, f"{key} bigint")
    return df.join(roots, key, "left_anti").select(key).unionByName(kept.select(key))
