"""Masks to polygons and centre lines: outlines are linked from pixel sides that plain joins find."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasforge.operators import raster as R
from atlasforge.operators import tiles as T
from atlasforge.operators.shapes import signed_area, simplify
from atlasforge.sources.wkb import polygon


def link(sides: set[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """Rings of corners from directed unit sides (x, y, dx, dy). Where two rings touch in a corner, each keeps
    to its own pixel. Outer rings have a positive area, holes a negative one."""
    used, rings = set(), []
    for first in sorted(sides, key=lambda s: (s[1], s[0], s[2:])):
        ring, at = [], first
        while at not in used:
            used.add(at)
            x, y, dx, dy = at
            x, y = x + dx, y + dy
            turn = next(d for d in ((-dy, dx), (dx, dy), (dy, -dx)) if (x, y, *d) in sides)
            if turn != (dx, dy):
                ring.append((x, y))
            at = (x, y, *turn)
        if ring:
            rings.append(np.array(ring[-1:] + ring[:-1], float))
    return rings


def simple_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A ring simplified in two halves, parted at the corner that is farthest from the first one."""
    if tolerance <= 0 or len(ring) < 4:
        return ring
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    there, back = simplify(ring[: far + 1], tolerance), simplify(np.vstack((ring[far:], ring[:1])), tolerance)
    return np.vstack((there[:-1], back[:-1]))


def outlines(labelled: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(label, area, corners, holes, wkb) of 4-connected components (r, c, label) as polygons with holes, in
    pixel units, x along columns. Only the sides between a component and what is outside reach the kernel, so a
    task holds a component's outline and never its area. A polygon whose outer ring vanishes by simplification
    is left out."""
    pixels = labelled.select("label", "r", "c")
    r, c = F.col("r"), F.col("c")
    one = lambda nr, nc, x, y, dx, dy: F.struct(nr.alias("nr"), nc.alias("nc"), x.alias("x"), y.alias("y"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    four = F.array(one(r - 1, c, c, r, 1, 0), one(r, c + 1, c + 1, r, 0, 1), one(r + 1, c, c + 1, r + 1, -1, 0), one(r, c - 1, c, r + 1, 0, -1))
    every = pixels.select("label", F.explode(four).alias("s")).select("label", "s.*")
    sides = every.join(pixels.select(r.alias("nr"), c.alias("nc")), ["nr", "nc"], "left_anti").select("label", "x", "y", "dx", "dy")
    names = ["label", "area", "corners", "holes", "wkb"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = link({(int(x), int(y), int(a), int(b)) for x, y, a, b in zip(pdf["x"], pdf["y"], pdf["dx"], pdf["dy"], strict=True)})
        rings.sort(key=lambda g: -signed_area(g))  # the outer ring first
        slim = [g for g in (simple_ring(g, tolerance) for g in rings) if len(g) > 2 and signed_area(g)]
        if not slim or signed_area(slim[0]) <= 0:
            return pd.DataFrame([], columns=names)
        wkb = polygon([[*map(tuple, g), tuple(g[0])] for g in slim])
        return pd.DataFrame([(pdf["label"].iloc[0], float(sum(map(signed_area, slim))), sum(map(len, slim)), len(slim) - 1, wkb)], columns=names)

    return sides.groupBy("label").applyInPandas(run, "label bigint, area double, corners bigint, holes bigint, wkb binary")


def buildings(probability: DataFrame, threshold: int = 128, least: float = 15, tolerance: float = 0.5, oversize: float = 1500) -> DataFrame:
    """Polygons (label, area, corners, holes, wkb, confidence, oversize) of a raster (r, c, gray) of probabilities
    in 255ths: threshold, opening by 3, 4-connected components of at least `least` pixels, simplified. The
    confidence is the mean over a component's own pixels."""
    mask = probability.select("r", "c", (F.col("gray") >= threshold).cast("int").alias("m"))
    lab = R.components(R.morphed(mask, (F.min, 1), (F.max, 1)).where("m = 1").select("r", "c"))
    mean = lab.join(probability, ["r", "c"]).groupBy("label").agg(F.count("*").alias("px"), (F.avg("gray") / 255).alias("confidence")).where(F.col("px") >= least)
    kept = lab.join(mean.select("label"), "label", "left_semi")
    return outlines(kept, tolerance).join(mean.drop("px"), "label").withColumn("oversize", F.col("area") > oversize)


def pruned(skeleton: np.ndarray, spur: int = 30, rounds: int = 3) -> np.ndarray:
    """Without branches of under `spur` pixels that have a free end; the junction that a branch leaves stays."""
    m = skeleton.copy()
    for _ in range(rounds):
        degree = sum(T.shifted(m, a, b).astype(int) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
        short = [p for p in T.trace(m) if len(p) < spur and 1 in (degree[p[0]], degree[p[-1]])]
        if not short:
            break
        for path in short:
            ends = [p for p in (path[0], path[-1]) if degree[p] > 1]
            for p in path:
                m[p] &= p in ends
    return m


def line_rows(mask: np.ndarray, gray: np.ndarray, spur: int, shortest: float, tolerance: float) -> list[tuple]:
    """(first pixel, points (x, y), length, confidence) of the pruned skeleton's paths."""
    out = []
    for path in T.trace(pruned(T.thin(mask), spur)):
        at = np.array(path)
        line = at[:, ::-1] + 0.5
        size = float(np.hypot(*np.diff(line, axis=0).T).sum())
        if len(path) > 2 and size >= shortest:
            out.append((path[0], simplify(line, tolerance), size, float(gray[at[:, 0], at[:, 1]].mean() / 255)))
    return out


def roads(probability: DataFrame, threshold: int = 128, least: int = 400, spur: int = 30, shortest: float = 15.0, tolerance: float = 1.5, size: int = 512, halo: int = 64) -> DataFrame:
    """Centre lines (r, c, length, points, confidence) of a raster (r, c, gray) of probabilities in 255ths: blur,
    threshold, closing by 7, opening by 5, 8-connected components of at least `least` pixels, skeleton, spurs
    pruned, paths of a least length, simplified; r and c are a path's first pixel. Blur, morphology and components are those
    of the whole raster; skeletons are traced in tiles with a margin, and a path belongs to the tile of its
    first pixel, so one that is longer than the margin ends at it."""
    mask = R.gaussian(probability).select("r", "c", (F.col("g") >= threshold).cast("int").alias("m"))
    lab = R.components(R.morphed(mask, (F.max, 3), (F.min, 3), (F.min, 2), (F.max, 2)).where("m = 1").select("r", "c"), eight=True)
    large = lab.groupBy("label").agg(F.count("*").alias("px")).where(F.col("px") >= least)
    kept = lab.join(large, "label", "left_semi").select("r", "c").join(probability.select("r", "c", "gray"), ["r", "c"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        on, r0, c0 = T.grid_of(pdf.assign(on=True), "on", False)
        gray = T.grid_of(pdf, "gray", 0)[0]
        rows = []
        for first, line, length, confidence in line_rows(on.astype(bool), gray, spur, shortest, tolerance):
            r, c = first[0] + r0, first[1] + c0
            if (r // size, c // size) == tuple(key):
                rows.append((r, c, length, [{"x": float(x) + c0, "y": float(y) + r0} for x, y in line], confidence))
        return pd.DataFrame(rows, columns=["r", "c", "length", "points", "confidence"])

    return R.haloed(kept, halo, size).groupBy("br", "bc").applyInPandas(run, "r bigint, c bigint, length double, points array<struct<x: double, y: double>>, confidence double")


def runs(labelled: DataFrame, cell: int = 64) -> DataFrame:
    """(label, r, cell, c0, c1): unbroken runs of a component's pixels in a row, cut at cells."""
    d = labelled.select("label", "r", "c", F.floor(F.col("c") / cell).alias("cell"))
    d = d.withColumn("g", F.col("c") - F.row_number().over(W.partitionBy("label", "r", "cell").orderBy("c")))
    return d.groupBy("label", "r", "cell", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("g")


def pieces_in(labelled: DataFrame, boxes: DataFrame, least: int, share: float, cell: int = 64) -> DataFrame:
    """(id, label, px) of components of at least `least` pixels of which more than a share lies in a box (id, x0,
    y0, x1, y1; whole pixels, the upper ends exclusive). Runs of pixels meet strips of the boxes' rows."""
    px = labelled.groupBy("label").agg(F.count("*").alias("px")).where(F.col("px") >= least)
    some = runs(labelled.join(px.select("label"), "label", "left_semi"), cell)
    strip = boxes.where("x0 < x1 AND y0 < y1").select("id", "x0", "x1", F.explode(F.expr("sequence(y0, y1 - 1)")).alias("r"))
    strip = strip.withColumn("cell", F.explode(F.expr(f"sequence(floor(x0 / {cell}), floor((x1 - 1) / {cell}))")))
    met = some.join(strip, ["r", "cell"]).where("c0 < x1 AND c1 >= x0")
    inside = met.groupBy("id", "label").agg(F.sum(F.expr("least(c1 + 1, x1) - greatest(c0, x0)")).alias("n"))
    return inside.join(px, "label").where(F.col("n") > share * F.col("px")).select("id", "label", "px")
