"""Shares of marked pixels in many windows of a raster, each clipped by the raster.

Windows are dealt to tiles, and a tile counts by tables of sums, so a window costs some lookups whatever its
size. Closing and opening see no pixel outside the window; a pixel's result depends on how near the window's
edges are only up to two pixels, so there is one table for each such case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128
#: So many windows of a tile go through one task, about.
WINDOWS = 400_000
#: Bits of a pixel's value, by the share that they are for.
BITS = {"ink": 1, "hatch": 2, "hatch_relaxed": 4, "divider": 8, "divider_relaxed": 16}
SHARES = ("ink", "closed", "opened", "hatch", "hatch_relaxed", "divider", "divider_relaxed")
C = F.col


def _moved(m: np.ndarray, step: int, axis: int) -> np.ndarray:
    """What lies `step` further; what comes from outside isn't looked up."""
    return np.roll(m, -step, axis) if step else m


def closed_near(m: np.ndarray, rows: tuple[int, int], cols: tuple[int, int]) -> np.ndarray:
    """The closing by 3 by 3 of each pixel in a window that ends so many pixels before and after it; 2: two or more."""
    out = np.ones_like(m)
    for i in range(-min(rows[0], 1), min(rows[1], 1) + 1):
        tall = np.logical_or.reduce([_moved(m, k, 0) for k in range(max(i - 1, -rows[0]), min(i + 1, rows[1]) + 1)])
        for j in range(-min(cols[0], 1), min(cols[1], 1) + 1):
            out &= np.logical_or.reduce([_moved(tall, k, 1) for k in range(max(j - 1, -cols[0]), min(j + 1, cols[1]) + 1)])
    return out


def _spans(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """For each nearness to both ends of the ranges lo .. hi - 1 the part of a range that has it."""
    for before in range(3):
        for after in range(3):
            a = np.maximum(lo + before, hi - 1 - after if after < 2 else lo)
            b = np.minimum(lo + before + 1 if before < 2 else hi, hi - after)
            if (a < b).any():
                yield (before, after), a, b


class Sums:
    """Counts of a mask's pixels in rectangles r0 .. r1 - 1, c0 .. c1 - 1."""

    def __init__(self, m: np.ndarray):
        self.wide = m.shape[1] + 1
        table = np.zeros((m.shape[0] + 1, self.wide), np.int64)
        table[1:, 1:] = m.cumsum(0, dtype=np.int64).cumsum(1)
        self.flat = table.ravel()

    def __call__(self, r0, r1, c0, c1) -> np.ndarray:
        top, low, f = r0 * self.wide, r1 * self.wide, self.flat
        return f[low + c1] - f[top + c1] - f[low + c0] + f[top + c0]


def _shrunk(there: Sums, box: np.ndarray) -> np.ndarray:
    """Rectangles cut to the bounds of the pixels that are there, of which each has some."""
    box = box.copy()
    for k, step in enumerate((1, -1, 1, -1)):
        left = np.arange(box.shape[1])
        while len(left):
            edge = box[:, left]
            edge[k ^ 1] = edge[k] + step  # the outermost row or column
            left = left[there(*edge) == 0]
            box[k, left] += step
    return box


def shares(value: np.ndarray, there: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rectangles (r0, r1, c0, c1; ends excluded) whose pixels span four at least, and `SHARES` of
    each; pixels that aren't there bear no mark."""
    high = np.array(value.shape).repeat(2)[:, None]
    box = np.clip(box, 0, high)
    some = Sums(there)
    full = (box[1] > box[0]) & (box[3] > box[2])
    full[full] = some(*box[:, full]) > 0
    at = np.flatnonzero(full)
    box = box[:, at]
    size = (box[1] - box[0]) * (box[3] - box[2])
    holes = np.flatnonzero(some(*box) < size)
    box[:, holes] = _shrunk(some, box[:, holes])
    size = (box[1] - box[0]) * (box[3] - box[2])
    at, box, size = at[size >= 4], box[:, size >= 4], size[size >= 4]
    count = {name: Sums(value & bit > 0)(*box) for name, bit in BITS.items()}
    count["closed"], count["opened"] = np.zeros_like(size), np.zeros_like(size)
    ink = value & BITS["ink"] > 0
    for rows, r0, r1 in _spans(*box[:2]):
        for cols, c0, c1 in _spans(*box[2:]):
            k = np.flatnonzero((r0 < r1) & (c0 < c1))
            part = (r0[k], r1[k], c0[k], c1[k])
            count["closed"][k] += Sums(closed_near(ink, rows, cols))(*part)
            count["opened"][k] += Sums(~closed_near(~ink, rows, cols))(*part)
    return at, np.array([count[name] / size for name in SHARES])


def window_shares(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, *SHARES) of windows (id, r0, r1, c0, c1; ends included) over pixels (r, c, v), v by `BITS`: of the bounds of
    the pixels that a window holds, if they span four pixels. One row an id, whose rows must be alike. Blocks of pixels
    go only to tiles that have windows; a tile is at least as large as its windows, which reach into the next one at most."""
    block = lambda c: F.floor(C(c) / BLOCK)
    blocks = pixels.groupBy(block("r").alias("br"), block("c").alias("bc")).agg(F.collect_list(F.struct("r", "c", "v")).alias("px"))
    parts = 1 + windows.count() // WINDOWS
    size = F.greatest(C("r1") - C("r0"), C("c1") - C("c0")) + 1
    w = windows.where("r0 <= r1 AND c0 <= c1").withColumn("n", F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(size / BLOCK)), F.lit(0))).cast("bigint"))
    w = w.withColumns({"tr": F.floor(C("r0") / (C("n") * BLOCK)), "tc": F.floor(C("c0") / (C("n") * BLOCK)), "part": F.pmod(F.xxhash64("id"), F.lit(parts))})
    deal = ["n", "tr", "tc", "part"]
    reach = lambda k: F.explode(F.sequence(C(k) * C("n"), (C(k) + 2) * C("n") - 1))
    need = w.select(*deal).distinct().withColumn("br", reach("tr")).withColumn("bc", reach("tc"))
    held = need.hint("merge").join(blocks, ["br", "bc"]).select(*(C(k).alias(k) for k in deal), "px")
    names = ["id", *SHARES]

    def run(table: pa.Table, held: pa.Table) -> pa.Table:
        if not len(table) or not len(held):
            return pa.table([pa.array([], pa.int64()), *(pa.array([], pa.float64()) for _ in SHARES)], names=names)
        px = pc.list_flatten(held.column("px"))
        r, c, v = (pc.struct_field(px, k).to_numpy() for k in range(3))
        r0, c0 = r.min(), c.min()
        value, there = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), np.int64), np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), bool)
        value[r - r0, c - c0], there[r - r0, c - c0] = v, True
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        low, high, left, right = (table.column(k).to_numpy()[first] for k in ("r0", "r1", "c0", "c1"))
        at, found = shares(value, there, np.array([low - r0, high - r0 + 1, left - c0, right - c0 + 1]))
        return pa.table([ids[at], *found], names=names)

    met = w.select("id", "r0", "r1", "c0", "c1", *deal).groupBy(*deal).cogroup(held.groupBy(*deal))
    return met.applyInArrow(run, "id bigint, " + ", ".join(f"{k} double" for k in SHARES))
