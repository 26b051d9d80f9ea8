"""Map algebra and focal filters over pixel tables (r, c, gray), in blocks with a halo.

Focal filters never shift the whole image through one task: pixels are dealt to blocks of `BLOCK`
rows and columns with a halo as wide as the kernel, so one shuffle serves rows and columns and a block is
bounded whatever the raster's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasforge.staging import staged

BLOCK = 256


def haloed(pixels: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """Pixels with the block they serve (br, bc); those near an edge serve the neighbours, too."""
    near = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / block), F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block)))
    return pixels.withColumn("br", F.explode(near("r"))).withColumn("bc", F.explode(near("c")))


def own(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Without halo pixels."""
    return df.where((F.floor(F.col("r") / block) == F.col("br")) & (F.floor(F.col("c") / block) == F.col("bc"))).drop("br", "bc")


def box_window(pixels: DataFrame, value: str, half: int, agg: Callable[[Column], Column], name: str) -> DataFrame:
    """agg over the (2 half + 1)-wide square around each pixel, clipped at the image: rows, then columns."""
    rows = W.partitionBy("br", "bc", "r").orderBy("c").rangeBetween(-half, half)
    cols = W.partitionBy("br", "bc", "c").orderBy("r").rangeBetween(-half, half)
    return own(haloed(pixels, half).withColumn("__a", agg(F.col(value)).over(rows)).withColumn(name, agg(F.col("__a")).over(cols)).drop("__a"))


def box_sums(pixels: DataFrame, values: dict[str, Column], half: int) -> DataFrame:
    """Sums of several values over the square around each pixel, with `__n`, how many pixels it holds: one
    shuffle for rows and one for columns serve all of them."""
    rows = W.partitionBy("br", "bc", "r").orderBy("c").rangeBetween(-half, half)
    cols = W.partitionBy("br", "bc", "c").orderBy("r").rangeBetween(-half, half)
    every = values | {"__n": F.lit(1)}
    d = haloed(pixels, half).select("br", "bc", "r", "c", *(F.sum(v).over(rows).alias(k) for k, v in every.items()))
    return own(d.select("br", "bc", "r", "c", *(F.sum(k).over(cols).alias(k) for k in every)))


def reflected(pixels: DataFrame, half: int, value: str = "gray") -> DataFrame:
    """Pixels from 0 on, with a border of `half` mirrored at the outermost pixels, which are not repeated."""
    ends = pixels.agg(F.max("r").alias("__r1"), F.max("c").alias("__c1"))  # one row
    d = pixels.crossJoin(ends)
    for k in ("r", "c"):
        v, last = F.col(k), F.col(f"__{k}1")
        low, high = F.when(v.between(1, half), -v), F.when((last - v).between(1, half), 2 * last - v)
        d = d.withColumn(k, F.explode(F.array_compact(F.array(v, low, high))))
    return d.select("r", "c", value)


def inside(pixels: DataFrame, like: DataFrame) -> DataFrame:
    """Without what lies beyond the bounds of another raster from 0 on."""
    ends = like.agg(F.max("r").alias("__r1"), F.max("c").alias("__c1"))
    return pixels.crossJoin(ends).where("r BETWEEN 0 AND __r1 AND c BETWEEN 0 AND __c1").drop("__r1", "__c1")


def gaussian(pixels: DataFrame, sigma: float = 2.0, half: int = 8, value: str = "gray") -> DataFrame:
    """(r, c, g): a Gaussian over rows and then columns, the border mirrored."""
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(half + 1)]
    d = haloed(reflected(pixels, half, value), half)
    for v, across, along in ((value, "r", "c"), ("g", "c", "r")):
        w = W.partitionBy("br", "bc", across).orderBy(along)
        taps = [F.lit(weights[abs(k)]) * (F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w) if k else F.col(v)) for k in range(-half, half + 1)]
        d = d.select("br", "bc", "r", "c", (sum(taps[1:], taps[0]) / (weights[0] + 2 * sum(weights[1:]))).alias("g"))
    return inside(own(d), pixels)


def morphed(mask: DataFrame, *steps: tuple[Callable[[Column], Column], int]) -> DataFrame:
    """Pixels with a 0 or 1 as `m` after minima and maxima (agg, half) over squares, clipped at the image."""
    for agg, half in steps:
        mask = box_window(mask, "m", half, agg, "n").select("r", "c", F.col("n").alias("m"))
    return mask


def tensor(pixels: DataFrame, half: int = 4) -> DataFrame:
    """The structure tensor of pixels whose whole window lies inside: orientation of the gradient in degrees
    modulo 180, energy and coherence, from window means of products of Sobel gradients."""
    g = {"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")}
    n = (2 * half + 1) ** 2
    s = box_sums(sobel(pixels), g, half).where(F.col("__n") == n)
    xx, yy, xy = (F.col(k) / float(n) for k in ("xx", "yy", "xy"))
    energy = xx + yy
    theta = F.pmod(0.5 * F.degrees(F.atan2(2.0 * xy, xx - yy)), F.lit(180.0))
    coherence = F.sqrt((xx - yy) * (xx - yy) + 4.0 * xy * xy) / (energy + 1e-6)
    return s.select("r", "c", theta.alias("theta"), energy.alias("energy"), coherence.alias("coherence"))


def neighbours(pixels: DataFrame, value: str = "gray") -> DataFrame:
    """Each interior pixel with its 3 by 3 neighbourhood as v_rc, r and c in (m, 0, p)."""
    d = haloed(pixels, 1)
    row = W.partitionBy("br", "bc", "r").orderBy("c")
    col = W.partitionBy("br", "bc", "c").orderBy("r")
    for n, f in (("m", F.lag), ("p", F.lead)):
        d = d.withColumn(f"v_0{n}", f(value).over(row))
    d = d.withColumn("v_00", F.col(value))
    for n, f in (("m", F.lag), ("p", F.lead)):
        for k in "m0p":
            d = d.withColumn(f"v_{n}{k}", f(f"v_0{k}").over(col))
    return own(d).where("v_mm is not null and v_pp is not null and v_mp is not null and v_pm is not null")


def sobel(pixels: DataFrame) -> DataFrame:
    """gx and gy of interior pixels."""
    v = lambda k: F.col("v_" + k)
    gx = v("mp") + 2 * v("0p") + v("pp") - v("mm") - 2 * v("0m") - v("pm")
    gy = v("pm") + 2 * v("p0") + v("pp") - v("mm") - 2 * v("m0") - v("mp")
    return neighbours(pixels).select("r", "c", gx.alias("gx"), gy.alias("gy"))


def label_components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Labels from 1 of the connected True pixels of a block, by their first pixel."""
    n = mask.size
    label = np.where(mask, np.arange(n).reshape(mask.shape), n)
    while True:
        low = label.copy()
        for dr, dc in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if eight else ())):
            a = label[: label.shape[0] - dr or None, max(0, -dc) : label.shape[1] - max(0, dc)]
            b = label[dr:, max(0, dc) : label.shape[1] + min(0, dc) or None]
            both = (a < n) & (b < n)
            m = np.minimum(a, b)
            la = low[: label.shape[0] - dr or None, max(0, -dc) : label.shape[1] - max(0, dc)]
            lb = low[dr:, max(0, dc) : label.shape[1] + min(0, dc) or None]
            la[both] = np.minimum(la[both], m[both])
            lb[both] = np.minimum(lb[both], m[both])
        flat = np.append(low.ravel(), n)
        while (flat[flat] != flat).any():
            flat = flat[flat]
        low = flat[:-1].reshape(mask.shape)
        if (low == label).all():
            return np.where(mask, label + 1, 0)
        label = low


def components(pixels: DataFrame, eight: bool = False, block: int = BLOCK) -> DataFrame:
    """Connected components of a table of set pixels (r, c): adds `label`, r * 2**31 + c of a
    component's first pixel. Blocks are labelled by a kernel; labels that touch across blocks' edges
    are joined as a graph."""
    from atlasforge.operators.graph import connected

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0 = r.min(), c.min()
        mask = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), dtype=bool)
        mask[r - r0, c - c0] = True
        lab = label_components(mask, eight)[r - r0, c - c0] - 1
        first = (lab // mask.shape[1] + r0) * (1 << 31) + lab % mask.shape[1] + c0
        return pd.DataFrame({"r": r, "c": c, "local": first.astype(np.int64)})

    blocks = pixels.select("r", "c").distinct()
    local = blocks.groupBy(F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).applyInPandas(kernel, "r bigint, c bigint, local bigint")
    local = staged(local, "pixel-labels")
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    edge = local.where(f"r % {block} IN (0, {block - 1}) OR c % {block} IN (0, {block - 1})")
    shifted = edge.select(F.explode(F.array(*(F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c"), F.col("local").alias("other")) for a, b in steps))).alias("s")).select("s.*")
    seams = edge.join(shifted, ["r", "c"]).where("local <> other").select(F.col("local").alias("u"), F.col("other").alias("v")).distinct()
    roots = connected(seams)
    return local.join(roots, F.col("local") == F.col("node"), "left").select("r", "c", F.coalesce("component", "local").alias("label"))
