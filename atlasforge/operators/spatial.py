"""Spatial joins of boxes by grid cells.

Both sides are dealt to the cells of a grid that their boxes touch, so candidates meet by an
equi-join that shuffles on the cell; a pair that shares several cells is kept in the one with its
intersection's lower corner, which needs no distinct. Adaptive execution splits crowded cells. The
cell should be near the size of a typical box; larger boxes are dealt to more cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasforge.functions.columns import area, inter
from atlasforge.operators.nearest import nearest

CELL = 64


def cells(df: DataFrame, p: str, cell: int = CELL, pad: float = 0) -> DataFrame:
    """Adds __cx, __cy: every cell that the box touches after growing by pad."""
    low = lambda c: F.floor((F.col(p + c) - pad) / cell)
    high = lambda c: F.floor((F.col(p + c) + pad) / cell)
    return df.withColumn("__cx", F.explode(F.sequence(low("x0"), high("x1")))).withColumn("__cy", F.explode(F.sequence(low("y0"), high("y1"))))


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(p + c) for c in df.columns))


def overlapping(left: DataFrame, right: DataFrame, cell: int = CELL, touching: bool = False, a: str = "a_", b: str = "b_", also: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose boxes overlap (or also touch) and that agree in the columns `also`, which are part
    of the join's key; columns prefixed, with `inter`."""
    x, y = cells(prefixed(left, a), a, cell), cells(prefixed(right, b), b, cell)
    less = (lambda u, v: u <= v) if touching else (lambda u, v: u < v)
    col = F.col
    meets = less(col(a + "x0"), col(b + "x1")) & less(col(b + "x0"), col(a + "x1")) & less(col(a + "y0"), col(b + "y1")) & less(col(b + "y0"), col(a + "y1"))
    first = (F.floor(F.greatest(a + "x0", b + "x0") / cell) == col("__cx")) & (F.floor(F.greatest(a + "y0", b + "y0") / cell) == col("__cy"))
    x, y = (d.withColumns({f"__k{k}": F.col(p + c) for k, c in enumerate(also)}) for d, p in ((x, a), (y, b)))
    keys = [f"__k{k}" for k in range(len(also))]
    return x.join(y, [*keys, "__cx", "__cy"]).where(meets & first).drop(*keys).drop("__cx", "__cy").withColumn("inter", inter(a, b))


def self_overlaps(df: DataFrame, more_than: float, key: str = "id", cell: int = CELL) -> DataFrame:
    """Pairs a < b by key of one table that share more than an area."""
    return overlapping(df, df, cell).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & (F.col("inter") > more_than))


def best_match(pairs: DataFrame, key: str, other: str, value: Column) -> DataFrame:
    """For each key the other row with the highest value, the smallest id among equals: (key, other, best)."""
    top = F.max(F.struct(value.alias("v"), (-F.col(other)).alias("o")))
    return pairs.groupBy(key).agg(top.alias("t")).select(key, (-F.col("t.o")).alias(other), F.col("t.v").alias("best"))


def covered_share(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(key, covered): the summed share of each left box that right boxes cover, 0 where none does."""
    sums = overlapping(left, right).groupBy(F.col(f"a_{key}").alias(key)).agg(F.sum("inter").alias("s"))
    return left.join(sums, key, "left").select(key, (F.coalesce("s", F.lit(0)) / area()).alias("covered"))


def points_in(points: DataFrame, boxes: DataFrame, px: str, py: str, key: str, missing: int = -1) -> DataFrame:
    """The points with the smallest key of the half-open boxes that hold them, or `missing`; the boxes'
    cells are joined, so a point goes to one cell."""
    b = cells(prefixed(boxes, "b_"), "b_")
    at = points.withColumn("__cx", F.floor(F.col(px) / CELL)).withColumn("__cy", F.floor(F.col(py) / CELL))
    held = (F.col(px) >= F.col("b_x0")) & (F.col(px) < F.col("b_x1")) & (F.col(py) >= F.col("b_y0")) & (F.col(py) < F.col("b_y1"))
    b = b.withColumnsRenamed({"__cx": "__bx", "__cy": "__by"})
    at = at.withColumn("__row", F.monotonically_increasing_id())
    found = at.join(b, (F.col("__cx") == F.col("__bx")) & (F.col("__cy") == F.col("__by")) & held, "left")
    rest = [F.first(c).alias(c) for c in points.columns]
    return found.groupBy("__row").agg(*rest, F.min("b_" + key).alias(key)).drop("__row").withColumn(key, F.coalesce(key, F.lit(missing)))


def nearest_segments(points: DataFrame, segments: DataFrame, radius: int, distance: Callable[..., Column], keys: list[str]) -> DataFrame:
    """For each point (px, py) the least distance(px, py, ax, ay, bx, by) to a segment (ends ax .. by, box columns
    s_x0 ..) within a radius: keys, dist; the distance is the Euclidean one. A segment goes to the tiles that it
    comes near, not to all of its box, and a tile looks for its places' segments by `nearest.nearest`; a place
    that many points share is measured once, and so is a segment that comes many times."""
    ends, tile = ("ax", "ay", "bx", "by"), 8 * radius
    col = lambda c: F.col(c).cast("double")
    s = cells(segments.select(*ends, "s_x0", "s_y0", "s_x1", "s_y1").distinct(), "s_", tile, pad=radius)
    centre = [(F.col(c) + 0.5) * tile for c in ("__cx", "__cy")]
    s = s.where(distance(*centre, *map(col, ends)) <= radius + tile * 0.7072)  # the radius and half a tile's diagonal, rounded up
    place = points.select("px", "py").where("px IS NOT NULL AND py IS NOT NULL").distinct()
    at = place.withColumn("__cx", F.floor(F.col("px") / tile)).withColumn("__cy", F.floor(F.col("py") / tile))

    def run(key: tuple[pa.Scalar, ...], here: pa.Table, lines: pa.Table) -> pa.Table:
        of = lambda table, names: [table.column(c).to_numpy().astype(float) - float(k.as_py() * tile) for c, k in zip(names, key * 2, strict=False)]
        best = nearest(of(here, ("px", "py")), of(lines, ends), radius, tile)
        found = pa.array(np.flatnonzero(best >= 0))
        taken = lines.select(ends).take(pa.array(best[best >= 0]))
        return pa.table([*here.select(("px", "py")).take(found).columns, *taken.columns], names=["px", "py", *ends])

    types = dict(place.dtypes) | dict(s.dtypes)
    deal = ["__cx", "__cy"]
    met = at.groupBy(*deal).cogroup(s.select(*ends, *deal).groupBy(*deal)).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("px", "py", *ends)))
    near = met.select("px", "py", distance(*map(col, ("px", "py", *ends))).alias("dist")).where(F.col("dist") <= radius)
    return points.hint("merge").join(near, ["px", "py"]).groupBy(*keys).agg(F.min("dist").alias("dist"))


def union_area(boxes: DataFrame, group: str) -> DataFrame:
    """(group, area) of the union of each group's boxes: the strips between neighbouring x hold the boxes
    over them, whose y ranges are merged in order. A row is a box in a strip, never a unit of area."""
    boxes = boxes.where("x0 < x1 AND y0 < y1").select(group, "x0", "y0", "x1", "y1").distinct()
    at = boxes.select(group, F.explode(F.array("x0", "x1")).alias("lo")).distinct()
    strips = at.withColumn("hi", F.lead("lo").over(Window.partitionBy(group).orderBy("lo"))).where("hi IS NOT NULL")
    ys = strips.join(boxes, group).where("x0 <= lo AND x1 >= hi")
    earlier = F.max("y1").over(Window.partitionBy(group, "lo").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    fresh = ys.withColumn("__top", F.greatest(F.coalesce(earlier, F.col("y0")), F.col("y0")))
    return fresh.groupBy(group).agg(F.sum((F.col("hi") - F.col("lo")) * F.greatest(F.col("y1") - F.col("__top"), F.lit(0))).alias("area"))
