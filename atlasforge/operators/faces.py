"""Lines to faces: segments are cut where they meet, and faces are the cycles of sides around them.

Nothing here is a kernel: cutting is a box join, the next side around a corner a window over that corner's
sides, and a cycle a connected component of sides, so a whole city's network need not fit into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasforge.operators.graph import connected_near
from atlasforge.operators.spatial import CELL, overlapping
from atlasforge.staging import staged

PLACES = 6
C = F.col


def short_segments(segments: DataFrame, longest: float) -> DataFrame:
    """(id, px, py, qx, qy) of segments (x0, y0, x1, y1) cut to at most a length; points and rows with nulls go.
    A cut makes a corner of two sides, which changes no face."""
    size = F.hypot(C("x1") - C("x0"), C("y1") - C("y0"))
    d = segments.select(*(C(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1"))).where(size > 0)
    d = d.withColumn("n", F.ceil(size / longest)).withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    at = lambda a, b, k: F.round(C(a) + (C(b) - C(a)) * k / C("n"), PLACES) + 0.0
    d = d.select(at("x0", "x1", C("k") - 1).alias("px"), at("y0", "y1", C("k") - 1).alias("py"), at("x0", "x1", C("k")).alias("qx"), at("y0", "y1", C("k")).alias("qy"))
    turned = F.struct("px", "py") > F.struct("qx", "qy")
    ends = [F.when(turned, C(b)).otherwise(C(a)).alias(a) for a, b in (("px", "qx"), ("py", "qy"), ("qx", "px"), ("qy", "py"))]
    return d.select(*ends).distinct().select(F.xxhash64("px", "py", "qx", "qy").alias("id"), "*")


def noded(segments: DataFrame, cell: int = CELL) -> DataFrame:
    """Distinct sides (px, py, qx, qy), p before q, of segments cut wherever two of them meet; lines that run along each
    other share sides. Points are rounded to `PLACES`."""
    s = staged(short_segments(segments, cell), "segments")
    box = s.select("*", F.least("px", "qx").alias("x0"), F.least("py", "qy").alias("y0"), F.greatest("px", "qx").alias("x1"), F.greatest("py", "qy").alias("y1"))
    pair = overlapping(box, box, cell, touching=True).where("a_id < b_id")
    cross = "((a_qx - a_px) * (b_qy - b_py) - (a_qy - a_py) * (b_qx - b_px))"
    long = "(hypot(a_qx - a_px, a_qy - a_py) * hypot(b_qx - b_px, b_qy - b_py))"
    t = "((b_px - a_px) * (b_qy - b_py) - (b_py - a_py) * (b_qx - b_px)) / cross"
    u = "((b_px - a_px) * (a_qy - a_py) - (b_py - a_py) * (a_qx - a_px)) / cross"
    pair = pair.withColumn("cross", F.expr(cross)).withColumn("along", F.expr(f"abs(cross) <= 1e-7 * {long}"))
    pair = pair.withColumn("t", F.expr(f"CASE WHEN NOT along THEN {t} END")).withColumn("u", F.expr(f"CASE WHEN NOT along THEN {u} END"))
    spot = F.struct((F.round(F.expr("a_px + t * (a_qx - a_px)"), PLACES) + 0.0).alias("x"), (F.round(F.expr("a_py + t * (a_qy - a_py)"), PLACES) + 0.0).alias("y"))
    met = F.when(F.expr("t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9"), F.array(spot))

    def ends(of: str, on: str):
        """Ends of one segment that lie on the other one."""
        near = f"abs((p.x - {on}_px) * ({on}_qy - {on}_py) - (p.y - {on}_py) * ({on}_qx - {on}_px)) <= 1e-5 * hypot({on}_qx - {on}_px, {on}_qy - {on}_py)"
        between = f"p.x BETWEEN {on}_x0 - 1e-6 AND {on}_x1 + 1e-6 AND p.y BETWEEN {on}_y0 - 1e-6 AND {on}_y1 + 1e-6"
        return f"filter(array(named_struct('x', {of}_px, 'y', {of}_py), named_struct('x', {of}_qx, 'y', {of}_qy)), p -> {near} AND {between})"

    none = F.expr("cast(array() AS array<struct<x: double, y: double>>)")
    points = F.when(C("along"), F.expr(f"concat({ends('a', 'b')}, {ends('b', 'a')})")).otherwise(F.coalesce(met, none))
    cut = pair.select("a_id", "b_id", F.explode(points).alias("p"))
    cut = cut.select(F.explode(F.array("a_id", "b_id")).alias("id"), "p.x", "p.y")
    own = s.select("id", F.explode(F.expr("array(named_struct('x', px, 'y', py), named_struct('x', qx, 'y', qy))")).alias("p")).select("id", "p.x", "p.y")
    w = W.partitionBy("id").orderBy("x", "y")  # a segment is monotone in x, or in y where x stands still
    step = cut.union(own).distinct().select(C("x").alias("qx"), C("y").alias("qy"), F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py")).where("px IS NOT NULL")
    turned = F.struct("px", "py") > F.struct("qx", "qy")
    return step.select(*(F.when(turned, C(b)).otherwise(C(a)).alias(a) for a, b in (("px", "qx"), ("py", "qy"), ("qx", "px"), ("qy", "py")))).distinct()


def faces(segments: DataFrame, least: float = 0.0, cell: int = CELL) -> DataFrame:
    """(face, x0, y0, x1, y1, area, sides) of the bounded faces of more than an area that segments (x0, y0, x1, y1)
    enclose. Sides with a free end add nothing; what lies apart inside a face isn't cut out of it."""
    one = noded(segments, cell)
    both = one.union(one.select("qx", "qy", "px", "py"))  # by position: each side in its two directions
    around = W.partitionBy("px", "py").orderBy(F.atan2(C("qy") - C("py"), C("qx") - C("px")), "qx", "qy")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    end = F.struct("qx", "qy")
    turn = F.coalesce(F.lag(end).over(around), F.last(end).over(whole))
    d = both.select("*", turn.alias("n"))
    # the side that comes in along a corner's side goes out by the one before it in turning order
    sides = d.select(F.xxhash64("qx", "qy", "px", "py").alias("u"), F.xxhash64("px", "py", "n.qx", "n.qy").alias("v"), C("qx").alias("ax"), C("qy").alias("ay"), C("px").alias("bx"), C("py").alias("by"))
    sides = staged(sides, "face-sides")
    tile = [F.floor(C(k) / (64 * cell)) for k in ("bx", "by")]  # a cycle goes on where its side ends
    cycle = connected_near(sides, *tile, C("bx"), C("by"))
    g = sides.join(cycle, C("u") == C("node")).groupBy(C("component").alias("face")).agg(F.min("ax").alias("x0"), F.min("ay").alias("y0"), F.max("ax").alias("x1"), F.max("ay").alias("y1"), (F.sum(F.expr("ax * by - bx * ay")) / 2).alias("area"), F.count("*").alias("sides"))
    return g.where((C("area") > least) & (C("area") > 1e-6))
