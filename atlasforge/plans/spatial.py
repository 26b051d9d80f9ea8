"""Queries with geometry: spatial joins, boxes, lines, tiles, pixels, matching."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasforge.functions.columns import angle_gap, area, iou, ladder, path_length, ring_area, rounded, segment_distance
from atlasforge.operators import raster as R
from atlasforge.operators.matching import match
from atlasforge.operators.spatial import best_match, covered_share, nearest_segments, overlapping, points_in, prefixed, self_overlaps
from atlasforge.plans.registry import query

C = F.col


def pair_iou():
    """Intersection over union of a joined pair."""
    return iou(C("inter"), area("a_"), area("b_"))


def pairs_of(t):
    """Parcels (a_) with the candidates (b_) that overlap them."""
    return overlapping(t.parcels, t.candidates)


@query("sjoin_intersects", "pairs", "SELECT a_id, b_id, inter FROM pairs")
def sjoin_intersects(t):
    return pairs_of(t).select("a_id", "b_id", "inter")


@query("iou_pairs", "pairs", "SELECT a_id, b_id, round_even(inter / CAST(a_area + b_area - inter AS DOUBLE), 6) AS iou, round_even(inter / CAST(b_area AS DOUBLE), 6) AS precision, round_even(inter / CAST(a_area AS DOUBLE), 6) AS recall FROM pairs")
def iou_pairs(t):
    return pairs_of(t).select("a_id", "b_id", rounded(pair_iou()).alias("iou"), rounded(C("inter") / area("b_")).alias("precision"), rounded(C("inter") / area("a_")).alias("recall"))


@query("best_iou", "pairs", "SELECT a_id AS id, arg_max(b_id, (inter / CAST(a_area + b_area - inter AS DOUBLE), -b_id)) AS b_id, round_even(max(inter / CAST(a_area + b_area - inter AS DOUBLE)), 6) AS best FROM pairs GROUP BY 1")
def best_iou(t):
    return best_match(pairs_of(t), "a_id", "b_id", pair_iou()).select(C("a_id").alias("id"), "b_id", rounded(C("best")).alias("best"))


_SUMMARY = """WITH b AS (SELECT p.id, coalesce(max(inter / CAST(a_area + b_area - inter AS DOUBLE)), 0) AS best, count(b_id) AS n FROM parcels p LEFT JOIN pairs ON p.id = a_id GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'blank_plate' WHEN best >= 0.5 AND n > 1 THEN 'traced_merged_cells' WHEN best >= 0.5 THEN 'traced_single_cell' ELSE 'loose_placement' END AS cell_class, count(*) AS parcels, round_even(median(best), 6) AS median_iou, round_even(quantile_cont(best, 0.1), 6) AS p10_iou FROM b GROUP BY 1"""


@query("parcel_qa_summary", "pairs", _SUMMARY)
def parcel_qa_summary(t):
    """The flagship: each parcel's best candidate, its class, and a summary by class."""
    b = pairs_of(t).groupBy(C("a_id").alias("id")).agg(F.max(pair_iou()).alias("best"), F.count("*").alias("n"))
    j = t.parcels.join(b, "id", "left").select(F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("n", F.lit(0)).alias("n"))
    cls = ladder((C("n") == 0, "blank_plate"), ((C("best") >= 0.5) & (C("n") > 1), "traced_merged_cells"), (C("best") >= 0.5, "traced_single_cell"), default="loose_placement")
    return j.groupBy(cls.alias("cell_class")).agg(F.count("*").alias("parcels"), rounded(F.percentile("best", 0.5)).alias("median_iou"), rounded(F.percentile("best", 0.1)).alias("p10_iou"))


@query("cell_class", "pairs qa_flags", """SELECT p.id, CASE WHEN q.id IS NULL THEN 'off_plate' WHEN count(b_id) = 0 THEN 'blank_plate' WHEN count_if(inter * 5 >= b_area) >= 2 THEN 'traced_merged_cells' WHEN max(inter / CAST(a_area + b_area - inter AS DOUBLE)) >= 0.5 THEN 'traced_single_cell' ELSE 'loose_placement' END AS cell_class
FROM parcels p LEFT JOIN pairs ON p.id = a_id LEFT JOIN qa_flags q ON p.id = q.id GROUP BY p.id, q.id""")
def cell_class(t):
    b = pairs_of(t).groupBy(C("a_id").alias("id")).agg(F.max(pair_iou()).alias("best"), F.count_if(C("inter") * 5 >= area("b_")).alias("spanned"))
    j = t.parcels.select("id").join(b, "id", "left").join(t.qa_flags.select("id", "on_plate"), "id", "left")
    return j.select("id", ladder((C("on_plate").isNull(), "off_plate"), (C("best").isNull(), "blank_plate"), (C("spanned") >= 2, "traced_merged_cells"), (C("best") >= 0.5, "traced_single_cell"), default="loose_placement").alias("cell_class"))


@query("overlap_pairs", "candidates", "SELECT a.id AS a_id, b.id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter FROM candidates a JOIN candidates b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 100")
def overlap_pairs(t):
    return self_overlaps(t.candidates, 100).select("a_id", "b_id", "inter")


@query("topk_overlaps", "pairs", "SELECT a_id, b_id, inter FROM pairs ORDER BY inter DESC, a_id, b_id LIMIT 25")
def topk_overlaps(t):
    return sjoin_intersects(t).orderBy(C("inter").desc(), "a_id", "b_id").limit(25)


@query("coverage_frac", "pairs", "SELECT p.id, round_even(coalesce(sum(inter), 0) / CAST((p.x1 - p.x0) * (p.y1 - p.y0) AS DOUBLE), 6) AS covered FROM parcels p LEFT JOIN pairs ON p.id = a_id GROUP BY p.id, p.x0, p.x1, p.y0, p.y1")
def coverage_frac(t):
    return covered_share(t.parcels, t.candidates).select("id", rounded(C("covered")).alias("covered"))


@query("carry_over", "pairs", "SELECT b_id AS id, 'machine' AS layer FROM (SELECT id AS b_id FROM candidates) UNION ALL SELECT p.id, 'carried' AS layer FROM parcels p LEFT JOIN pairs ON p.id = a_id GROUP BY p.id, p.x0, p.x1, p.y0, p.y1 HAVING coalesce(sum(inter), 0) * 2 < (p.x1 - p.x0) * (p.y1 - p.y0)")
def carry_over(t):
    """New candidates, and old parcels of which less than half is covered."""
    old = covered_share(t.parcels, t.candidates).where("covered < 0.5").select("id", F.lit("carried").alias("layer"))
    return t.candidates.select("id", F.lit("machine").alias("layer")).unionByName(old)


@query("shadow_dedupe", "candidates", "WITH c AS (SELECT *, (x1 - x0) * (y1 - y0) AS a, floor(x0 / 100.0) <> floor((x1 - 1) / 100.0) OR floor(y0 / 100.0) <> floor((y1 - 1) / 100.0) AS dup FROM candidates) SELECT id FROM c r WHERE NOT EXISTS (SELECT 1 FROM c o WHERE (r.dup OR r.a > 1000) AND o.id <> r.id AND o.x0 < r.x1 AND r.x0 < o.x1 AND o.y0 < r.y1 AND r.y0 < o.y1 AND (least(o.x1, r.x1) - greatest(o.x0, r.x0)) * (least(o.y1, r.y1) - greatest(o.y0, r.y0)) > 0.6 * least(o.a, r.a) AND (o.a > r.a OR o.a = r.a AND o.id < r.id))")
def shadow_dedupe(t):
    """Boxes over a tile's edge, or large ones, go if they lie mostly in a larger one, or an equal one with
    a lower id. A pair is looked at once, for the one of it that would go."""
    p = self_overlaps(t.candidates, 0).where(C("inter") > 0.6 * F.least(area("a_"), area("b_")))
    loser = F.when(area("a_") < area("b_"), "a").otherwise("b")  # equal ones: b has the higher id
    pick = lambda c: F.when(C("loser") == "a", C("a_" + c)).otherwise(C("b_" + c)).alias(c)
    lost = p.withColumn("loser", loser).select(*(pick(c) for c in ("id", "x0", "y0", "x1", "y1")))
    over = lambda a, b: F.floor(C(a) / 100) != F.floor((C(b) - 1) / 100)
    gone = lost.where(over("x0", "x1") | over("y0", "y1") | (area() > 1000)).select("id").distinct()
    return t.candidates.select("id").join(gone, "id", "left_anti")


@query("find_under", "pairs", "SELECT a_id, b_id FROM pairs WHERE inter * 10 >= b_area * 4")
def find_under(t):
    return pairs_of(t).where(C("inter") * 10 >= area("b_") * 4).select("a_id", "b_id")


@query("best_overlap", "pairs", "SELECT a_id AS id, arg_max(b_id, (s, -b_id)) AS b_id FROM (SELECT *, inter / CAST(least(a_area, b_area) AS DOUBLE) AS s FROM pairs) GROUP BY 1 HAVING max(s) >= 0.25")
def best_overlap(t):
    share = C("inter") / F.least(area("a_"), area("b_"))
    return best_match(pairs_of(t), "a_id", "b_id", share).where("best >= 0.25").select(C("a_id").alias("id"), "b_id")


@query("touch_tiles", "candidates", "WITH x AS (SELECT unnest(range(-200, (SELECT max(x1) + 200 FROM candidates), 100)) AS x0), y AS (SELECT unnest(range(-200, (SELECT max(y1) + 200 FROM candidates), 100)) AS y0) SELECT DISTINCT x.x0, y.y0 FROM x, y, candidates c WHERE (c.x1 - c.x0) * (c.y1 - c.y0) > 900 AND x.x0 <= c.x1 AND c.x0 <= x.x0 + 100 AND y.y0 <= c.y1 AND c.y0 <= y.y0 + 100")
def touch_tiles(t):
    """Tiles of 100 that a changed (here: large) box lies in or touches; each box names its own."""
    span = lambda a, b: F.explode(F.sequence(F.ceil(C(a) / 100) - 1, F.floor(C(b) / 100)))
    on = t.candidates.where(area() > 900).withColumn("i", span("x0", "x1")).withColumn("j", span("y0", "y1"))
    return on.select((C("i") * 100).alias("x0"), (C("j") * 100).alias("y0")).distinct()


@query("aoi_filter", "candidates", "SELECT id FROM candidates WHERE x0 < 900 AND x1 > 300 AND y0 < 700 AND y1 > 100")
def aoi_filter(t):
    return t.candidates.where("x0 < 900 AND x1 > 300 AND y0 < 700 AND y1 > 100").select("id")


@query("point_in_block", "candidates blocks", "SELECT c.id, coalesce(min(block_id), -1) AS block_id FROM candidates c LEFT JOIN blocks b ON floor((c.x0 + c.x1) / 2.0) >= b.x0 AND floor((c.x0 + c.x1) / 2.0) < b.x1 AND floor((c.y0 + c.y1) / 2.0) >= b.y0 AND floor((c.y0 + c.y1) / 2.0) < b.y1 GROUP BY 1")
def point_in_block(t):
    p = t.candidates.select("id", F.floor((C("x0") + C("x1")) / 2).alias("px"), F.floor((C("y0") + C("y1")) / 2).alias("py"))
    return points_in(p, t.blocks, "px", "py", "block_id").select("id", "block_id")


@query("block_subset", "candidates blocks", "SELECT 'B' || block_id || '-' || c.id AS uid FROM candidates c JOIN blocks b ON c.x0 >= b.x0 AND c.x0 < b.x1 AND c.y0 >= b.y0 AND c.y0 < b.y1 WHERE block_id IN (11, 12, 23)")
def block_subset(t):
    p = points_in(t.candidates.select("id", C("x0").alias("px"), C("y0").alias("py")), t.blocks.where("block_id IN (11, 12, 23)"), "px", "py", "block_id")
    return p.where("block_id >= 0").select(F.concat(F.lit("B"), "block_id", F.lit("-"), "id").alias("uid"))


@query("ref_block_check", "candidates blocks", "SELECT c.id FROM candidates c LEFT JOIN blocks b ON c.parcel_id % 100 = b.block_id AND c.x0 >= b.x0 AND c.x0 < b.x1 AND c.y0 >= b.y0 AND c.y0 < b.y1 WHERE b.block_id IS NULL")
def ref_block_check(t):
    """References that their declared block does not hold."""
    b = prefixed(t.blocks, "b_").withColumn("k", C("b_block_id"))
    held = t.candidates.withColumn("k", C("parcel_id") % 100).join(b, "k").where("x0 >= b_x0 AND x0 < b_x1 AND y0 >= b_y0 AND y0 < b_y1")
    return t.candidates.select("id").join(held.select("id"), "id", "left_anti")


@query("in_envelope", "parcels candidates", "SELECT id FROM candidates c WHERE EXISTS (SELECT 1 FROM parcels p WHERE c.x0 >= p.x0 - 25 AND c.x1 <= p.x1 + 25 AND c.y0 >= p.y0 - 25 AND c.y1 <= p.y1 + 25)")
def in_envelope(t):
    """Candidates within 25 of some reference box."""
    grown = t.parcels.selectExpr("id", "x0 - 25 x0", "y0 - 25 y0", "x1 + 25 x1", "y1 + 25 y1")
    p = overlapping(t.candidates, grown)
    return p.where("a_x0 >= b_x0 AND a_x1 <= b_x1 AND a_y0 >= b_y0 AND a_y1 <= b_y1").select(C("a_id").alias("id")).distinct()


_SEG = "SELECT line_id, pos, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS bey FROM line_points WHERE line_id % 2 = 0 WINDOW w AS (PARTITION BY line_id ORDER BY pos)"
_DIST = "CASE WHEN bx = ax AND bey = ay THEN sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay)) ELSE sqrt(power(px - ax - tt * (bx - ax), 2) + power(py - ay - tt * (bey - ay), 2)) END"


def segments(t):
    w = W.partitionBy("line_id").orderBy("pos")
    s = t.line_points.where("line_id % 2 = 0").select("line_id", C("x").alias("ax"), C("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx IS NOT NULL")
    return s.select("ax", "ay", "bx", "by", F.least("ax", "bx").alias("s_x0"), F.least("ay", "by").alias("s_y0"), F.greatest("ax", "bx").alias("s_x1"), F.greatest("ay", "by").alias("s_y1"))


_NEAR = f"""WITH s AS (SELECT * FROM ({_SEG}) WHERE bx IS NOT NULL), q AS (SELECT line_id, pos, x AS px, y AS py FROM line_points WHERE line_id % 2 = 1),
d AS (SELECT line_id, pos, px, py, ax, ay, bx, bey, least(1.0, greatest(0.0, ((px - ax) * (bx - ax) + (py - ay) * (bey - ay)) / CAST(nullif((bx - ax) * (bx - ax) + (bey - ay) * (bey - ay), 0) AS DOUBLE))) AS tt FROM q, (SELECT ax, ay, bx, bey FROM s) WHERE px BETWEEN least(ax, bx) - 15 AND greatest(ax, bx) + 15 AND py BETWEEN least(ay, bey) - 15 AND greatest(ay, bey) + 15),
n AS (SELECT line_id, pos, min({_DIST}) AS dist FROM d GROUP BY 1, 2 HAVING min({_DIST}) <= 15)"""


def near(t):
    q = t.line_points.where("line_id % 2 = 1").select("line_id", "pos", C("x").alias("px"), C("y").alias("py"))
    return nearest_segments(q, segments(t), 15, segment_distance, ["line_id", "pos"])


@query("nearest_line", "line_points", _NEAR + " SELECT line_id, pos, round_even(dist, 6) AS dist FROM n")
def nearest_line(t):
    """Vertices of odd (predicted) lines with the distance to the nearest segment of an even (reference) line
    within 15, by cells of that radius."""
    return near(t).select("line_id", "pos", rounded(C("dist")).alias("dist"))


@query("line_metrics", "line_points", _NEAR + " SELECT count(*) AS n15, count_if(dist <= 3) AS n3, count_if(dist <= 5) AS n5, count_if(dist <= 8) AS n8, round_even(median(dist), 6) AS median_offset, round_even(quantile_cont(dist, 0.9), 6) AS p90_offset FROM n")
def line_metrics(t):
    d = C("dist")
    return near(t).agg(F.count("*").alias("n15"), *(F.count_if(d <= k).alias(f"n{k}") for k in (3, 5, 8)), rounded(F.percentile("dist", 0.5)).alias("median_offset"), rounded(F.percentile("dist", 0.9)).alias("p90_offset"))


@query("tile_ownership", "candidates", "SELECT id, ((x0 + x1) // 2) // 100 AS tx, ((y0 + y1) // 2) // 100 AS ty, x0 // 100 <> (x1 - 1) // 100 OR y0 // 100 <> (y1 - 1) // 100 AS dup FROM candidates WHERE x0 + x1 >= 0 AND y0 + y1 >= 0")
def tile_ownership(t):
    """The tile that holds a box's centre, and whether it reaches over an edge; a computed key, no join."""
    k = lambda e: F.floor(e / 100)
    d = t.candidates.where("x0 + x1 >= 0 AND y0 + y1 >= 0")
    return d.select("id", k(F.floor((C("x0") + C("x1")) / 2)).alias("tx"), k(F.floor((C("y0") + C("y1")) / 2)).alias("ty"), ((F.expr("x0 div 100") != F.expr("(x1 - 1) div 100")) | (F.expr("y0 div 100") != F.expr("(y1 - 1) div 100"))).alias("dup"))


@query("raster_lookup", "raster parcels", "SELECT p.id, r.gray FROM parcels p LEFT JOIN raster r ON r.r = p.x0 // 4 AND r.c = p.y0 % 64")
def raster_lookup(t):
    return t.parcels.select("id", F.expr("x0 div 4").alias("r"), (C("y0") % 64).alias("c")).join(t.raster, ["r", "c"], "left").select("id", "gray")


@query("length_totals", "line_points", "SELECT round_even(sum(l), 4) AS total FROM (SELECT sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS l FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos))")
def length_totals(t):
    w = W.partitionBy("line_id").orderBy("pos")
    return t.line_points.select(F.hypot(C("x") - F.lag("x").over(w), C("y") - F.lag("y").over(w)).alias("l")).agg(rounded(F.sum("l"), 4).alias("total"))


def points_array(t):
    """Lines with their points in order."""
    p = t.line_points.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", C("x").cast("double").alias("x"), C("y").cast("double").alias("y")))).alias("pts"))
    return p


@query("geom_length", "line_points", "SELECT line_id, round_even(coalesce(sum(l), 0), 4) AS length FROM (SELECT line_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS l FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)) GROUP BY 1")
def geom_length(t):
    return points_array(t).select("line_id", rounded(path_length("pts"), 4).alias("length"))


@query("geom_area", "line_points", "SELECT line_id, abs(sum(x * ny - nx * y)) / 2.0::DOUBLE AS area FROM (SELECT line_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)) GROUP BY 1")
def geom_area(t):
    return points_array(t).select("line_id", ring_area("pts").alias("area"))


@query("geom_bounds", "line_points", "SELECT line_id, CAST(min(x) AS DOUBLE) AS x0, CAST(min(y) AS DOUBLE) AS y0, CAST(max(x) AS DOUBLE) AS x1, CAST(max(y) AS DOUBLE) AS y1 FROM line_points GROUP BY 1")
def geom_bounds(t):
    xs, ys = F.transform("pts", lambda p: p.x), F.transform("pts", lambda p: p.y)
    return points_array(t).select("line_id", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


@query("geom_centroid", "line_points", "WITH e AS (SELECT line_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, round_even(sum((x + nx) * (x * ny - nx * y)) / CAST(nullif(3 * sum(x * ny - nx * y), 0) AS DOUBLE), 6) AS cx, round_even(sum((y + ny) * (x * ny - nx * y)) / CAST(nullif(3 * sum(x * ny - nx * y), 0) AS DOUBLE), 6) AS cy FROM e GROUP BY 1")
def geom_centroid(t):
    """Weighted by the ring's area; null where that is 0."""
    from atlasforge.functions.columns import ring_centroid

    cx, cy = ring_centroid("pts")
    return points_array(t).select("line_id", rounded(cx).alias("cx"), rounded(cy).alias("cy"))


@query("rep_point", "candidates", "SELECT id, x0 + (x1 - x0) // 2 AS px, y0 + (y1 - y0) // 2 AS py FROM candidates")
def rep_point(t):
    return t.candidates.selectExpr("id", "x0 + (x1 - x0) div 2 px", "y0 + (y1 - y0) div 2 py")


@query("point_line_distance", "parcels", "SELECT id, round_even(sqrt(power(x0 - 100 - u * 900, 2) + power(y0 - 200 - u * 700, 2)), 6) AS d FROM (SELECT id, x0, y0, least(1.0, greatest(0.0, ((x0 - 100) * 900 + (y0 - 200) * 700) / CAST(900 * 900 + 700 * 700 AS DOUBLE))) AS u FROM parcels)")
def point_line_distance(t):
    """To the segment from (100, 200) to (1000, 900)."""
    d = segment_distance(C("x0").cast("double"), C("y0").cast("double"), F.lit(100.0), F.lit(200.0), F.lit(1000.0), F.lit(900.0))
    return t.parcels.select("id", rounded(d).alias("d"))


@query("line_interpolate", "line_points", """WITH s AS (SELECT line_id, pos, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)), l AS (SELECT *, sqrt(power(x - px, 2) + power(y - py, 2)) AS d FROM s WHERE px IS NOT NULL), k AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY pos) AS upto, 0.25 * sum(d) OVER (PARTITION BY line_id) AS want FROM l),
f AS (SELECT line_id, arg_min(px + (x - px) * (want - upto + d) / d, pos) AS x, arg_min(py + (y - py) * (want - upto + d) / d, pos) AS y FROM k WHERE d > 0 AND upto >= want GROUP BY 1)
SELECT p.line_id, round_even(coalesce(f.x, p.x), 4) AS x, round_even(coalesce(f.y, p.y), 4) AS y FROM (SELECT line_id, arg_min(x, pos) AS x, arg_min(y, pos) AS y FROM line_points GROUP BY 1) p LEFT JOIN f USING (line_id)""")
def line_interpolate(t):
    """The point at a quarter of each line's length."""
    from atlasforge.functions.columns import along

    d = points_array(t).withColumn("__length", path_length("pts")).withColumn("at", along("pts", 0.25))
    return d.select("line_id", rounded(C("at.x"), 4).alias("x"), rounded(C("at.y"), 4).alias("y"))


@query("clip_box", "pairs", "SELECT p.id AS a_id, c.id AS b_id, greatest(p.x0, c.x0) AS x0, greatest(p.y0, c.y0) AS y0, least(p.x1, c.x1) AS x1, least(p.y1, c.y1) AS y1 FROM parcels p JOIN candidates c ON p.x0 < c.x1 AND c.x0 < p.x1 AND p.y0 < c.y1 AND c.y0 < p.y1")
def clip_box(t):
    hi, lo = (lambda c: F.greatest("a_" + c, "b_" + c).alias(c)), (lambda c: F.least("a_" + c, "b_" + c).alias(c))
    return pairs_of(t).select("a_id", "b_id", hi("x0"), hi("y0"), lo("x1"), lo("y1"))


@query("overhang_frac", "pairs", "SELECT b_id, a_id, round_even((b_area - inter) / CAST(b_area AS DOUBLE), 6) AS over FROM pairs")
def overhang_frac(t):
    return pairs_of(t).select("b_id", "a_id", rounded((area("b_") - C("inter")) / area("b_")).alias("over"))


@query("buffer_box", "parcels", "SELECT id, x0 - 3 AS x0, y0 - 3 AS y0, x1 + 3 AS x1, y1 + 3 AS y1, (x1 - x0 + 6) * (y1 - y0 + 6) - (x1 - x0) * (y1 - y0) AS ring FROM parcels")
def buffer_box(t):
    grown = t.parcels.select("id", *((C(c) - 3).alias(c) for c in ("x0", "y0")), *((C(c) + 3).alias(c) for c in ("x1", "y1")), area().alias("a"))
    return grown.select("id", "x0", "y0", "x1", "y1", (area() - C("a")).alias("ring"))


@query("rotate_points", "parcels", "SELECT id, round_even(x0 * cos(radians(30)) - y0 * sin(radians(30)), 6) AS x, round_even(x0 * sin(radians(30)) + y0 * cos(radians(30)), 6) AS y FROM parcels")
def rotate_points(t):
    a = F.radians(F.lit(30))
    return t.parcels.select("id", rounded(C("x0") * F.cos(a) - C("y0") * F.sin(a)).alias("x"), rounded(C("x0") * F.sin(a) + C("y0") * F.cos(a)).alias("y"))


@query("px_to_map_bbox", "findings", "SELECT id, 1000 + x0 * 0.5::DOUBLE AS mx0, 5000 - y1 * 0.5::DOUBLE AS my0, 1000 + x1 * 0.5::DOUBLE AS mx1, 5000 - y0 * 0.5::DOUBLE AS my1 FROM findings")
def px_to_map_bbox(t):
    return t.findings.select("id", (1000 + C("x0") * 0.5).alias("mx0"), (5000 - C("y1") * 0.5).alias("my0"), (1000 + C("x1") * 0.5).alias("mx1"), (5000 - C("y0") * 0.5).alias("my1"))


@query("merc_to_wgs84", "parcels", "SELECT id, round_even(degrees((x0 - 8238000) / 6378137.0::DOUBLE), 9) AS lon, round_even(degrees(2 * atan(exp((y0 + 4970000) / 6378137.0::DOUBLE)) - pi() / 2), 9) AS lat FROM parcels")
def merc_to_wgs84(t):
    from atlasforge.functions.crs import mercator_lat, mercator_lon

    return t.parcels.select("id", rounded(mercator_lon(C("x0") - 8238000), 9).alias("lon"), rounded(mercator_lat(C("y0") + 4970000), 9).alias("lat"))


@query("merc_to_utm18")
def merc_to_utm18(t):
    from atlasforge.functions.crs import mercator_lat, mercator_lon, utm

    e, n = utm(mercator_lon(C("x0") - 8238000), mercator_lat(C("y0") + 4970000), 18)
    return t.parcels.select("id", e.alias("easting"), n.alias("northing"))


@query("shift_baseline", "parcels", "SELECT id, x0 + dx AS x0, y0 + dy AS y0 FROM parcels, (VALUES (4, 0), (-4, 0), (0, 4), (0, -4)) s(dx, dy)")
def shift_baseline(t):
    shifts = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((4, 0), (-4, 0), (0, 4), (0, -4))))
    return t.parcels.withColumn("s", F.explode(shifts)).select("id", (C("x0") + C("s.dx")).alias("x0"), (C("y0") + C("s.dy")).alias("y0"))


_FLAGS = """WITH f AS (SELECT a_id, b_id, inter / CAST(a_area + b_area - inter AS DOUBLE) AS iou, inter / CAST(a_area AS DOUBLE) AS of_ref, inter / CAST(b_area AS DOUBLE) AS of_pred, a_area, b_area FROM pairs), c AS (SELECT b_id, count_if(of_ref >= 0.3) AS covers FROM f GROUP BY 1),
r AS (SELECT a_id, max(iou) AS best, arg_max(b_id, (iou, -b_id)) AS top, arg_max(b_id, (iou, -b_id)) FILTER (WHERE of_ref >= 0.3) AS covering, count_if(of_pred >= 0.5) AS inside, sum(of_ref) AS covered, max(a_area) AS a_area FROM f GROUP BY 1)
SELECT p.id, coalesce(best >= 0.5, false) AS matched, CASE WHEN best >= 0.5 THEN top END AS pred, round_even(coalesce(best, 0), 6) AS best_iou, coalesce(inside >= 2 AND covered >= 0.5, false) AS split_flag, coalesce(covers >= 2, false) AS merge_flag, coalesce((x.x1 - x.x0) * (x.y1 - x.y0) > 2 * a_area, false) AS oversize_flag, best IS NOT NULL AS any_overlap
FROM parcels p LEFT JOIN r ON p.id = a_id LEFT JOIN c ON c.b_id = CASE WHEN best >= 0.5 THEN top ELSE covering END LEFT JOIN candidates x ON x.id = CASE WHEN best >= 0.5 THEN top ELSE covering END"""


@query("match_flags", "parcels candidates pairs", _FLAGS)
def match_flags(t):
    """Each parcel's one-to-one match at 0.5 and its split, merge and oversize flags. (Here no candidate
    reaches two parcels, so the best one is the assigned one; the unit tests have such cases.)"""
    from atlasforge.operators.matching import match_flags as flags

    found = flags(t.parcels, t.candidates)
    return found.select("id", "matched", "pred", rounded(C("best_iou")).alias("best_iou"), "split_flag", "merge_flag", "oversize_flag", "any_overlap")


@query("split_merge_counts", "pairs", "WITH f AS (SELECT *, inter / CAST(a_area + b_area - inter AS DOUBLE) AS iou FROM pairs) SELECT (SELECT count(*) FROM (SELECT a_id FROM f WHERE iou > 0.1 GROUP BY 1 HAVING count(*) > 1)) AS possible_splits, (SELECT count(*) FROM (SELECT b_id FROM f WHERE iou > 0.1 GROUP BY 1 HAVING count(*) > 1)) AS possible_merges")
def split_merge_counts(t):
    f = pairs_of(t).where(pair_iou() > 0.1)
    a = f.groupBy("a_id").count().where("count > 1").agg(F.count("*").alias("possible_splits"))
    b = f.groupBy("b_id").count().where("count > 1").agg(F.count("*").alias("possible_merges"))
    return a.crossJoin(b)


def scored_pairs(t):
    return pairs_of(t).select(C("b_id").alias("pred"), C("a_id").alias("ref"), pair_iou().alias("iou"))


@query("match_max_card", "pairs", "SELECT count(DISTINCT a_id) AS tp FROM pairs WHERE inter / CAST(a_area + b_area - inter AS DOUBLE) >= 0.6")
def match_max_card(t):
    """One-to-one matches at 0.6: a candidate overlaps one parcel that far, so every parcel with one matches."""
    return match(scored_pairs(t), 0.6).agg(F.count("*").alias("tp"))


@query("match_sum_iou")
def match_sum_iou(t):
    return match(scored_pairs(t), 0.5, most_pairs=False).select("pred", "ref", rounded(C("iou")).alias("iou"))


@query("block_scores", "parcels candidates blocks pairs", """WITH r AS (SELECT p.id, b.block_id FROM parcels p JOIN blocks b ON (p.x0 + p.x1) // 2 >= b.x0 AND (p.x0 + p.x1) // 2 < b.x1 AND (p.y0 + p.y1) // 2 >= b.y0 AND (p.y0 + p.y1) // 2 < b.y1), c AS (SELECT p.id, b.block_id FROM candidates p JOIN blocks b ON floor((p.x0 + p.x1) / 2.0) >= b.x0 AND floor((p.x0 + p.x1) / 2.0) < b.x1 AND floor((p.y0 + p.y1) / 2.0) >= b.y0 AND floor((p.y0 + p.y1) / 2.0) < b.y1),
m AS (SELECT DISTINCT r.block_id, t, a_id FROM pairs JOIN r ON r.id = a_id JOIN c ON c.id = b_id AND c.block_id = r.block_id, (VALUES (0.6::DOUBLE), (0.8::DOUBLE)) v(t) WHERE inter / CAST(a_area + b_area - inter AS DOUBLE) >= t),
k AS (SELECT b.block_id, t AS threshold, (SELECT count(*) FROM m WHERE m.block_id = b.block_id AND m.t = v.t) AS tp, (SELECT count(*) FROM c WHERE c.block_id = b.block_id) AS preds, (SELECT count(*) FROM r WHERE r.block_id = b.block_id) AS refs FROM blocks b, (VALUES (0.6::DOUBLE), (0.8::DOUBLE)) v(t))
SELECT block_id, threshold, tp, preds - tp AS fp, refs - tp AS fn, round_even(tp / CAST(nullif(preds, 0) AS DOUBLE), 6) AS precision, round_even(tp / CAST(nullif(refs, 0) AS DOUBLE), 6) AS recall FROM k""")
def block_scores(t):
    """One-to-one matches within each block at two thresholds."""
    from atlasforge.operators.matching import block_scores as scores

    one = lambda x: scores(t.parcels, t.candidates, t.blocks, x).select("block_id", F.lit(x).alias("threshold"), "tp", "fp", "fn", rounded(C("precision")).alias("precision"), rounded(C("recall")).alias("recall"))
    return one(0.6).unionByName(one(0.8))


@query("ink_mask", "raster", "SELECT r, c FROM raster WHERE gray < 110")
def ink_mask(t):
    return t.raster.where("gray < 110").select("r", "c")


_LAGS = """(SELECT r, c, lag(l) OVER w AS v0, lag(gray) OVER w AS v1, lag(h) OVER w AS v2, l AS v3, h AS v4, lead(l) OVER w AS v5, lead(gray) OVER w AS v6, lead(h) OVER w AS v7 FROM (SELECT r, c, gray, lag(gray) OVER v AS l, lead(gray) OVER v AS h FROM raster WINDOW v AS (PARTITION BY r ORDER BY c)) WINDOW w AS (PARTITION BY c ORDER BY r))"""


_SOBEL = "SELECT r, c, v2 + 2 * v4 + v7 - v0 - 2 * v3 - v5 AS gx, v5 + 2 * v6 + v7 - v0 - 2 * v1 - v2 AS gy FROM " + _LAGS + " WHERE v0 IS NOT NULL AND v2 IS NOT NULL AND v5 IS NOT NULL AND v7 IS NOT NULL"


@query("sobel", "raster", _SOBEL)
def sobel(t):
    return R.sobel(t.raster)


_FIELDS = f"""(SELECT r, c, xx + yy AS energy, ((0.5 * degrees(atan2(2.0 * xy, xx - yy))) % 180 + 180) % 180 AS theta, sqrt((xx - yy) * (xx - yy) + 4.0 * xy * xy) / (xx + yy + 1e-6) AS coherence FROM (
SELECT r, c, sum(xx) OVER w / 81.0::DOUBLE AS xx, sum(yy) OVER w / 81.0::DOUBLE AS yy, sum(xy) OVER w / 81.0::DOUBLE AS xy, sum(n) OVER w AS n FROM (
SELECT r, c, sum(gx * gx) OVER v AS xx, sum(gy * gy) OVER v AS yy, sum(gx * gy) OVER v AS xy, count(*) OVER v AS n FROM ({_SOBEL}) WINDOW v AS (PARTITION BY r ORDER BY c RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING))
WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE n = 81)"""


@query("structure_tensor", "raster", f"SELECT r, c, round_even(energy, 4) AS energy, round_even(theta, 4) AS theta, round_even(coherence, 4) AS coherence FROM {_FIELDS}")
def structure_tensor(t):
    """Orientation, energy and coherence over windows of nine pixels, where the window lies inside."""
    return R.tensor(t.raster).select("r", "c", rounded(C("energy"), 4).alias("energy"), rounded(C("theta"), 4).alias("theta"), rounded(C("coherence"), 4).alias("coherence"))


#: Angle band, least energy and least coherence of hatching, strict and relaxed.
HATCH = {"strict": (138.0, 174.0, 2500.0, 0.45), "relaxed": (132.0, 178.0, 1500.0, 0.40)}
#: Directions of the street grid, and for dividers the band around them, least coherence,
#: least energy and greatest gray, strict and relaxed.
GRID_DIRECTIONS = (9.5, 99.5)
DIVIDER = {"strict": (8.0, 0.50, 4000.0, 135), "relaxed": (10.0, 0.45, 2500.0, 150)}


def _hatch_sql(kind: str) -> str:
    lo, hi, energy, coherence = HATCH[kind]
    return f"(energy > {energy} AND coherence > {coherence} AND theta BETWEEN {lo} AND {hi})"


def hatched(kind: str):
    lo, hi, energy, coherence = HATCH[kind]
    return (C("energy") > energy) & (C("coherence") > coherence) & C("theta").between(lo, hi)


@query("hatch_mask", "raster", f"SELECT r, c, {_hatch_sql('strict')} AS strict FROM {_FIELDS} WHERE {_hatch_sql('strict')} OR {_hatch_sql('relaxed')}")
def hatch_mask(t):
    """Hatched pixels by the relaxed bounds, and whether the strict ones hold, too."""
    return R.tensor(t.raster).where(hatched("strict") | hatched("relaxed")).select("r", "c", hatched("strict").alias("strict"))


def _near_grid(theta: str) -> str:
    return "least(" + ", ".join(f"abs(({theta} - {g} + 270) % 180 - 90)" for g in GRID_DIRECTIONS) + ")"


@query("divider_pixels", "raster", f"SELECT f.r, f.c, gray < 135 AND energy > 4000 AND coherence > 0.5 AND {_near_grid('theta')} <= 8 AS strict FROM {_FIELDS} f JOIN raster p ON p.r = f.r AND p.c = f.c WHERE gray < 150 AND energy > 2500 AND coherence > 0.45 AND {_near_grid('theta')} <= 10")
def divider_pixels(t):
    """Dark pixels whose gradient runs along the street grid, by the relaxed bounds, and whether the strict
    ones hold: what the oriented opening of `divider_mask` works on."""
    gap = F.least(*(angle_gap(C("theta"), F.lit(g), 180) for g in GRID_DIRECTIONS))
    test = lambda kind: (C("gray") < DIVIDER[kind][3]) & (C("energy") > DIVIDER[kind][2]) & (C("coherence") > DIVIDER[kind][1]) & (gap <= DIVIDER[kind][0])
    return R.tensor(t.raster).hint("merge").join(t.raster, ["r", "c"]).where(test("relaxed")).select("r", "c", test("strict").alias("strict"))


def _box(agg: str, half: int, source: str = "raster", value: str = "gray") -> str:
    n = f"{half} PRECEDING AND {half} FOLLOWING"
    return f"SELECT r, c, {agg}(a) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN {n}) AS v, gray FROM (SELECT r, c, gray, {agg}({value}) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN {n}) AS a FROM {source})"


def _mirror(half: int) -> str:
    """The raster with a mirrored border, as SQL."""
    one = lambda src, k: f"(SELECT * FROM {src} UNION ALL SELECT * REPLACE (-{k} AS {k}) FROM {src} WHERE {k} BETWEEN 1 AND {half} UNION ALL SELECT s.* REPLACE (2 * e - {k} AS {k}) FROM {src} s, (SELECT max({k}) AS e FROM raster) WHERE e - {k} BETWEEN 1 AND {half})"
    return one(one("(SELECT r, c, gray FROM raster)", "r"), "c")


@query("box_filter", "raster", f"SELECT r, c, round_even(v / 81.0::DOUBLE, 6) AS mean FROM ({_box('sum', 4, _mirror(4))}), (SELECT max(r) AS er, max(c) AS ec FROM raster) WHERE r BETWEEN 0 AND er AND c BETWEEN 0 AND ec")
def box_filter(t):
    """The mean of nine by nine pixels, the border mirrored."""
    s = R.box_sums(R.reflected(t.raster, 4), {"total": C("gray")}, 4)
    return R.inside(s, t.raster).select("r", "c", rounded(C("total") / 81.0).alias("mean"))


@query("adaptive_threshold", "raster", f"SELECT s.r, s.c FROM ({_box('sum', 20)}) s JOIN (SELECT r, c, (least(r + 20, mr) - greatest(r - 20, 0) + 1) * (least(c + 20, 63) - greatest(c - 20, 0) + 1) AS n FROM raster, (SELECT max(r) AS mr FROM raster)) k USING (r, c) WHERE gray * n <= v - 18 * n")
def adaptive_threshold(t):
    """Pixels at least 18 darker than the mean of the 41 by 41 around them, clipped at the image."""
    s = R.box_sums(t.raster, {"v": C("gray")}, 20).join(t.raster, ["r", "c"])
    return s.where("gray * __n <= v - 18 * __n").select("r", "c")


#: Weights of a Gaussian of sigma 2 at distances 0 to 8; their sum over both sides is the divisor.
GAUSS = tuple(math.exp(-k * k / 8) for k in range(9))
_GAUSS_SUM = GAUSS[0] + 2 * sum(GAUSS[1:])


def _gauss_sql(value: str, across: str, along: str, source: str) -> str:
    taps = " + ".join(f"{GAUSS[abs(k)]!r}::DOUBLE * " + (f"lead({value}, {k}) OVER w" if k > 0 else f"lag({value}, {-k}) OVER w" if k else value) for k in range(-8, 9))
    return f"SELECT r, c, ({taps}) / {_GAUSS_SUM!r}::DOUBLE AS g FROM ({source}) WINDOW w AS (PARTITION BY {across} ORDER BY {along})"


@query("gaussian_blur", "raster", f"SELECT r, c, round_even(g, 6) AS blurred FROM ({_gauss_sql('g', 'c', 'r', _gauss_sql('gray', 'r', 'c', _mirror(8)[1:-1]))}), (SELECT max(r) AS er, max(c) AS ec FROM raster) WHERE r BETWEEN 0 AND er AND c BETWEEN 0 AND ec")
def gaussian_blur(t):
    """A Gaussian of sigma 2, rows and then columns, the border mirrored."""
    return R.gaussian(t.raster).select("r", "c", rounded(C("g")).alias("blurred"))


_CLOSED = _box("min", 20, "(SELECT r, c, v AS gray FROM (" + _box("max", 20) + "))")


@query("background_darkness", "raster", f"SELECT s.r, s.c, CAST(floor((1 - least(1, p.gray / (floor(s.v / s.n + 0.5) + 1.0::DOUBLE))) * 255) AS BIGINT) AS dark FROM (SELECT r, c, v, sum(n) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS n FROM (SELECT r, c, sum(a) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS v, n FROM (SELECT r, c, CAST(sum(v) OVER x AS DOUBLE) AS a, count(*) OVER x AS n FROM ({_CLOSED}) WINDOW x AS (PARTITION BY r ORDER BY c RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING)))) s JOIN raster p ON p.r = s.r AND p.c = s.c")
def background_darkness(t):
    """Darkness against the background, which is the closing by 41 and its mean over 41, clipped at the image."""
    d = R.box_window(t.raster, "gray", 20, F.max, "d").select("r", "c", "d")
    bg = R.box_sums(R.box_window(d, "d", 20, F.min, "e"), {"v": C("e")}, 20)
    share = F.least(F.lit(1.0), C("gray") / (F.floor(C("v") / C("__n") + 0.5) + 1.0))
    return bg.join(t.raster, ["r", "c"]).select("r", "c", F.floor((1 - share) * 255).alias("dark"))


@query("kron_upsample", "raster", "SELECT r, c, max(gray) OVER (PARTITION BY r // 4, c // 4) < 120 AS dark FROM raster")
def kron_upsample(t):
    """Each pixel with what its block of four by four says: block maximum, spread back over the block."""
    key = [F.expr("r div 4").alias("br"), F.expr("c div 4").alias("bc")]
    top = t.raster.groupBy(*key).agg(F.max("gray").alias("top"))
    return t.raster.select("r", "c", *key).join(top, ["br", "bc"]).select("r", "c", (C("top") < 120).alias("dark"))


@query("boundless_read", "raster", "SELECT r, c, coalesce(gray, 255) AS gray FROM (SELECT r, unnest(range(-4, 28)) AS c FROM (SELECT unnest(range(-8, 24)) AS r)) LEFT JOIN raster USING (r, c)")
def boundless_read(t):
    """A window that reaches beyond the raster, white where nothing is."""
    window = t.spark.range(-8, 24).withColumnRenamed("id", "r").withColumn("c", F.explode(F.sequence(F.lit(-4).cast("bigint"), F.lit(27).cast("bigint"))))
    return window.join(t.raster, ["r", "c"], "left").select("r", "c", F.coalesce("gray", F.lit(255)).alias("gray"))


@query("luma", "raster", "SELECT r, c, CASE WHEN (r + c) % 9 = 0 THEN 255 ELSE CAST(floor(0.299::DOUBLE * gray + 0.587::DOUBLE * (255 - gray) + 0.114::DOUBLE * (gray * 7 % 256)) AS BIGINT) END AS gray FROM raster")
def luma(t):
    """Gray from three bands, white where the fourth says that the sheet ends."""
    from atlasforge.functions.columns import luma as gray_of

    bands = t.raster.select("r", "c", C("gray").alias("red"), (255 - C("gray")).alias("green"), (C("gray") * 7 % 256).alias("blue"), F.when((C("r") + C("c")) % 9 == 0, 0).otherwise(255).alias("alpha"))
    return bands.select("r", "c", gray_of(*map(C, ("red", "green", "blue", "alpha"))).alias("gray"))


_MASK = "(SELECT r, c, gray, CASE WHEN gray < 110 THEN 1 ELSE 0 END AS m FROM raster)"


@query("morph_close", "raster", f"SELECT r, c, v AS m FROM ({_box('min', 1, '(SELECT r, c, v AS gray FROM (' + _box('max', 1, _MASK, 'm') + '))')})")
def morph_close(t):
    """3 by 3 closing: dilation, then erosion."""
    m = t.raster.select("r", "c", (C("gray") < 110).cast("int").alias("m"))
    d = R.box_window(m, "m", 1, F.max, "d").select("r", "c", "d")
    return R.box_window(d, "d", 1, F.min, "e").select("r", "c", C("e").alias("m"))


@query("morph_open", "raster", f"SELECT r, c, v AS m FROM ({_box('max', 1, '(SELECT r, c, v AS gray FROM (' + _box('min', 1, _MASK, 'm') + '))')})")
def morph_open(t):
    m = t.raster.select("r", "c", (C("gray") < 110).cast("int").alias("m"))
    e = R.box_window(m, "m", 1, F.min, "e").select("r", "c", "e")
    return R.box_window(e, "e", 1, F.max, "d").select("r", "c", C("d").alias("m"))


@query("downsample_mean", "raster", "SELECT r // 8 AS r8, c // 8 AS c8, round_even(avg(gray), 6) AS mean, max(gray) AS top FROM raster GROUP BY 1, 2")
def downsample_mean(t):
    return t.raster.groupBy(F.expr("r div 8").alias("r8"), F.expr("c div 8").alias("c8")).agg(rounded(F.avg("gray")).alias("mean"), F.max("gray").alias("top"))


@query("raster_resample_avg", "raster", "SELECT r // 3 AS r3, c // 3 AS c3, CAST(floor(avg(gray)) AS BIGINT) AS gray FROM raster GROUP BY 1, 2")
def raster_resample_avg(t):
    return t.raster.groupBy(F.expr("r div 3").alias("r3"), F.expr("c div 3").alias("c3")).agg(F.floor(F.avg("gray")).alias("gray"))


@query("raster_window", "raster", "SELECT r - 10 AS wr, c - 20 AS wc, gray FROM raster WHERE r BETWEEN 10 AND 41 AND c BETWEEN 20 AND 51")
def raster_window(t):
    return t.raster.where("r BETWEEN 10 AND 41 AND c BETWEEN 20 AND 51").select((C("r") - 10).alias("wr"), (C("c") - 20).alias("wc"), "gray")


@query("zonal_mean", "raster", "SELECT r // 20 AS zr, c // 20 AS zc, round_even(avg(CASE WHEN gray < 110 THEN 1.0 ELSE 0.0 END), 6) AS ink FROM raster GROUP BY 1, 2")
def zonal_mean(t):
    return t.raster.groupBy(F.expr("r div 20").alias("zr"), F.expr("c div 20").alias("zc")).agg(rounded(F.avg((C("gray") < 110).cast("double"))).alias("ink"))


@query("mask_iou", "raster", "SELECT round_even(tp / CAST(greatest(1, tp + fp + fn) AS DOUBLE), 6) AS iou, round_even(tp / CAST(greatest(1, tp + fp) AS DOUBLE), 6) AS precision, round_even(tp / CAST(greatest(1, tp + fn) AS DOUBLE), 6) AS recall FROM (SELECT count_if(gray < 110 AND gray < 120 - c % 30) AS tp, count_if(gray < 110 AND gray >= 120 - c % 30) AS fp, count_if(gray >= 110 AND gray < 120 - c % 30) AS fn FROM raster WHERE gray NOT BETWEEN 108 AND 111)")
def mask_iou(t):
    p, q = C("gray") < 110, C("gray") < 120 - C("c") % 30
    d = t.raster.where("gray NOT BETWEEN 108 AND 111").agg(F.count_if(p & q).alias("tp"), F.count_if(p & ~q).alias("fp"), F.count_if(~p & q).alias("fn"))
    part = lambda n: rounded(C("tp") / F.greatest(F.lit(1), n))
    return d.select(part(C("tp") + C("fp") + C("fn")).alias("iou"), part(C("tp") + C("fp")).alias("precision"), part(C("tp") + C("fn")).alias("recall"))


@query("label_weights", "raster", "SELECT r, c, CASE WHEN r % 17 = 0 THEN 0 WHEN c % 13 = 0 THEN 0 WHEN gray < 60 THEN 3 WHEN gray < 110 THEN 2 ELSE 1 END AS w FROM raster")
def label_weights(t):
    """The last assignment wins: bands and ignored rows come first here."""
    return t.raster.select("r", "c", ladder((C("r") % 17 == 0, 0), (C("c") % 13 == 0, 0), (C("gray") < 60, 3), (C("gray") < 110, 2), default=1).alias("w"))


@query("canvas_max", "raster", "SELECT r, c, max(v) AS v FROM (SELECT r, c, gray AS v FROM raster WHERE c < 40 UNION ALL SELECT r, c, 255 - gray AS v FROM raster WHERE c >= 24) GROUP BY 1, 2")
def canvas_max(t):
    a, b = t.raster.where("c < 40").select("r", "c", C("gray").alias("v")), t.raster.where("c >= 24").select("r", "c", (255 - C("gray")).alias("v"))
    return a.unionByName(b).groupBy("r", "c").agg(F.max("v").alias("v"))


@query("overlap_blend", "raster", "SELECT r, c, round_even(CASE WHEN sum(w) = 0 THEN 0 ELSE CAST(sum(v * w) AS DOUBLE) / sum(w) END, 6) AS p FROM (SELECT r, c, gray AS v, c AS w FROM raster WHERE c < 40 UNION ALL SELECT r, c, 255 - gray AS v, 64 - c AS w FROM raster WHERE c >= 24) GROUP BY 1, 2")
def overlap_blend(t):
    a = t.raster.where("c < 40").select("r", "c", C("gray").alias("v"), C("c").alias("w"))
    b = t.raster.where("c >= 24").select("r", "c", (255 - C("gray")).alias("v"), (64 - C("c")).alias("w"))
    return a.unionByName(b).groupBy("r", "c").agg(rounded(F.when(F.sum("w") == 0, 0.0).otherwise(F.sum(C("v") * C("w")).cast("double") / F.nullif(F.sum("w"), F.lit(0)))).alias("p"))


@query("skeleton_degree", "raster", "WITH m AS (SELECT r, c FROM raster WHERE gray < 60) SELECT a.r, a.c, count(b.r) AS degree FROM m a LEFT JOIN m b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY 1, 2")
def skeleton_degree(t):
    """How many of a set pixel's eight neighbours are set."""
    m = t.raster.select("r", "c", (C("gray") < 60).cast("int").alias("m"))
    return R.box_window(m, "m", 1, F.sum, "n").where("m = 1").select("r", "c", (C("n") - 1).alias("degree"))


_RECURSIVE = """WITH RECURSIVE m AS MATERIALIZED (SELECT r, c, r * 64 + c AS k FROM raster WHERE gray < 45), e AS MATERIALIZED (SELECT a.k AS u, b.k AS v FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1), w(k, l) AS (SELECT k, k FROM m UNION SELECT e.v, w.l FROM w JOIN e ON w.k = e.u)
SELECT n, count(*) AS labels FROM (SELECT l, count(*) AS n FROM (SELECT k, min(l) AS l FROM w GROUP BY k) GROUP BY l) GROUP BY n"""


@query("label_sizes", "raster", _RECURSIVE)
def label_sizes(t):
    """Sizes of the 4-connected components of dark pixels."""
    lab = R.components(t.raster.where("gray < 45"))
    return lab.groupBy("label").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("labels"))


@query("edt", "raster", "WITH k AS (SELECT r, c FROM raster WHERE gray < 45), a AS (SELECT r, c FROM raster) SELECT a.r, a.c, round_even(sqrt(min((a.r - k.r) * (a.r - k.r) + (a.c - k.c) * (a.c - k.c))), 6) AS d FROM a, k GROUP BY 1, 2")
def edt(t):
    """Exact distance to the nearest dark pixel: column distances first, then the lower envelope of rows."""
    from atlasforge.operators.distance import distance_transform

    a = t.raster.select("r", "c", (C("gray") < 45).alias("set"))
    return distance_transform(a).select("r", "c", rounded(C("d")).alias("d"))


@query("rasterize", "parcels", "SELECT id, count(*) AS px FROM (SELECT id, x0, x1, y0, y1, r, unnest(range(x0 // 4 - 1, x1 // 4 + 2)) AS c FROM (SELECT *, unnest(range(y0 // 4 - 1, y1 // 4 + 2)) AS r FROM parcels)) WHERE c * 4 + 2 >= x0 AND c * 4 + 2 < x1 AND r * 4 + 2 >= y0 AND r * 4 + 2 < y1 GROUP BY 1")
def rasterize(t):
    """Pixels of four units whose centre lies in the box; each box makes its own pixels."""
    span = lambda a, b: F.sequence(F.ceil((C(a) - 2) / 4), F.ceil((C(b) - 2) / 4) - 1)
    some = t.parcels.where(F.ceil((C("x0") - 2) / 4) < F.ceil((C("x1") - 2) / 4)).where(F.ceil((C("y0") - 2) / 4) < F.ceil((C("y1") - 2) / 4))
    px = some.withColumn("c", F.explode(span("x0", "x1"))).withColumn("r", F.explode(span("y0", "y1")))
    return px.groupBy("id").agg(F.count("*").alias("px"))


@query("boundary_samples", "parcels", """WITH s AS (SELECT id, x0, y0, w, h, k, 2.0::DOUBLE * (w + h) * k / n AS s FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT id, x0, y0, x1 - x0 AS w, y1 - y0 AS h, greatest(8, 4 * (x1 - x0 + y1 - y0)) AS n FROM parcels)))
SELECT id, k, round_even(x0 + CASE WHEN s < w THEN s WHEN s < w + h THEN w WHEN s < 2 * w + h THEN 2 * w + h - s ELSE 0 END, 6) AS x, round_even(y0 + CASE WHEN s < w THEN 0 WHEN s < w + h THEN s - w WHEN s < 2 * w + h THEN h ELSE 2 * (w + h) - s END, 6) AS y FROM s""")
def boundary_samples(t):
    """Points every half unit along each box's edge, at least eight."""
    w, h, s = C("x1") - C("x0"), C("y1") - C("y0"), C("s")
    n = F.greatest(F.lit(8), 4 * (w + h))
    d = t.parcels.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), C("n") - 1))).withColumn("s", 2.0 * (w + h) * C("k") / C("n"))
    x = F.when(s < w, s).when(s < w + h, w).when(s < 2 * w + h, 2 * w + h - s).otherwise(0)
    y = F.when(s < w, 0).when(s < w + h, s - w).when(s < 2 * w + h, h).otherwise(2 * (w + h) - s)
    return d.select("id", "k", rounded(C("x0") + x).alias("x"), rounded(C("y0") + y).alias("y"))


@query("tile_grid", sql="SELECT r, c, greatest(0, c * 2048 - 128) AS col0, greatest(0, r * 2048 - 128) AS row0, least(11950, c * 2048 + 2176) - greatest(0, c * 2048 - 128) AS w, least(9575, r * 2048 + 2176) - greatest(0, r * 2048 - 128) AS h FROM range(0, 5) r(r), range(0, 6) c(c)")
def tile_grid(t):
    from atlasforge.operators.tiling import stride_grid

    return stride_grid(t.spark, 11950, 9575, 2048, 128)


@query("audit_tiles", sql="SELECT c * 512 AS col0, r * 512 AS row0, least(704, 11950 - c * 512) AS w, least(704, 9575 - r * 512) AS h FROM range(0, 24) c(c), range(0, 19) r(r) WHERE least(704, 11950 - c * 512) >= 128 AND least(704, 9575 - r * 512) >= 128")
def audit_tiles(t):
    from atlasforge.operators.tiling import overlapping_tiles

    return overlapping_tiles(t.spark, 11950, 9575, 704, 512, 128)


@query("infer_windows", sql="SELECT DISTINCT least(k * 448, 3000 - 512) AS start FROM range(0, 7) k(k)")
def infer_windows(t):
    from atlasforge.operators.tiling import flush_starts

    return t.spark.range(1).select(F.explode(flush_starts(3000, 512, 64)).alias("start"))


@query("findings_dedupe")
def findings_dedupe(t):
    """Greedy: the larger finding of a category and tile hides later ones that overlap it by IoU over 0.35."""
    from atlasforge.operators.greedy import suppress

    f = t.findings.where("NOT err AND category IS NOT NULL").withColumn("score", area())
    return suppress(f, ["tile_no", "category"], 0.35).select("id")




def rings(t):
    """Each line's points as a ring."""
    return points_array(t).select(C("line_id").alias("id"), F.transform("pts", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("pts")).where(F.size("pts") > 2)


@query("shape_measures")
def shape_measures(t):
    """Hull solidity, rotated rectangle, simplification, validity and an interior point."""
    from atlasforge.operators.shapes import measures

    return measures(rings(t))


@query("skeleton_lines")
def skeleton_lines(t):
    from atlasforge.operators.tiles import skeletons

    return skeletons(t.raster.where("gray < 110"), 64)


@query("registration_offset")
def registration_offset(t):
    """Each tile of the raster against the same tile moved by two columns."""
    from atlasforge.operators.tiles import registration

    a = t.raster.select("r", "c", C("gray").cast("double").alias("a"))
    b = t.raster.select("r", ((C("c") + 2) % 64).alias("c"), C("gray").cast("double").alias("b"))
    return registration(a.join(b, ["r", "c"]))


@query("apply_edits", "parcels", "SELECT id, x0, CASE WHEN id % 11 = 0 THEN x1 + 5 ELSE x1 END AS x1, CASE WHEN id % 11 = 0 THEN 'reshaped' ELSE 'kept' END AS action FROM parcels WHERE id % 7 <> 0 UNION ALL SELECT id + 100000, x0, x1, 'added' FROM parcels WHERE id % 13 = 0")
def apply_edits(t):
    """The next version of a layer after deletes, reshapes and additions."""
    from atlasforge.operators.edits import apply_edits as apply

    p = t.parcels.select("id", "x0", "x1")
    new = p.where("id % 11 = 0").select("id", "x0", (C("x1") + 5).alias("x1"))
    return apply(p, p.where("id % 7 = 0"), new, p.where("id % 13 = 0").select((C("id") + 100000).alias("id"), "x0", "x1"), "id", 2).select("id", "x0", "x1", "action")


@query("zone_fracs", "raster parcels", "SELECT p.id, round_even(avg(CASE WHEN gray < 110 THEN 1.0 ELSE 0.0 END), 6) AS ink, round_even(avg(CASE WHEN gray < 60 THEN 1.0 ELSE 0.0 END), 6) AS dark FROM parcels p JOIN raster r ON r.r >= p.x0 // 4 AND r.r < p.x1 // 4 AND r.c >= p.y0 // 25 AND r.c < p.y1 // 25 + 1 GROUP BY 1")
def zone_fracs(t):
    """Shares of ink and dark pixels under each box, by the pixels that a box covers."""
    p = t.parcels.select("id", F.expr("x0 div 4").alias("a"), F.expr("x1 div 4 - 1").alias("b"), F.expr("y0 div 25").alias("u"), F.expr("y1 div 25").alias("v")).where("a <= b")
    px = p.withColumn("r", F.explode(F.sequence("a", "b"))).withColumn("c", F.explode(F.sequence("u", "v")))
    part = lambda k: rounded(F.avg((C("gray") < k).cast("double")))
    return px.join(t.raster, ["r", "c"]).groupBy("id").agg(part(110).alias("ink"), part(60).alias("dark"))


@query("layer_validation", "parcels candidates", "SELECT 'parcels' AS layer, count(*) AS n, count(DISTINCT id) AS keys, count_if(x1 <= x0 OR y1 <= y0) AS empty, min(x0) AS x0, max(x1) AS x1, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM parcels UNION ALL SELECT 'candidates', count(*), count(DISTINCT id), count_if(x1 <= x0 OR y1 <= y0), min(x0), max(x1), CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) FROM candidates")
def layer_validation(t):
    one = lambda name, d: d.agg(F.lit(name).alias("layer"), F.count("*").alias("n"), F.count_distinct("id").alias("keys"), F.count_if((C("x1") <= C("x0")) | (C("y1") <= C("y0"))).alias("empty"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(area()).alias("area"))
    return one("parcels", t.parcels).unionByName(one("candidates", t.candidates))


@query("chip_grid", sql="SELECT c * 512 AS col0, r * 512 AS row0 FROM range(0, 23) c(c), range(0, 18) r(r) WHERE c * 512 < 7000 AND c * 512 + 1024 > 2000 AND r * 512 < 6000 AND r * 512 + 1024 > 1500")
def chip_grid(t):
    from atlasforge.operators.tiling import overlapping_tiles

    g = overlapping_tiles(t.spark, 11950, 9575, 1024, 512, 512).where("col0 < 23 * 512 and row0 < 18 * 512")
    return g.where("col0 < 7000 AND col0 + 1024 > 2000 AND row0 < 6000 AND row0 + 1024 > 1500").select("col0", "row0")


@query("train_tiles", "raster", "SELECT tr, tc, CASE WHEN v > 0 THEN 'val' WHEN k > 200 THEN 'train' ELSE 'skip' END AS split FROM (SELECT r // 32 AS tr, c // 32 AS tc, count_if(r % 97 = 0) AS v, count_if(gray < 110) AS k FROM raster GROUP BY 1, 2)")
def train_tiles(t):
    """Tiles for validation go first, then those with enough labels."""
    g = t.raster.groupBy(F.expr("r div 32").alias("tr"), F.expr("c div 32").alias("tc")).agg(F.count_if(C("r") % 97 == 0).alias("v"), F.count_if(C("gray") < 110).alias("k"))
    return g.select("tr", "tc", ladder((C("v") > 0, "val"), (C("k") > 200, "train"), default="skip").alias("split"))


@query("largest_part", "candidates", "SELECT parcel_id, arg_max(id, ((x1 - x0) * (y1 - y0), -id)) AS id FROM candidates GROUP BY 1")
def largest_part(t):
    return t.candidates.groupBy("parcel_id").agg(F.max_by("id", F.struct(area(), -C("id"))).alias("id"))


@query("label_bands", "parcels", "SELECT id, (x1 - x0 + 6) * (y1 - y0 + 6) - greatest(x1 - x0 - 6, 0) * greatest(y1 - y0 - 6, 0) AS band FROM parcels")
def label_bands(t):
    w, h = C("x1") - C("x0"), C("y1") - C("y0")
    return t.parcels.select("id", ((w + 6) * (h + 6) - F.greatest(w - 6, F.lit(0)) * F.greatest(h - 6, F.lit(0))).alias("band"))


@query("stroke_width", "raster", "WITH k AS (SELECT r, c FROM raster WHERE gray >= 110), d AS (SELECT a.r, a.c, sqrt(min((a.r - k.r) * (a.r - k.r) + (a.c - k.c) * (a.c - k.c))) AS d FROM raster a, k WHERE a.gray < 110 GROUP BY 1, 2) SELECT round_even(quantile_cont(d, 0.9), 6) AS p90 FROM d")
def stroke_width(t):
    """Half the width of strokes: the ninth decile of ink's distance to paper."""
    from atlasforge.operators.distance import distance_transform

    d = distance_transform(t.raster.select("r", "c", (C("gray") >= 110).alias("set"))).join(t.raster.where("gray < 110").select("r", "c"), ["r", "c"])
    return d.agg(rounded(F.percentile("d", 0.9)).alias("p90"))


@query("instance_route", "pairs", "SELECT b_id AS id, CASE WHEN max(inter / CAST(a_area + b_area - inter AS DOUBLE)) >= 0.3 AND max(b_area) <= 3 * max(a_area) THEN 'refined' WHEN max(b_area) BETWEEN 100 AND 600 THEN 'kept' ELSE 'rejected' END AS route FROM pairs GROUP BY 1")
def instance_route(t):
    g = pairs_of(t).groupBy(C("b_id").alias("id")).agg(F.max(pair_iou()).alias("i"), F.max(area("a_")).alias("a"), F.max(area("b_")).alias("b"))
    return g.select("id", ladder(((C("i") >= 0.3) & (C("b") <= 3 * C("a")), "refined"), (C("b").between(100, 600), "kept"), default="rejected").alias("route"))
