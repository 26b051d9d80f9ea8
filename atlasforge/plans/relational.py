"""Queries without geometry: projections, filters, joins, aggregates, windows, sorts, sets, reports, QA rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasforge.functions.columns import angle_gap, area, clamp, digitize, ladder, rank_of, rounded, snap
from atlasforge.plans.registry import query

CATEGORIES = ["false_positive", "missing_split", "shape_mismatch", "missing_feature"]
DISPOSITIONS = ["dismissed", "needs_review", "fixed_reshape", "fixed_delete", "fixed_add"]
#: Scale of a ground metre at 40.71 degrees north in EPSG:3857.
GROUND = 0.758
VALID = "NOT err AND category IS NOT NULL AND x1 - x0 >= 8 AND y1 - y0 >= 8"


@query("csv_typed_decode", sql=r"""SELECT TRY_CAST(nullif(s, '\N') AS BIGINT) AS id, nullif(n, '\N') AS name, CASE WHEN b = 't' THEN true WHEN b = 'f' THEN false END AS flag, TRY_CAST(nullif(v, '\N') AS DOUBLE) AS val
FROM (SELECT CAST(c_custkey AS VARCHAR) AS s, CASE WHEN c_custkey % 7 = 0 THEN '\N' WHEN c_custkey % 7 = 1 THEN '' ELSE c_name END AS n, CASE c_custkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'f' ELSE '\N' END AS b, CASE WHEN c_custkey % 5 = 0 THEN '\N' ELSE CAST(c_custkey * 2 AS VARCHAR) END AS v FROM customer)""")
def csv_typed_decode(t):
    """Catalog-typed decode of text rows: only the two signs backslash N are null, an empty string is not."""
    from atlasforge.sources.catalog_csv import decode

    raw = t.customer.selectExpr("cast(c_custkey as string) id", r"CASE WHEN c_custkey % 7 = 0 THEN '\\N' WHEN c_custkey % 7 = 1 THEN '' ELSE c_name END name", r"CASE c_custkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'f' ELSE '\\N' END flag", r"CASE WHEN c_custkey % 5 = 0 THEN '\\N' ELSE cast(c_custkey * 2 as string) END val")
    return decode(raw, [("id", "bigint"), ("name", "text"), ("flag", "boolean"), ("val", "numeric")])


@query("catalog_columns", sql="SELECT table_name, CAST(ordinal_position AS BIGINT) AS pos, column_name FROM information_schema.columns WHERE table_name IN ('part', 'orders')")
def catalog_columns(t):
    """Columns of two tables from a catalog that was written as CSV, read back by its types and ordered."""
    from atlasforge.sources.catalog_csv import read
    from atlasforge.staging import shared_path

    found = [(name, str(k), c) for name in ("part", "orders", "nation") for k, c in enumerate(getattr(t, name).columns, 1)]
    path = shared_path(t.spark, "catalog")
    t.spark.createDataFrame(found, "table_name string, pos string, column_name string").write.csv(path, header=True, quoteAll=True)
    return read(t.spark, path, [("table_name", "text"), ("pos", "integer"), ("column_name", "text")]).where("table_name IN ('part', 'orders')").orderBy("table_name", "pos")


@query("findings_load", "findings", f"SELECT id, tile_no, category, x0, y0, x1, y1, coalesce(confidence, 'low') AS confidence FROM findings WHERE {VALID}")
def findings_load(t):
    """Valid findings, parsed from JSON lines; a bad line, an error row or a box under 8 px is skipped."""
    from atlasforge.sources.findings import parse_lines

    box = F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))
    line = F.to_json(F.struct("id", "tile_no", F.when(F.col("err"), "boom").alias("error"), F.array(F.struct("category", box.alias("bbox_px"), "confidence")).alias("findings")))
    return parse_lines(t.findings.select(line.alias("value")), CATEGORIES)


@query("stamp_provenance", "candidates", "SELECT id, parcel_id, 'run-1' AS run_id, 'plate-a' AS source_map, 'v5' AS extractor_version, false AS reviewed FROM candidates")
def stamp_provenance(t):
    return t.candidates.select("id", "parcel_id", F.lit("run-1").alias("run_id"), F.lit("plate-a").alias("source_map"), F.lit("v5").alias("extractor_version"), F.lit(False).alias("reviewed"))


@query("source_row", "parcels", "SELECT id AS original_id, row_number() OVER (ORDER BY id) AS source_row FROM parcels")
def source_row(t):
    """1-based rows in file order: counts by range first, so no task sorts the whole table."""
    from atlasforge.operators.ordered import row_numbers

    return row_numbers(t.parcels.select(F.col("id").alias("original_id")), "original_id", "source_row")


@query("tile_ids", sql="SELECT r, c, printf('T%02d%02d', r, c) AS tile_id, printf('chip_%06d', r * 24 + c) AS chip_id, printf('features/chip_%06d.tif', r * 24 + c) AS feature_path FROM range(0, 12) a(r), range(0, 24) b(c)")
def tile_ids(t):
    grid = t.spark.range(12).withColumnRenamed("id", "r").crossJoin(t.spark.range(24).withColumnRenamed("id", "c"))
    n = F.col("r") * 24 + F.col("c")
    return grid.select("r", "c", F.format_string("T%02d%02d", "r", "c").alias("tile_id"), F.format_string("chip_%06d", n).alias("chip_id"), F.format_string("features/chip_%06d.tif", n).alias("feature_path"))


@query("oversize_flag", "candidates", "SELECT id, (x1 - x0) * (y1 - y0) > 600 AS oversize, (x1 - x0) * (y1 - y0) > 2 * 250 AS twice FROM candidates")
def oversize_flag(t):
    return t.candidates.select("id", (area() > 600).alias("oversize"), (area() > 2 * 250).alias("twice"))


@query("area_route", "candidates", "SELECT id, CASE WHEN a BETWEEN 200 AND 600 THEN 'kept' WHEN a > 600 AND a < 2000 THEN 'oversize' END AS route FROM (SELECT id, (x1 - x0) * (y1 - y0) AS a FROM candidates) WHERE a >= 200 AND a < 2000")
def area_route(t):
    routed = t.candidates.withColumn("a", area()).withColumn("route", ladder((F.col("a").between(200, 600), "kept"), ((F.col("a") > 600) & (F.col("a") < 2000), "oversize")))
    return routed.where("route IS NOT NULL").select("id", "route")


@query("sliver_filter", "candidates", "SELECT id FROM candidates WHERE least(x1 - x0, y1 - y0) >= 10 AND greatest(x1 - x0, y1 - y0) <= 2 * least(x1 - x0, y1 - y0)")
def sliver_filter(t):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return t.candidates.where((F.least(w, h) >= 10) & (F.greatest(w, h) <= 2 * F.least(w, h))).select("id")


@query("tile_ink_skip", "raster", "SELECT r // 16 AS tr, c // 16 AS tc, count_if(gray < 110) AS ink FROM raster GROUP BY ALL HAVING count_if(gray < 110) >= 0.25 * count(*)")
def tile_ink_skip(t):
    g = t.raster.groupBy(F.expr("r div 16").alias("tr"), F.expr("c div 16").alias("tc")).agg(F.count_if(F.col("gray") < 110).alias("ink"), F.count("*").alias("n"))
    return g.where("ink >= 0.25 * n").drop("n")


@query("label_keep", "qa_flags", "SELECT id FROM qa_flags WHERE on_plate IS NOT DISTINCT FROM true AND suspect IS DISTINCT FROM true AND id NOT IN (2, 4, 8)")
def label_keep(t):
    return t.qa_flags.where(F.col("on_plate").eqNullSafe(True) & ~F.col("suspect").eqNullSafe(True) & ~F.col("id").isin(2, 4, 8)).select("id")


@query("shape_gates", "candidates", """SELECT id, CASE WHEN a < 80 AND NOT (a >= 45 AND id % 100 >= 40) THEN 'tiny' WHEN a > 700 THEN 'big' WHEN 2 * w < h OR 2 * h < w THEN 'aspect' WHEN a < 150 AND id % 10 < 3 THEN 'solidity' END AS reject_reason
FROM (SELECT id, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS a FROM candidates)""")
def shape_gates(t):
    c = F.col
    d = t.candidates.select("id", (c("x1") - c("x0")).alias("w"), (c("y1") - c("y0")).alias("h"), area().alias("a"))
    strong = (c("a") >= 45) & (c("id") % 100 >= 40)
    return d.select("id", ladder(((c("a") < 80) & ~strong, "tiny"), (c("a") > 700, "big"), ((2 * c("w") < c("h")) | (2 * c("h") < c("w")), "aspect"), ((c("a") < 150) & (c("id") % 10 < 3), "solidity")).alias("reject_reason"))


@query("reject_counts", "candidates", "SELECT coalesce(CASE WHEN a < 100 THEN 'tiny' WHEN a > 700 THEN 'big' END, 'kept') AS reason, count(*) AS n FROM (SELECT (x1 - x0) * (y1 - y0) AS a FROM candidates) GROUP BY 1")
def reject_counts(t):
    return t.candidates.groupBy(F.coalesce(ladder((area() < 100, "tiny"), (area() > 700, "big")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("missing_files", "candidates", "SELECT DISTINCT parcel_id FROM candidates WHERE parcel_id NOT IN (SELECT id FROM parcels WHERE id % 3 <> 0)")
def missing_files(t):
    return t.candidates.select("parcel_id").distinct().join(t.parcels.where("id % 3 <> 0").select(F.col("id").alias("parcel_id")), "parcel_id", "left_anti")


@query("prompt_box", "parcels", "SELECT id, CAST(floor((x0 - 0.15 * (x1 - x0)) * 2) AS BIGINT) AS px0, CAST(floor((2000 - y1 - 0.15 * (y1 - y0)) * 2) AS BIGINT) AS py0, x0 + x1 AS cx, 4000 - y0 - y1 AS cy FROM parcels")
def prompt_box(t):
    """Bounds padded by 15 % as a pixel box at half a metre, y flipped, and the centre's pixel."""
    return t.parcels.selectExpr("id", "cast(floor((x0 - 0.15 * (x1 - x0)) * 2) as bigint) px0", "cast(floor((2000 - y1 - 0.15 * (y1 - y0)) * 2) as bigint) py0", "x0 + x1 cx", "4000 - y0 - y1 cy")


@query("attach_qa", "candidates qa_flags", "SELECT c.id, c.parcel_id, q.on_plate, q.suspect FROM candidates c LEFT JOIN qa_flags q ON c.parcel_id = q.id")
def attach_qa(t):
    return t.candidates.join(t.qa_flags.withColumnRenamed("id", "parcel_id"), "parcel_id", "left").select("id", "parcel_id", "on_plate", "suspect")


@query("block_merge", "blocks", "SELECT b.block_id, b.x0, count(s_suppkey) AS n FROM blocks b JOIN supplier s ON b.block_id = s.s_suppkey GROUP BY ALL")
def block_merge(t):
    return t.blocks.join(t.supplier.select(F.col("s_suppkey").alias("block_id")), "block_id").groupBy("block_id", "x0").agg(F.count("*").alias("n"))


@query("blob_merge", "parcels qa_flags", "SELECT p.id, coalesce(CASE WHEN q.on_plate AND q.suspect THEN 'partial_blob' WHEN q.on_plate THEN 'on_solid_blob' WHEN q.id IS NOT NULL THEN 'not_on_blob' END, 'off_plate') AS blob_class FROM parcels p LEFT JOIN qa_flags q USING (id)")
def blob_merge(t):
    q = t.qa_flags.select("id", ladder((F.col("on_plate") & F.col("suspect"), "partial_blob"), (F.col("on_plate"), "on_solid_blob"), default="not_on_blob").alias("k"))
    return t.parcels.join(q, "id", "left").select("id", F.coalesce("k", F.lit("off_plate")).alias("blob_class"))


@query("split_assign", "candidates", "SELECT c.id, coalesce(m.split, 'unassigned') AS split FROM candidates c LEFT JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM nation) m ON c.parcel_id % 30 = m.k")
def split_assign(t):
    m = t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), F.when(F.col("n_nationkey") % 5 == 0, "val").otherwise("train").alias("split"))
    return t.candidates.withColumn("k", F.col("parcel_id") % 30).join(m, "k", "left").select("id", F.coalesce("split", F.lit("unassigned")).alias("split"))


@query("replay_diff", "parcels", "WITH a AS (SELECT id, x0 FROM parcels WHERE id % 5 <> 0), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE x0 END AS x0 FROM parcels WHERE id % 4 <> 0) SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS added, b.id IS NULL AS lost FROM a FULL JOIN b ON a.id = b.id WHERE a.x0 IS DISTINCT FROM b.x0")
def replay_diff(t):
    a = t.parcels.where("id % 5 <> 0").select(F.col("id").alias("a_id"), F.col("x0").alias("a_x0"))
    b = t.parcels.where("id % 4 <> 0").select(F.col("id").alias("b_id"), F.when(F.col("id") % 7 != 0, F.col("x0")).alias("b_x0"))
    both = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer").where(~F.col("a_x0").eqNullSafe(F.col("b_x0")))
    return both.select(F.coalesce("a_id", "b_id").alias("id"), F.col("a_id").isNull().alias("added"), F.col("b_id").isNull().alias("lost"))


@query("unscorable_edges", "candidates", "SELECT id FROM parcels WHERE id NOT IN (SELECT parcel_id FROM candidates)")
def unscorable_edges(t):
    return t.parcels.select("id").join(t.candidates.select(F.col("parcel_id").alias("id")), "id", "left_anti")


@query("completion_check", "blocks", "SELECT (SELECT count(*) FROM blocks WHERE block_id NOT IN (SELECT c_custkey FROM customer)) AS missing, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT block_id FROM blocks)) AS extra")
def completion_check(t):
    a, b = t.blocks.select(F.col("block_id").alias("k")), t.customer.select(F.col("c_custkey").cast("bigint").alias("k"))
    sides = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full_outer")
    return sides.agg(F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"))


@query("block_workflows", "blocks", "SELECT block_id, w FROM blocks, (VALUES ('trace'), ('correct')) v(w)")
def block_workflows(t):
    return t.blocks.select("block_id", F.explode(F.array(F.lit("trace"), F.lit("correct"))).alias("w"))


@query("class_counts", "findings", "SELECT category, confidence, count(*) AS n FROM findings GROUP BY ALL")
def class_counts(t):
    return t.findings.groupBy("category", "confidence").agg(F.count("*").alias("n"))


@query("road_rule_summary", sql="SELECT l_returnflag AS rulefile, count(*) AS roads, count_if(l_linenumber > 3) AS measured, round_even(median(CASE WHEN l_linenumber > 3 THEN CAST(l_quantity AS DOUBLE) END), 2) AS median_width FROM lineitem GROUP BY 1")
def road_rule_summary(t):
    n = F.col("l_linenumber") > 3
    return t.lineitem.groupBy(F.col("l_returnflag").alias("rulefile")).agg(F.count("*").alias("roads"), F.count_if(n).alias("measured"), rounded(F.expr("percentile(CASE WHEN l_linenumber > 3 THEN cast(l_quantity as double) END, 0.5)"), 2).alias("median_width"))


@query("qa_summary", "parcels qa_flags", "SELECT count(*) AS n, count_if(q.on_plate IS NULL) AS off_plate, median(x1 - x0) AS median_w, quantile_cont(y1 - y0, 0.1) AS p10_h, count_if((x1 - x0) * (y1 - y0) >= 400) AS big FROM parcels p LEFT JOIN qa_flags q USING (id)")
def qa_summary(t):
    j = t.parcels.join(t.qa_flags, "id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("on_plate").isNull()).alias("off_plate"), F.expr("percentile(x1 - x0, 0.5)").alias("median_w"), F.expr("percentile(y1 - y0, 0.1)").alias("p10_h"), F.count_if(area() >= 400).alias("big"))


@query("percentiles", "line_points", "SELECT line_id, quantile_cont(y, 0.5) AS p50, round_even(quantile_cont(y, 0.9), 6) AS p90 FROM line_points GROUP BY line_id")
def percentiles(t):
    """Exact percentiles; a NaN counts as missing."""
    y = F.nullif(F.col("y").cast("double"), F.lit(float("nan")))
    return t.line_points.select("line_id", y.alias("y")).groupBy("line_id").agg(F.percentile("y", 0.5).alias("p50"), rounded(F.percentile("y", 0.9)).alias("p90"))


@query("dup_geoms", "candidates", "SELECT count(*) AS n, count(DISTINCT (x0, y0, x1, y1)) AS kinds, count(*) - count(DISTINCT (x0, y0, x1, y1)) AS dups FROM candidates")
def dup_geoms(t):
    """Geometries that another row has, too: a box is its own normal form."""
    kinds = F.count_distinct(F.sha2(F.concat_ws(",", "x0", "y0", "x1", "y1"), 256))
    return t.candidates.agg(F.count("*").alias("n"), kinds.alias("kinds"), (F.count("*") - kinds).alias("dups"))


@query("import_check", "parcels", "SELECT count(*) AS n, count_if(x1 <= x0) AS empty, list_sort(list(DISTINCT id % 4)) AS srids FROM parcels")
def import_check(t):
    return t.parcels.agg(F.count("*").alias("n"), F.count_if(F.col("x1") <= F.col("x0")).alias("empty"), F.array_sort(F.collect_set(F.col("id") % 4)).alias("srids"))


@query("all_valid", "parcels", "SELECT id % 10 AS g, bool_and(x1 - x0 >= 9) AS all_valid, bool_or(x1 - x0 >= 31) AS any_wide FROM parcels GROUP BY 1")
def all_valid(t):
    return t.parcels.groupBy((F.col("id") % 10).alias("g")).agg(F.bool_and(F.col("x1") - F.col("x0") >= 9).alias("all_valid"), F.bool_or(F.col("x1") - F.col("x0") >= 31).alias("any_wide"))


@query("grid_theta", "line_points", """WITH s AS (SELECT line_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)), g AS (SELECT line_id, sum(sqrt(dx * dx + dy * dy) * cos(4 * atan2(dy, dx))) AS c, sum(sqrt(dx * dx + dy * dy) * sin(4 * atan2(dy, dx))) AS s FROM s WHERE dx IS NOT NULL GROUP BY 1)
SELECT line_id, CASE WHEN sqrt(s * s + c * c) < 1e-9 THEN 10.0 ELSE round_even(((degrees(atan2(s, c)) / 4) % 90 + 90) % 90, 4) END AS theta FROM g""")
def grid_theta(t):
    """Length-weighted circular mean of the directions of a line's segments modulo 90 degrees; 10 where they cancel out."""
    w = W.partitionBy("line_id").orderBy("pos")
    step = lambda c: (F.col(c) - F.lag(c).over(w)).cast("double")
    s = t.line_points.select("line_id", step("x").alias("dx"), step("y").alias("dy")).where("dx IS NOT NULL")
    turn = 4 * F.atan2("dy", "dx")
    g = s.groupBy("line_id").agg(F.sum(F.hypot("dx", "dy") * F.cos(turn)).alias("c"), F.sum(F.hypot("dx", "dy") * F.sin(turn)).alias("s"))
    return g.select("line_id", F.when(F.hypot("c", "s") < 1e-9, 10.0).otherwise(rounded(F.pmod(F.degrees(F.atan2("s", "c")) / 4, F.lit(90.0)), 4)).alias("theta"))


@query("weighted_mean", "candidates", "SELECT parcel_id, round_even(CAST(sum((x1 - x0) * y0) AS DOUBLE) / sum(x1 - x0), 6) AS y FROM candidates GROUP BY 1")
def weighted_mean(t):
    w = F.col("x1") - F.col("x0")
    return t.candidates.groupBy("parcel_id").agg(rounded(F.sum(w * F.col("y0")).cast("double") / F.sum(w)).alias("y"))


@query("total_bounds", "candidates", "SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM candidates")
def total_bounds(t):
    return t.candidates.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("prf_totals", "pairs", """WITH m AS (SELECT count(DISTINCT a_id) AS tp FROM pairs WHERE inter / CAST(a_area + b_area - inter AS DOUBLE) >= 0.6), k AS (SELECT tp, (SELECT count(*) FROM candidates) - tp AS fp, (SELECT count(*) FROM parcels) - tp AS fn FROM m)
SELECT tp, fp, fn, round_even(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round_even(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round_even(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM k""")
def prf_totals(t):
    """Precision, recall and F1 of the one-to-one matches at an IoU of 0.6; null where a denominator is 0."""
    from atlasforge.operators.matching import match
    from atlasforge.plans.spatial import scored_pairs

    one = lambda d, name: d.agg(F.count("*").alias(name))
    d = one(match(scored_pairs(t), 0.6), "tp").crossJoin(one(t.candidates, "preds")).crossJoin(one(t.parcels, "refs"))  # one row each
    part = lambda a, b: rounded(a.cast("double") / F.nullif(b, F.lit(0)))
    tp, fp, fn = F.col("tp"), F.col("preds") - F.col("tp"), F.col("refs") - F.col("tp")
    return d.select("tp", fp.alias("fp"), fn.alias("fn"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("spanned_hist", "candidates", "SELECT least(n, 5) AS spanned, count(*) AS parcels FROM (SELECT parcel_id, count(*) AS n FROM candidates GROUP BY 1) GROUP BY 1")
def spanned_hist(t):
    return t.candidates.groupBy("parcel_id").agg(F.count("*").alias("n")).groupBy(F.least("n", F.lit(5)).alias("spanned")).agg(F.count("*").alias("parcels"))


_DISPO = "CASE WHEN id % 11 = 0 THEN 'fixed_add' WHEN id % 7 = 0 THEN 'fixed_delete' WHEN id % 5 = 0 THEN 'fixed_reshape' WHEN id % 3 = 0 THEN 'needs_review' ELSE 'dismissed' END"


@query("best_disposition", "findings", f"SELECT tile_no, arg_max(d, list_position(['dismissed','needs_review','fixed_reshape','fixed_delete','fixed_add'], d)) AS disposition FROM (SELECT tile_no, {_DISPO} AS d FROM findings) GROUP BY 1")
def best_disposition(t):
    d = t.findings.select("tile_no", F.expr(_DISPO).alias("d"))
    return d.groupBy("tile_no").agg(F.max_by("d", rank_of(F.col("d"), DISPOSITIONS)).alias("disposition"))


@query("verify_summary", "pairs", """WITH f AS (SELECT a_id, b_id, inter / CAST(a_area + b_area - inter AS DOUBLE) AS iou, b_area / CAST(a_area AS DOUBLE) AS ratio FROM pairs), g AS (SELECT a_id, arg_min(iou, b_id) AS point, arg_min(ratio, b_id) AS point_r, arg_max(iou, (iou, -b_id)) AS box, arg_max(ratio, (iou, -b_id)) AS box_r FROM f GROUP BY 1), u AS (SELECT 'point' AS mode, point AS v, point_r AS r FROM g UNION ALL SELECT 'point_box', box, box_r FROM g)
SELECT mode, count(*) AS n, round_even(avg(v), 6) AS mean, round_even(median(v), 6) AS median, count_if(v >= 0.5) AS n50, count_if(v >= 0.7) AS n70, count_if(v >= 0.9) AS n90, round_even(median(r), 6) AS median_ratio FROM u GROUP BY 1""")
def verify_summary(t):
    """Each reference's first and best prediction as two modes: IoU and area ratio, summed up by mode."""
    from atlasforge.plans.spatial import pair_iou, pairs_of

    f = pairs_of(t).select("a_id", "b_id", pair_iou().alias("iou"), (area("b_") / area("a_")).alias("ratio"))
    one = F.struct("iou", "ratio")
    g = f.groupBy("a_id").agg(F.min_by(one, "b_id").alias("point"), F.max_by(one, F.struct("iou", -F.col("b_id"))).alias("point_box"))
    u = g.select("point", "point_box").unpivot([], ["point", "point_box"], "mode", "s").select("mode", F.col("s.iou").alias("v"), F.col("s.ratio").alias("r"))
    return u.groupBy("mode").agg(F.count("*").alias("n"), rounded(F.avg("v")).alias("mean"), rounded(F.percentile("v", 0.5)).alias("median"), *(F.count_if(F.col("v") >= x).alias(f"n{int(x * 100)}") for x in (0.5, 0.7, 0.9)), rounded(F.percentile("r", 0.5)).alias("median_ratio"))


@query("class_balance", "raster", "SELECT round_even(p, 6) AS pos_frac, round_even(least(6.0, greatest(1.0, (1 - p) / greatest(p, 0.001) * 0.5)), 6) AS weight FROM (SELECT CAST(sum(CASE WHEN gray < 110 THEN c % 2 ELSE 0 END) AS DOUBLE) / greatest(1, sum(c % 2)) AS p FROM raster)")
def class_balance(t):
    w = F.col("c") % 2
    d = t.raster.agg((F.sum(F.when(F.col("gray") < 110, w).otherwise(0)).cast("double") / F.greatest(F.lit(1), F.sum(w))).alias("p"))
    return d.select(rounded(F.col("p")).alias("pos_frac"), rounded(clamp((1 - F.col("p")) / F.greatest("p", F.lit(0.001)) * 0.5, 1.0, 6.0)).alias("weight"))


@query("ne_band_split", "blocks", "SELECT block_id, CASE WHEN cum * 5 <= total THEN 'val' ELSE 'train' END AS split FROM (SELECT block_id, sum(n) OVER (ORDER BY x0 + y0 DESC, block_id ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS total FROM (SELECT block_id, x0, y0, block_id % 7 + 1 AS n FROM blocks))")
def ne_band_split(t):
    """Blocks from the north-east until a fifth of the total is reached; the block that crosses it trains."""
    b = t.blocks.withColumn("n", F.col("block_id") % 7 + 1)
    cum = F.sum("n").over(W.orderBy((F.col("x0") + F.col("y0")).desc(), "block_id").rowsBetween(W.unboundedPreceding, 0))
    total = b.agg(F.sum("n").alias("total"))
    return b.withColumn("cum", cum).crossJoin(F.broadcast(total)).select("block_id", F.when(F.col("cum") * 5 <= F.col("total"), "val").otherwise("train").alias("split"))


@query("rolling_median", "raster", "SELECT r, quantile_cont(m, 0.5) OVER (ORDER BY r ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS smooth FROM (SELECT r, max(CASE WHEN gray < 110 THEN c END) AS m FROM raster GROUP BY r)")
def rolling_median(t):
    """Median over eight rows to each side; one row a raster row, partitioned into overlapping bands."""
    from atlasforge.operators.ordered import banded

    rows = t.raster.groupBy("r").agg(F.max(F.when(F.col("gray") < 110, F.col("c"))).alias("m"))
    return banded(rows, "r", 8, lambda w: F.expr("percentile(m, 0.5)").over(w.rowsBetween(-8, 8)), "smooth").select("r", "smooth")


@query("interp_gaps", "raster", """WITH m AS (SELECT r, max(CASE WHEN gray < 40 THEN c END) AS m FROM raster GROUP BY r), n AS (SELECT r, m, last_value(m IGNORE NULLS) OVER a AS pm, last_value(CASE WHEN m IS NOT NULL THEN r END IGNORE NULLS) OVER a AS pr, first_value(m IGNORE NULLS) OVER b AS nm, first_value(CASE WHEN m IS NOT NULL THEN r END IGNORE NULLS) OVER b AS nr FROM m WINDOW a AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT r, round_even(CASE WHEN m IS NOT NULL THEN m WHEN pm IS NULL THEN nm WHEN nm IS NULL THEN pm ELSE pm + (nm - pm) * (r - pr) / CAST(nr - pr AS DOUBLE) END, 6) AS edge FROM n""")
def interp_gaps(t):
    """Gaps of a row series filled linearly, the ends held."""
    from atlasforge.operators.ordered import around

    m = around(t.raster.groupBy("r").agg(F.max(F.when(F.col("gray") < 40, F.col("c"))).alias("m")), "r", "m")
    pm, pr, nm, nr = (F.col(c) for c in ("before", "before_key", "after", "after_key"))
    lerp = pm + (nm - pm) * (F.col("r") - pr) / F.nullif(nr - pr, F.lit(0)).cast("double")
    return m.select("r", rounded(F.coalesce(F.col("m").cast("double"), F.when(pm.isNull(), nm), F.when(nm.isNull(), pm), lerp)).alias("edge"))


@query("row_envelope", "raster", "SELECT r, max(c) AS edge FROM raster WHERE gray < 110 GROUP BY r")
def row_envelope(t):
    return t.raster.where("gray < 110").groupBy("r").agg(F.max("c").alias("edge"))


@query("ring_edges", "line_points", "SELECT line_id, pos, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)")
def ring_edges(t):
    """Each vertex with the next one of its ring, the last with the first."""
    w = W.partitionBy("line_id").orderBy("pos")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w)).alias("n" + c)
    return t.line_points.select("line_id", "pos", "x", "y", nxt("x"), nxt("y"))


@query("ordered_findings", "findings", f"SELECT id, row_number() OVER (PARTITION BY tile_no ORDER BY list_position(['false_positive','missing_split','shape_mismatch','missing_feature'], category), id) AS turn FROM findings WHERE {VALID}")
def ordered_findings(t):
    """The order in which a tile's findings are worked off."""
    w = W.partitionBy("tile_no").orderBy(rank_of(F.col("category"), CATEGORIES), "id")
    return t.findings.where(VALID).select("id", F.row_number().over(w).alias("turn"))


@query("best_epoch", sql="SELECT run, arg_max(it, v * 100000 - it) AS best FROM (SELECT o_custkey % 20 AS run, o_orderkey % 1000 AS it, max(o_orderkey * 7 % 101) AS v FROM orders GROUP BY ALL) GROUP BY 1")
def best_epoch(t):
    """The first iteration with the highest score."""
    d = t.orders.selectExpr("o_custkey % 20 run", "o_orderkey % 1000 it", "o_orderkey * 7 % 101 v")
    return d.groupBy("run").agg(F.max_by("it", F.struct("v", -F.col("it"))).alias("best"))


@query("stratified_sample", "parcels", "SELECT cell, id FROM (SELECT id, gx * 5 + gy AS cell, row_number() OVER (PARTITION BY gx, gy ORDER BY (id * 7919) % 10007, id) AS k FROM (SELECT id, least(4, x0 * 5 // 2000) AS gx, least(4, y0 * 5 // 2000) AS gy FROM parcels)) WHERE k = 1")
def stratified_sample(t):
    """One parcel by a fixed pseudo-random order from each cell of a 5 by 5 grid."""
    g = t.parcels.select("id", (digitize(F.col("x0"), 0, 2000, 5) * 5 + digitize(F.col("y0"), 0, 2000, 5)).alias("cell"), ((F.col("id") * 7919) % 10007).alias("u"))
    return g.groupBy("cell").agg(F.min(F.struct("u", "id"))["id"].alias("id"))


@query("union_layers", "parcels candidates", "SELECT id, NULL AS prio, 'reference' AS layer FROM parcels UNION ALL SELECT id, prio, 'machine' AS layer FROM candidates")
def union_layers(t):
    return t.parcels.select("id", F.lit("reference").alias("layer")).unionByName(t.candidates.select("id", "prio", F.lit("machine").alias("layer")), allowMissingColumns=True)


@query("anchored_components", "candidates", "SELECT DISTINCT parcel_id FROM candidates WHERE parcel_id IN (SELECT s_suppkey FROM supplier)")
def anchored_components(t):
    return t.candidates.select("parcel_id").distinct().join(t.supplier.select(F.col("s_suppkey").cast("bigint").alias("parcel_id")), "parcel_id", "left_semi")


@query("insert_if_absent", "parcels", "SELECT id, x0, 'old' AS src FROM parcels WHERE id % 3 <> 0 UNION ALL SELECT id, x0, 'new' AS src FROM parcels WHERE id % 3 = 0 OR id < 0")
def insert_if_absent(t):
    """Rows whose key is absent are appended; others stay as they are."""
    old = t.parcels.where("id % 3 <> 0").select("id", "x0")
    new = t.parcels.select("id", "x0").join(old.select("id"), "id", "left_anti")
    return old.withColumn("src", F.lit("old")).unionByName(new.withColumn("src", F.lit("new")))


@query("angle_gaps", "candidates", "SELECT id, abs((((id * 13) % 360 - 138 + 90) % 180 + 180) % 180 - 90) AS gap FROM candidates")
def angle_gaps(t):
    return t.candidates.select("id", angle_gap((F.col("id") * 13) % 360, F.lit(138), 180).cast("bigint").alias("gap"))


@query("snap_theta", "candidates", "SELECT id, CASE WHEN abs(g) <= 10 THEN own - g ELSE own END AS theta FROM (SELECT id, own, ((own - 9.5 + 45) % 90 + 90) % 90 - 45 AS g FROM (SELECT id, CAST(id % 90 AS DOUBLE) AS own FROM candidates))")
def snap_theta(t):
    return t.candidates.select("id", snap((F.col("id") % 90).cast("double"), F.lit(9.5), 10).alias("theta"))


@query("alignment_class", "parcels qa_flags", "SELECT id, CASE WHEN q.id IS NULL THEN 'off_plate' WHEN p.id % 13 >= 9 THEN 'modern_proxy_suspect' WHEN p.id % 10 < 5 OR p.id % 100 < 10 THEN 'weak_ink_support' ELSE 'aligned' END AS qa_class FROM parcels p LEFT JOIN qa_flags q USING (id)")
def alignment_class(t):
    """Precedence: off plate, modern proxy, weak support, aligned; a missing measure makes a test false."""
    j = t.parcels.join(t.qa_flags, "id", "left")
    near, gain, osm = F.col("id") % 10, F.col("id") % 100, F.col("id") % 13
    return j.select("id", ladder((F.col("on_plate").isNull(), "off_plate"), (osm >= 9, "modern_proxy_suspect"), ((near < 5) | (gain < 10), "weak_ink_support"), default="aligned").alias("qa_class"))


@query("blob_class", "parcels", "SELECT id, CASE WHEN id % 10 >= 5 AND id % 4 >= 1 THEN 'on_solid_blob' WHEN id % 10 >= 3 THEN 'partial_blob' ELSE 'not_on_blob' END AS blob_class FROM parcels")
def blob_class(t):
    inside, contrast = F.col("id") % 10, F.col("id") % 4
    return t.parcels.select("id", ladder(((inside >= 5) & (contrast >= 1), "on_solid_blob"), (inside >= 3, "partial_blob"), default="not_on_blob").alias("blob_class"))


@query("attr_mismatch", "parcels", "SELECT count_if(a IS DISTINCT FROM b) AS cells FROM (SELECT CASE WHEN id % 6 = 0 THEN NULL ELSE id END AS a, CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS b FROM parcels)")
def attr_mismatch(t):
    """Cells that differ after normalisation: integers written as floats and spellings of null are equal."""
    from atlasforge.functions.text import normal_text

    a = F.when(F.col("id") % 6 == 0, "\\N").otherwise(F.concat(F.col("id").cast("string"), F.lit(".0")))
    b = F.when(F.col("id") % 4 == 0, "").otherwise(F.col("id").cast("string"))
    return t.parcels.agg(F.count_if(~normal_text(a).eqNullSafe(normal_text(b))).alias("cells"))


@query("import_gate", "parcels", "SELECT count(*) = (SELECT count(*) FROM part) AS count_ok, count_if(x0 IS NULL) = 0 AS no_null, count_if((x1 - x0) * (y1 - y0) <= 0) = 0 AS no_empty, count(*) = count(DISTINCT id) AS unique_ids FROM parcels")
def import_gate(t):
    """The count must be the one that the source's manifest states."""
    stated = t.part.agg(F.count("*").alias("stated"))
    seen = t.parcels.agg(F.count("*").alias("n"), (F.count_if(F.col("x0").isNull()) == 0).alias("no_null"), (F.count_if(area() <= 0) == 0).alias("no_empty"), (F.count("*") == F.count_distinct("id")).alias("unique_ids"))
    return seen.crossJoin(stated).select((F.col("n") == F.col("stated")).alias("count_ok"), "no_null", "no_empty", "unique_ids")  # one row each


@query("provenance_gate", "candidates", "SELECT prio, count(DISTINCT parcel_id % 2) = 1 AS same_source, sha256(list_aggregate(list_sort(list(DISTINCT CAST(parcel_id % 5 AS VARCHAR))), 'string_agg', ',')) AS digest FROM candidates GROUP BY prio")
def provenance_gate(t):
    keys = F.array_sort(F.collect_set((F.col("parcel_id") % 5).cast("string")))
    return t.candidates.groupBy("prio").agg((F.count_distinct(F.col("parcel_id") % 2) == 1).alias("same_source"), F.sha2(F.array_join(keys, ","), 256).alias("digest"))


@query("finding_disposition", "findings", f"""SELECT id, CASE WHEN category = 'false_positive' THEN CASE WHEN d >= 50 AND f >= 70 THEN 'dismissed' WHEN d >= 50 THEN 'fixed_delete' WHEN h < 6 THEN 'fixed_delete' WHEN h < 15 THEN 'needs_review' ELSE 'dismissed' END
WHEN category = 'missing_feature' THEN CASE WHEN f > 75 THEN 'dismissed' WHEN h >= 22 OR d >= 50 THEN 'fixed_add' WHEN h >= 10 THEN 'needs_review' ELSE 'dismissed' END
WHEN category = 'shape_mismatch' THEN CASE WHEN d > 80 OR f > 75 THEN 'fixed_reshape' WHEN d > 60 THEN 'needs_review' ELSE 'dismissed' END
ELSE CASE WHEN h >= 50 THEN 'fixed_split' ELSE 'needs_review' END END AS disposition FROM (SELECT id, category, id * 31 % 100 AS h, id * 17 % 100 AS d, id * 7 % 100 AS f FROM findings WHERE {VALID})""")
def finding_disposition(t):
    """What the evidence (hatch h, dark d, fit f, in percent) decides about a finding."""
    from atlasforge.operators.edits import disposition

    e = t.findings.where(VALID).select("id", "category", (F.col("id") * 31 % 100).alias("h"), (F.col("id") * 17 % 100).alias("d"), (F.col("id") * 7 % 100).alias("f"))
    return e.select("id", disposition(*(F.col(c) for c in ("category", "h", "d", "f"))).alias("disposition"))


@query("changed_tiles", "findings", f"SELECT array_to_string(list_sort(list(DISTINCT printf('T%02d', tile_no))), ',') AS tiles FROM findings WHERE {VALID} AND confidence = 'high'")
def changed_tiles(t):
    """Tiles that a finding of high confidence changes, as one sorted list."""
    return t.findings.where(VALID).where("confidence = 'high'").agg(F.array_join(F.array_sort(F.collect_set(F.format_string("T%02d", "tile_no"))), ",").alias("tiles"))


@query("report_json", "findings", "SELECT category, to_json({'n': count(*), 'errors': count_if(err), 'high': count_if(confidence = 'high')}) AS report FROM findings GROUP BY category")
def report_json(t):
    body = F.struct(F.count("*").alias("n"), F.count_if("err").alias("errors"), F.count_if(F.col("confidence") == "high").alias("high"))
    return t.findings.groupBy("category").agg(F.to_json(body).alias("report"))


@query("emit_sql_values", "parcels", "SELECT id, '(' || id || ', NULL, ''' || replace(p_name, '''', '''''') || ''', ' || x0 || ')' AS line FROM parcels JOIN part ON id = p_partkey")
def emit_sql_values(t):
    """A VALUES line a row, quotes doubled."""
    j = t.parcels.join(t.part.select(F.col("p_partkey").alias("id"), "p_name"), "id")
    return j.select("id", F.concat(F.lit("("), "id", F.lit(", NULL, '"), F.replace("p_name", F.lit("'"), F.lit("''")), F.lit("', "), "x0", F.lit(")")).alias("line"))


@query("iou_report", "pairs", """WITH b AS (SELECT p.id, coalesce(max(inter / CAST(a_area + b_area - inter AS DOUBLE)), 0) AS best FROM parcels p LEFT JOIN pairs ON p.id = a_id GROUP BY 1)
SELECT id, '| ' || id || ' | ' || printf('%.3f', round_even(best, 3)) || ' |' AS line FROM b UNION ALL SELECT NULL, '| mean | ' || printf('%.3f', round_even(avg(best), 3)) || ' |' FROM b""")
def iou_report(t):
    """A table row for each reference, and one with the mean."""
    from atlasforge.plans.spatial import best_iou

    b = t.parcels.select("id").join(best_iou(t), "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))
    number = lambda c: F.format_string("%.3f", rounded(c, 3))
    rows = b.select("id", F.concat(F.lit("| "), "id", F.lit(" | "), number(F.col("best")), F.lit(" |")).alias("line"))
    return rows.unionByName(b.agg(F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("| mean | "), number(F.avg("best")), F.lit(" |")).alias("line")))


@query("resume_pending_tiles", "findings", "SELECT DISTINCT tile_no FROM findings WHERE tile_no >= 5")
def resume_pending_tiles(t):
    """A run that ended after five tiles, each written as a file of its own, goes on with the others."""
    from atlasforge.sources.files import checkpoint_tiles, pending

    done = checkpoint_tiles(t.findings.where("tile_no < 5").select("id", "tile_no"), "tile_no")
    return pending(t.findings.select("tile_no").distinct(), done, "tile_no")


@query("merge_checkpoints", "findings", "SELECT tile_no, count(*) AS n, min(id) AS first FROM findings GROUP BY 1")
def merge_checkpoints(t):
    """All tile files read as one table."""
    from atlasforge.sources.files import checkpoint_tiles

    return checkpoint_tiles(t.findings.select("id", "tile_no"), "tile_no").groupBy("tile_no").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("values_wkb", sql="SELECT source_row, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (VALUES (1, 1.5, -2.0), (2, 0.0, 10.25)) v(source_row, x, y)")
def values_wkb(t):
    """Inline rows of hexadecimal WKB points, decoded."""
    from atlasforge.sources.wkb import point_x, point_y

    rows = [(1, "0101000000000000000000F83F00000000000000C0"), (2, "010100000000000000000000000000000000802440")]
    d = t.spark.createDataFrame(rows, "source_row int, hex string").withColumn("wkb", F.unhex("hex"))
    return d.select("source_row", point_x("wkb").alias("x"), point_y("wkb").alias("y"))


@query("geojson_scan", "parcels", "SELECT id, x0, y0, x1, y1 FROM parcels")
def geojson_scan(t):
    """Features with polygon rings written as GeoJSON text and read back to boxes."""
    from atlasforge.sources.geojson import boxes, features

    ring = F.expr("array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1), array(x0, y0))")
    text = t.parcels.groupBy(F.expr("id div 100")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(F.struct(F.struct("id").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("features"))).alias("value"))
    return boxes(features(text.select("value"), "id bigint"), "id")


@query("block_coverage", "candidates blocks", """SELECT block_id, n, cov, CASE WHEN block_id % 10 = 9 THEN 'off_plate' WHEN n = 0 THEN 'no_drawn_cells' WHEN cov * 10 >= 9 * n AND n >= 3 THEN 'exhaustive' WHEN cov * 10 >= 3 * n THEN 'partial' ELSE 'sparse' END AS cls
FROM (SELECT block_id, count(c.id) AS n, coalesce(count_if(c.id % 3 > 0), 0) AS cov FROM blocks b LEFT JOIN candidates c ON c.x0 >= b.x0 AND c.x0 < b.x1 AND c.y0 >= b.y0 AND c.y0 < b.y1 GROUP BY 1)""")
def block_coverage(t):
    """A block's class by the share of its cells that are covered."""
    from atlasforge.operators.spatial import points_in

    at = points_in(t.candidates.select("id", F.col("x0").alias("px"), F.col("y0").alias("py")), t.blocks, "px", "py", "block_id")
    n = at.groupBy("block_id").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 3 > 0).alias("cov"))
    b = t.blocks.select("block_id").join(n, "block_id", "left").select("block_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cov", F.lit(0)).alias("cov"))
    return b.withColumn("cls", ladder((F.col("block_id") % 10 == 9, "off_plate"), (F.col("n") == 0, "no_drawn_cells"), ((F.col("cov") * 10 >= 9 * F.col("n")) & (F.col("n") >= 3), "exhaustive"), (F.col("cov") * 10 >= 3 * F.col("n"), "partial"), default="sparse"))


@query("proposed_split", "candidates blocks qa_flags", """WITH s AS (SELECT block_id, CASE WHEN cum * 5 <= total THEN 'val' ELSE 'train' END AS split FROM (SELECT block_id, sum(block_id % 7 + 1) OVER (ORDER BY x0 + y0 DESC, block_id ROWS UNBOUNDED PRECEDING) AS cum, sum(block_id % 7 + 1) OVER () AS total FROM blocks))
SELECT c.id, CASE WHEN q.on_plate IS DISTINCT FROM true THEN 'excluded_off_plate' ELSE coalesce(s.split, 'unassigned') END AS split FROM candidates c LEFT JOIN s ON c.parcel_id % 120 = s.block_id LEFT JOIN qa_flags q ON c.parcel_id = q.id""")
def proposed_split(t):
    s = ne_band_split(t).withColumnRenamed("block_id", "k")
    q = t.qa_flags.select(F.col("id").alias("parcel_id"), "on_plate")
    j = t.candidates.withColumn("k", F.col("parcel_id") % 120).join(s, "k", "left").join(q, "parcel_id", "left")
    return j.select("id", F.when(~F.col("on_plate").eqNullSafe(True), "excluded_off_plate").otherwise(F.coalesce("split", F.lit("unassigned"))).alias("split"))
