"""Queries of scalars, files and small operators that the other modules do not hold."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasforge.functions.columns import area, blank, confidence, logistic, rounded
from atlasforge.operators import raster as R
from atlasforge.operators.spatial import overlapping
from atlasforge.plans.registry import query
from atlasforge.plans.spatial import pairs_of
from atlasforge.staging import shared_path

C = F.col


@query("text_scalar", sql="SELECT '2026-09-07T12:00:00Z' AS snapshot")
def text_scalar(t):
    """A one-line text file as a trimmed value."""
    path = shared_path(t.spark, "snapshot")
    t.spark.range(1).select(F.lit("  2026-09-07T12:00:00Z \n").alias("value")).write.text(path)
    return t.spark.read.text(path).where(~blank(C("value"))).select(F.trim("value").alias("snapshot"))


@query("json_document", "blocks", "SELECT count(*) AS blocks, max(x1) AS x1, CAST('v5' AS VARCHAR) AS version, CAST(NULL AS VARCHAR) AS missing FROM blocks")
def json_document(t):
    """A manifest written as one JSON document of several lines and read as one; a field that it lacks is null."""
    path = shared_path(t.spark, "manifest")
    body = F.to_json(F.struct(F.lit("v5").alias("version"), F.struct(F.count("*").alias("blocks"), F.max("x1").alias("x1")).alias("counts")), {"pretty": "true"})
    t.blocks.agg(body.alias("value")).write.text(path)
    found = t.spark.read.schema("version string, missing string, counts struct<blocks: bigint, x1: bigint>").json(path, multiLine=True)
    return found.select("counts.blocks", "counts.x1", "version", "missing")


@query("csv_round_trip", "candidates", "SELECT id, parcel_id, (x1 - x0) * (y1 - y0) AS area, CASE WHEN id % 7 = 0 THEN NULL ELSE prio END AS prio FROM candidates")
def csv_round_trip(t):
    """Rows written as CSV with a header, nulls by their sign, and read back by their types."""
    from atlasforge.sources.catalog_csv import NULL_TEXT, read

    path = shared_path(t.spark, "candidates")
    prio = F.when(C("id") % 7 != 0, C("prio")).otherwise(NULL_TEXT)
    t.candidates.select("id", "parcel_id", area().alias("area"), prio.alias("prio")).write.csv(path, header=True, quoteAll=True, escape='"')
    return read(t.spark, path, [("id", "bigint"), ("parcel_id", "bigint"), ("area", "bigint"), ("prio", "text")])


@query("index_catalog", sql="SELECT * FROM (VALUES ('buildings', 'buildings_pkey', 'CREATE UNIQUE INDEX ON buildings (id)'), ('roads', 'roads_geom', 'CREATE INDEX ON roads USING gist (\"geom\")')) v(relname, idx, def)")
def index_catalog(t):
    """A quoted catalog of indexes, quotes doubled inside."""
    from atlasforge.sources.catalog_csv import read

    path = shared_path(t.spark, "indexes")
    lines = ["relname,idx,def", '"buildings","buildings_pkey","CREATE UNIQUE INDEX ON buildings (id)"', '"roads","roads_geom","CREATE INDEX ON roads USING gist (""geom"")"']
    t.spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)
    return read(t.spark, path, [("relname", "text"), ("idx", "text"), ("def", "text")])


@query("wkb_boxes", "parcels", "SELECT id, x0, y0, x1, y1, 4326 AS srid FROM parcels")
def wkb_boxes(t):
    """Boxes as Parquet with a column of extended WKB polygons, read back to their bounds, a batch at a time."""
    from atlasforge.sources.wkb import box_polygons, polygon_bounds

    path = shared_path(t.spark, "geo")
    box_polygons(t.parcels.select("id", "x0", "y0", "x1", "y1"), 4326).write.parquet(path)
    return polygon_bounds(t.spark.read.parquet(path))


@query("row_validation", "candidates", "SELECT id FROM candidates WHERE x0 IS NOT NULL AND x1 > x0 AND y1 > y0")
def row_validation(t):
    """Rows whose geometry is there, valid and not empty."""
    return t.candidates.where("x0 IS NOT NULL AND x1 > x0 AND y1 > y0").select("id")


@query("first_clusters", "candidates", "SELECT parcel_id, n, k FROM (SELECT parcel_id, n, row_number() OVER (ORDER BY n DESC, parcel_id) AS k FROM (SELECT parcel_id, count(*) AS n FROM candidates GROUP BY 1)) WHERE k <= 12")
def first_clusters(t):
    """The twelve largest groups and their places: a top-k first, so only its rows are numbered."""
    top = t.candidates.groupBy("parcel_id").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "parcel_id").limit(12)
    return top.withColumn("k", F.row_number().over(W.orderBy(C("n").desc(), "parcel_id")))


@query("method_suffix", "pairs", "SELECT b_id AS id, CASE WHEN (b_area - inter) * 100 > 7 * b_area THEN 'ink+clamp' ELSE 'ink' END AS method, (b_area - inter) * 100 > 7 * b_area AS clamped FROM pairs")
def method_suffix(t):
    """A method's name grows by what was done, and is asked by its ending."""
    p = pairs_of(t).select(C("b_id").alias("id"), F.concat(F.lit("ink"), F.when((area("b_") - C("inter")) * 100 > 7 * area("b_"), "+clamp").otherwise("")).alias("method"))
    return p.withColumn("clamped", C("method").endswith("+clamp"))


@query("run_stamps", "blocks", "SELECT block_id, true AS uuid_ok, '2026-09-10T08:30:00Z' AS at FROM blocks")
def run_stamps(t):
    """A new id for each row, in the form of a version 4 UUID, and a time in UTC."""
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    at = F.date_format(F.expr("timestamp'2026-09-10 08:30:00'"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.blocks.select("block_id", F.uuid().rlike(form).alias("uuid_ok"), at.alias("at"))


@query("sigmoid", "raster", "SELECT r, c, round_even(1 / (1 + exp(-((gray - 128) / 32.0::DOUBLE))), 6) AS p FROM raster")
def sigmoid(t):
    return t.raster.select("r", "c", rounded(logistic((C("gray") - 128) / 32.0)).alias("p"))


@query("confidence_blend", "pairs", "SELECT b_id AS id, round_even(0.5::DOUBLE * (inter / CAST(b_area AS DOUBLE)) + 0.5::DOUBLE * (inter / CAST(a_area AS DOUBLE)), 3) AS confidence FROM pairs")
def confidence_blend(t):
    return pairs_of(t).select(C("b_id").alias("id"), confidence(C("inter") / area("b_"), C("inter") / area("a_")).alias("confidence"))


@query("blank_reviewers", "findings", "SELECT count_if(confidence IS NULL) AS missing, count_if(id % 10 = 0 AND confidence IS NOT NULL) AS spaces FROM findings")
def blank_reviewers(t):
    """Fields that are null, and ones that hold white space only."""
    f = t.findings.select("confidence", F.when(C("id") % 10 == 0, "  ").otherwise(C("confidence")).alias("reviewer"))
    return f.agg(F.count_if(blank(C("confidence"))).alias("missing"), F.count_if(blank(C("reviewer")) & ~blank(C("confidence"))).alias("spaces"))


@query("tile_list_split", "findings", "SELECT DISTINCT 'T' || printf('%02d', tile_no) AS tile FROM findings")
def tile_list_split(t):
    """A comma-joined list of tiles taken apart again; blanks in it are no tiles."""
    name = F.format_string("T%02d", "tile_no")
    joined = t.findings.agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("tiles")).select(F.concat("tiles", F.lit(", ,")).alias("tiles"))
    return joined.select(F.explode(F.split("tiles", ",")).alias("tile")).where(~blank(C("tile"))).select(F.trim("tile").alias("tile"))


@query("job_parameters", sql="SELECT * FROM (VALUES ('max_tiles', 12), ('stride', 512), ('margin', 128)) v(name, value)")
def job_parameters(t):
    """Parameters given as text: what is no number, or is not given, takes its default."""
    from atlasforge.functions.text import number_or

    given = t.spark.createDataFrame([("max_tiles", " 12 ", 99), ("stride", "wide", 512), ("margin", None, 128)], "name string, given string, standard int")
    return given.select("name", number_or(C("given"), C("standard")).alias("value"))


@query("force_2d", "line_points", "SELECT line_id, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy FROM line_points GROUP BY 1")
def force_2d(t):
    """Points with a height lose it; order and places stay."""
    pts = t.line_points.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), F.lit(7.0).alias("z")))).alias("pts"))
    flat = pts.select("line_id", F.transform("pts", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("pts"))
    total = lambda k: F.aggregate("pts", F.lit(0.0), lambda a, p: a + p[k])
    return flat.select("line_id", F.size("pts").cast("bigint").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query("union_pair_area", "pairs", "SELECT a_id, b_id, a_area + b_area - inter AS area FROM pairs")
def union_pair_area(t):
    """Area of the union of two boxes, by inclusion and exclusion."""
    return pairs_of(t).select("a_id", "b_id", (area("a_") + area("b_") - C("inter")).alias("area"))


@query("difference_area", "parcels candidates", """WITH px AS (SELECT p.id, x, unnest(range(p.y0, p.y1)) AS y FROM (SELECT *, unnest(range(x0, x1)) AS x FROM parcels) p), cv AS (SELECT DISTINCT parcel_id, x, unnest(range(y0, y1)) AS y FROM (SELECT parcel_id, y0, y1, unnest(range(x0, x1)) AS x FROM candidates))
SELECT id, count(*) - count(cv.x) AS left_area FROM px LEFT JOIN cv ON cv.parcel_id = px.id AND cv.x = px.x AND cv.y = px.y GROUP BY 1""")
def difference_area(t):
    """What is left of each parcel when the union of its candidates is cut away."""
    from atlasforge.operators.spatial import union_area

    cut = overlapping(t.parcels, t.candidates).where("a_id = b_parcel_id")
    hi, lo = (lambda c: F.greatest("a_" + c, "b_" + c).alias(c)), (lambda c: F.least("a_" + c, "b_" + c).alias(c))
    gone = union_area(cut.select(C("a_id").alias("id"), hi("x0"), hi("y0"), lo("x1"), lo("y1")), "id")
    return t.parcels.select("id", area().alias("a")).join(gone, "id", "left").select("id", (C("a") - F.coalesce("area", F.lit(0))).alias("left_area"))


@query("moving_average", "line_points", "SELECT line_id, pos, round_even(avg(y) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS pace FROM line_points")
def moving_average(t):
    """The mean of the last ten values."""
    w = W.partitionBy("line_id").orderBy("pos").rowsBetween(-9, 0)
    return t.line_points.select("line_id", "pos", rounded(F.avg("y").over(w)).alias("pace"))


@query("tile_arrays", "raster", "SELECT r // 64 AS tr, c // 64 AS tc, count(*) AS n, sum(gray) AS total, arg_min(gray, (r, c)) AS first FROM raster GROUP BY 1, 2")
def tile_arrays(t):
    """Named arrays of a tile, written as one Parquet row each and read again."""
    path = shared_path(t.spark, "tiles")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "gray"))), lambda p: p.gray)
    t.raster.groupBy(F.expr("r div 64").alias("tr"), F.expr("c div 64").alias("tc")).agg(ordered.alias("gray")).write.parquet(path)
    return t.spark.read.parquet(path).select("tr", "tc", F.size("gray").cast("bigint").alias("n"), F.aggregate("gray", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), C("gray")[0].alias("first"))


@query("neck_split")
def neck_split(t):
    """Dark components opened by three, so that necks part: size of each piece, grown back by one pixel
    within the dark. Pieces may share pixels there."""
    dark = t.raster.where("gray < 120").select("r", "c")
    m = t.raster.select("r", "c", (C("gray") < 120).cast("int").alias("m"))
    eroded = R.box_sums(m, {"s": C("m")}, 1).select("r", "c", (C("s") == C("__n")).cast("int").alias("e"))
    lab = R.components(R.box_window(eroded, "e", 1, F.max, "o").where("o = 1").select("r", "c"))
    shifts = F.array(*(F.struct((C("r") + a).alias("r"), (C("c") + b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    grown = lab.select("label", F.explode(shifts).alias("s")).select("label", "s.r", "s.c").distinct().join(dark, ["r", "c"])
    return grown.groupBy("label").agg(F.count("*").alias("px"))
