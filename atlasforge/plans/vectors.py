"""Queries that turn masks and lines into polygons, and layers of files."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from atlasforge.functions.columns import area, rounded
from atlasforge.operators import raster as R
from atlasforge.operators import vectorize as V
from atlasforge.operators.faces import faces
from atlasforge.plans.registry import query
from atlasforge.plans.relational import GROUND
from atlasforge.staging import shared_path

C = F.col


def _by_first_pixel(df, *columns):
    return df.select(F.expr(f"label div {1 << 31}").alias("r"), (C("label") % (1 << 31)).alias("c"), *columns)


@query("ink_polygons")
def ink_polygons(t):
    """Ink of at least five pixels as polygons with holes, by the first pixel of each; geometry as WKB."""
    lab = R.components(t.raster.where("gray < 120").select("r", "c"))
    return _by_first_pixel(V.outlines(lab).where("area >= 5"), "area", "corners", "holes", "wkb")


@query("vectorize_buildings")
def vectorize_buildings(t):
    """Building polygons of a raster of probabilities; the raster is dim, so the threshold is lower."""
    return _by_first_pixel(V.buildings(t.raster, threshold=100), rounded(C("area")).alias("area"), "holes", rounded(C("confidence")).alias("confidence"), "oversize", "wkb")


@query("vectorize_roads")
def vectorize_roads(t):
    """Road centre lines of a raster of probabilities; the raster is dim, so the threshold is lower."""
    return V.roads(t.raster, threshold=126).withColumns({"length": rounded(C("length")), "confidence": rounded(C("confidence"))})


@query("hatch_core")
def hatch_core(t):
    """For each finding the strictly hatched pieces of at least 20 pixels that lie mostly in its box grown by
    three: how many, and their pixels."""
    from atlasforge.plans.spatial import hatch_mask

    lab = R.components(hatch_mask(t).where("strict").select("r", "c"))
    a, u = C("x0") % 40, C("y0") % 480
    box = t.findings.where("NOT err AND category IS NOT NULL").select("id", (a - 3).alias("x0"), (u - 3).alias("y0"), (a + C("x1") - C("x0") + 3).alias("x1"), (u + C("y1") - C("y0") + 3).alias("y1"))
    return V.pieces_in(lab, box, 20, 0.5).groupBy("id").agg(F.count("*").alias("pieces"), F.sum("px").alias("px"))


@query("polygonize_blocks", "blocks", f"""SELECT x0, y0, x1, y1, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM (
SELECT CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y0 + 50 + block_id % 100 AS DOUBLE) AS y1 FROM blocks UNION ALL
SELECT x0, y0 + 50 + block_id % 100, x1, y1 FROM blocks) WHERE (x1 - x0) * (y1 - y0) * {GROUND * GROUND!r} > 8000""")
def polygonize_blocks(t):
    """Faces that block borders and a street through each block enclose, of more than 8,000 square metres on
    the ground; borders come twice, streets end on them, and a lane in each block leads nowhere."""
    b = t.blocks.withColumn("m", C("y0") + 50 + C("block_id") % 100)
    side = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    x0, y0, x1, y1, m = (C(k) for k in ("x0", "y0", "x1", "y1", "m"))
    every = F.array(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0), side(x0, m, x1, m), side(x0 + 60, m, x0 + 100, y0 + 20))
    lines = b.select(F.explode(every).alias("s")).select("s.*")
    return faces(lines, 8000 / GROUND**2).select("x0", "y0", "x1", "y1", "area")


@query("gpkg_round_trip", "parcels", "SELECT id, x0, y0, x1, y1, 3857 AS srid, CASE WHEN (x1 - x0) * (y1 - y0) > 400 THEN 'oversize' ELSE 'kept' END AS layer FROM parcels")
def gpkg_round_trip(t):
    """Parcels routed to two layers of a GeoPackage, one that stays empty left out, and all its layers read
    again. The shared folder must be mounted: SQLite reads no object store."""
    from atlasforge.sources.geopackage import GeoPackage, layers, write_layers
    from atlasforge.sources.wkb import box_polygons, polygon_bounds

    place = urlparse(shared_path(t.spark, "layers"))
    if place.scheme not in ("", "file"):
        raise ValueError("a GeoPackage needs a folder that is mounted everywhere")
    os.makedirs(os.path.dirname(place.path), exist_ok=True)
    path = place.path + ".gpkg"
    shape = lambda test: box_polygons(t.parcels.where(test).select("id", "x0", "y0", "x1", "y1"), None).withColumnRenamed("geom", "wkb")
    write_layers({"kept": shape(area() <= 400), "oversize": shape(area() > 400), "review": shape(F.lit(False))}, path, 3857)
    t.spark.dataSource.register(GeoPackage)
    out = None
    for name in layers(path):
        rows = t.spark.read.format("gpkg").option("layer", name).option("rows", 5000).schema("id bigint, srid int, wkb binary").load(path)
        bounds = polygon_bounds(rows.select("id", C("wkb").alias("geom"))).drop("srid")
        one = bounds.join(rows.select("id", "srid"), "id").withColumn("layer", F.lit(name))
        out = one if out is None else out.union(one)
    return out
