"""Sources, sinks and streams on small files."""

import json
import sqlite3
import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from atlasforge.sources import catalog_csv, files, findings, geojson
from atlasforge.sources.geopackage import GeoPackage, layers
from atlasforge.streaming.incremental import replay_safe, windowed_counts


def test_catalog_csv_nulls(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,flag,val\n1,"",t,1.5\n2,\\N,f,\\N\n3,"a ""b""",\\N,x\n')
    catalog = [("id", "bigint"), ("name", "text"), ("flag", "boolean"), ("val", "numeric")]
    rows = [tuple(r) for r in catalog_csv.read(spark, str(tmp_path / "a.csv"), catalog).orderBy("id").collect()]
    assert rows == [(1, "", True, 1.5), (2, None, False, None), (3, 'a "b"', None, None)]
    with pytest.raises(ValueError):
        catalog_csv.decode(spark.createDataFrame([("1", "2")], "b string, a string"), [("a", "text"), ("b", "text")])


def test_findings_skip_bad_lines(spark, tmp_path):
    good = {"id": 1, "tile_no": 2, "findings": [{"category": "a", "bbox_px": [0, 0, 9, 9]}, {"category": "z", "bbox_px": [0, 0, 9, 9], "confidence": "high"}, {"category": "a", "bbox_px": [0, 0, 5, 9]}, {"category": "a", "bbox_px": [0, 0, 9]}]}
    (tmp_path / "f.jsonl").write_text("\n".join([json.dumps(good), "", "{bad", json.dumps({"id": 3, "error": "x", "findings": good["findings"]}), json.dumps({"id": 4})]))
    rows = findings.read(spark, str(tmp_path / "f.jsonl"), ["a"]).collect()
    assert [(r.id, r.category, r.confidence) for r in rows] == [(1, "a", "low")]


def test_geojson_boxes(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 7}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    assert [tuple(r) for r in geojson.boxes(geojson.read(spark, str(tmp_path / "g.geojson"), "id bigint"), "id").collect()] == [(7, 0, 0, 4, 3)]


def test_geopackage_layer(spark, tmp_path):
    path = str(tmp_path / "l.gpkg")
    wkb = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE gpkg_contents(table_name, data_type); CREATE TABLE gpkg_geometry_columns(table_name, column_name); CREATE TABLE core(fid INTEGER, name TEXT, geom BLOB); INSERT INTO gpkg_contents VALUES ('core', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('core', 'geom')")
        db.execute("INSERT INTO core VALUES (1, 'x', ?), (2, 'y', NULL)", (b"GP\x00\x01" + struct.pack("<i", 3857) + wkb,))
    assert layers(path) == ["core"]
    spark.dataSource.register(GeoPackage)
    rows = spark.read.format("gpkg").option("layer", "core").schema("fid bigint, name string, srid int, wkb binary").load(path).orderBy("fid").collect()
    assert [(r.fid, r.name, r.srid, r.wkb and bytes(r.wkb)) for r in rows] == [(1, "x", 3857, wkb), (2, "y", None, None)]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    files.write_once(df, str(tmp_path / "o"))
    with pytest.raises(AnalysisException):
        files.write_once(df, str(tmp_path / "o"))
    assert files.write_layers({"a": df, "b": df.where("id < 0")}, str(tmp_path / "l")) == ["a"]
    assert sorted(r.id for r in files.pending(df, df.where("id = 1"), "id").collect()) == [0, 2]
    assert files.file_hashes(spark, str(tmp_path / "o/*.parquet")).count() >= 1


def test_stream_is_replay_safe(spark, tmp_path):
    spark.createDataFrame([(1, "a", "2024-01-01 00:10:00"), (1, "a", "2024-01-01 00:10:00"), (2, "b", "2024-01-01 01:10:00")], "id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, event_type string, ts timestamp").parquet(str(tmp_path / "in"))
    for n in ("c1", "c2"):  # a second run from the start writes the same batch again
        q = replay_safe(stream, str(tmp_path / "out"), "id").option("checkpointLocation", str(tmp_path / n)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("w").collect()} == {("a", 2), ("b", 1)}
