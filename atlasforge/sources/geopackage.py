"""GeoPackage layers as rows, by a Python data source over sqlite3, and a writer of several layers to one file."""

from __future__ import annotations

import os
import sqlite3
import struct

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def strip_header(blob: bytes) -> tuple[int, bytes]:
    """(srid, WKB) of a GeoPackage geometry."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    srid = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0]
    return srid, bytes(blob[8 + _ENVELOPE[flags >> 1 & 7] :])


def layers(path: str) -> list[str]:
    """Names of the feature layers; none if the file has no contents table."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        try:
            return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY 1")]
        except sqlite3.Error:
            return []


class GeoPackage(DataSource):
    """spark.read.format("gpkg").option("layer", ..).schema("id bigint, .., wkb binary").load(path); the
    file must be where every executor reads it. The geometry column comes as srid and wkb. A layer is read in
    ranges of its row ids, `rows` (1,000,000) ids each."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return "fid bigint, srid int, wkb binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.layer, self.names = options["path"], options["layer"], [f.name for f in schema]
        self.rows = int(options.get("rows", 1_000_000))

    def _open(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.layer)}").fetchone()
        return [_Range(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)] if low is not None else [_Range(0, -1)]

    def read(self, partition):
        with self._open() as db:
            geom = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.layer,)).fetchone()[0]
            plain = [n for n in self.names if n not in ("srid", "wkb")]
            columns = ", ".join(map(_quoted, [*plain, geom]))
            for row in db.execute(f"SELECT {columns} FROM {_quoted(self.layer)} WHERE rowid BETWEEN ? AND ?", partition.value):
                values = dict(zip(plain, row, strict=False))
                if row[-1] is not None:
                    values["srid"], values["wkb"] = strip_header(row[-1])
                yield tuple(values.get(n) for n in self.names)


#: SQLite types of Spark's; others are written as text.
_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "binary": "BLOB"}
#: "GPKG" as a number, by which a file is known.
_APPLICATION = 0x47504B47


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write_layers(layers: dict[str, DataFrame], path: str, srid: int) -> list[str]:
    """Writes rows with a column `wkb` as layers of one file and returns their names; a layer without rows is left
    out, a row without geometry stays. The format has one writer, so rows pass the driver a partition at a time.
    The file is made beside its place and moved there, so it is whole or absent; one that is there already is an error."""
    if os.path.exists(path):
        raise FileExistsError(path)
    part, written = f"{path}.part", []
    if os.path.exists(part):
        os.remove(part)
    db = sqlite3.connect(part)
    try:
        db.execute(f"PRAGMA application_id = {_APPLICATION}")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys(srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE gpkg_contents(table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns(table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
        head = b"GP\x00\x01" + struct.pack("<i", srid)
        for name, df in layers.items():
            fields = [(n, _TYPES.get(k, "TEXT")) for n, k in df.dtypes if n != "wkb"]
            db.execute(f"CREATE TABLE {_quoted(name)}({', '.join(f'{_quoted(n)} {k}' for n, k in fields)}, geom BLOB)")
            values = ", ".join("?" * (len(fields) + 1))
            rows = ((*(r[n] if k != "TEXT" or r[n] is None else str(r[n]) for n, k in fields), None if r["wkb"] is None else head + bytes(r["wkb"])) for r in df.toLocalIterator())
            if db.executemany(f"INSERT INTO {_quoted(name)} VALUES ({values})", rows).rowcount < 1:
                db.execute(f"DROP TABLE {_quoted(name)}")
                continue
            db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (name, name, srid))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, srid))
            written.append(name)
        db.commit()
    finally:
        db.close()
    os.rename(part, path)
    return written
