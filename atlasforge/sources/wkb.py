"""WKB and EWKB at the edges: points and boxes of polygons decoded from bytes by Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

_SRID, _Z, _M = 0x20000000, 0x80000000, 0x40000000


def parse(wkb: bytes) -> tuple[int, int | None, list]:
    """(type, srid, coordinates): points, lines, polygons as rings, and their multi forms as parts."""
    order = "<" if wkb[0] == 1 else ">"
    kind = struct.unpack_from(order + "I", wkb, 1)[0]
    at, srid = 5, None
    if kind & _SRID:
        srid = struct.unpack_from(order + "i", wkb, at)[0]
        at += 4
    width = 2 + bool(kind & _Z) + bool(kind & _M)
    base = kind & 0xFF

    def points(n: int, at: int) -> tuple[list, int]:
        flat = struct.unpack_from(f"{order}{n * width}d", wkb, at)
        return [(flat[k * width], flat[k * width + 1]) for k in range(n)], at + 8 * n * width

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", wkb, at)[0], at + 4

    if base == 1:
        return base, srid, points(1, at)[0]
    if base == 2:
        return base, srid, points(*count(at))[0]
    if base == 3:
        n, at = count(at)
        rings = []
        for _ in range(n):
            k, at = count(at)
            ring, at = points(k, at)
            rings.append(ring)
        return base, srid, rings
    n, at = count(at)
    parts = []
    for _ in range(n):
        part = parse(wkb[at:])
        parts.append(part[2])
        at += _length(wkb, at)
    return base, srid, parts


def _length(wkb: bytes, start: int) -> int:
    order = "<" if wkb[start] == 1 else ">"
    kind = struct.unpack_from(order + "I", wkb, start + 1)[0]
    at = start + 5 + 4 * bool(kind & _SRID)
    width = 8 * (2 + bool(kind & _Z) + bool(kind & _M))
    base = kind & 0xFF
    if base == 1:
        return at + width - start
    n = struct.unpack_from(order + "I", wkb, at)[0]
    at += 4
    if base == 2:
        return at + n * width - start
    for _ in range(n):
        if base == 3:
            at += 4 + struct.unpack_from(order + "I", wkb, at)[0] * width
        else:
            at += _length(wkb, at)
    return at - start


def _column(kind: str, pick, cast: str):
    """A column function made when it is first used, as it needs a session."""

    def call(column):
        def values(wkb: pd.Series) -> pd.Series:
            return wkb.map(lambda b: None if b is None else pick(parse(bytes(b)))).astype(cast)

        values.__annotations__ = {"wkb": pd.Series, "return": pd.Series}
        return pandas_udf(values, kind)(column)

    return call


point_x = _column("double", lambda g: g[2][0][0], "float64")
point_y = _column("double", lambda g: g[2][0][1], "float64")
srid = _column("int", lambda g: g[1], "Int32")


def polygon(rings: list[list[tuple[float, float]]], srid: int | None = None) -> bytes:
    """Rings as WKB, or as extended WKB with a reference system."""
    head = struct.pack("<BI", 1, 3 | (_SRID if srid is not None else 0)) + (struct.pack("<i", srid) if srid is not None else b"")
    body = b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *(v for p in r for v in p)) for r in rings)
    return head + struct.pack("<I", len(rings)) + body


def box_polygons(boxes: DataFrame, srid: int) -> DataFrame:
    """(id, geom) of boxes (id, x0, y0, x1, y1)."""

    def run(batches):
        for pdf in batches:
            geom = [polygon([[(a, b), (c, b), (c, d), (a, d), (a, b)]], srid) for a, b, c, d in zip(pdf["x0"], pdf["y0"], pdf["x1"], pdf["y1"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "geom": geom})

    return boxes.mapInPandas(run, "id bigint, geom binary")


def polygon_bounds(rows: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1, srid) of polygons (id, geom)."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, g in zip(pdf["id"], pdf["geom"], strict=True):
                _, srid, rings = parse(bytes(g))
                xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
                out.append((k, int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys)), srid))
            yield pd.DataFrame(out, columns=["id", "x0", "y0", "x1", "y1", "srid"])

    return rows.mapInPandas(run, "id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, srid int")
