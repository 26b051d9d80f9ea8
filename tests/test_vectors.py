"""Polygons, centre lines and faces against plain computations; GeoPackage files both ways."""

import math
import sqlite3

import numpy as np
import pytest

from atlasforge.operators import tiles as T
from atlasforge.operators import vectorize as V
from atlasforge.operators.faces import faces, noded
from atlasforge.operators.raster import components, label_components
from atlasforge.operators.shapes import signed_area
from atlasforge.sources.geopackage import GeoPackage, layers, write_layers
from atlasforge.sources.wkb import parse


def pixels(spark, grid, name="gray"):
    return spark.createDataFrame([(int(r), int(c), int(grid[r, c])) for r, c in np.ndindex(grid.shape)], f"r long, c long, {name} long")


def blobs(seed, shape=(48, 56)):
    """A smooth random raster."""
    g = np.random.default_rng(seed).normal(size=shape)
    f = np.fft.fftfreq(shape[0])[:, None] ** 2 + np.fft.fftfreq(shape[1])[None] ** 2
    s = np.fft.ifft2(np.fft.fft2(g) * np.exp(-f * 300)).real
    return np.clip(128 + 60 * s / s.std(), 0, 255).astype(int)


def holes_of(part):
    """Regions of 8 neighbours that a component encloses."""
    outside = label_components(np.pad(~part, 1, constant_values=True), True)
    return len(np.unique(outside[outside > 0])) - 1


def test_outlines_of_known_shapes():
    def rings(rows):
        g = np.array([[c == "#" for c in row] for row in rows])
        on = {(int(r), int(c)) for r, c in zip(*np.nonzero(g), strict=True)}
        sides = set()
        for r, c in on:
            for nr, nc, *s in ((r - 1, c, c, r, 1, 0), (r, c + 1, c + 1, r, 0, 1), (r + 1, c, c + 1, r + 1, -1, 0), (r, c - 1, c, r + 1, 0, -1)):
                if (nr, nc) not in on:
                    sides.add(tuple(s))
        return V.link(sides)

    assert [signed_area(g) for g in rings(["##", "##"])] == [4] and len(rings(["##", "##"])[0]) == 4
    assert sorted(signed_area(g) for g in rings(["###", "#.#", "###"])) == [-1, 9]
    assert sorted(signed_area(g) for g in rings(["####", "#.##", "##.#", "####"])) == [-2, 16]  # holes that touch are one ring
    assert sorted(signed_area(g) for g in rings([".#", "#."])) == [1, 1]  # pixels that only touch stay apart


def test_outlines_against_labels(spark):
    grid = np.where(np.random.default_rng(4).random((30, 30)) < 0.62, 10, 200)
    lab = components(pixels(spark, grid).where("gray < 60").select("r", "c"))
    got = {(r.label >> 31, r.label % (1 << 31)): r for r in V.outlines(lab).collect()}
    labels = label_components(grid < 60)
    kinds = np.unique(labels[labels > 0])
    assert len(got) == len(kinds)
    for k in kinds:
        row = got[divmod(int(k) - 1, 30)]
        assert row.area == (labels == k).sum() and row.holes == holes_of(labels == k)
        rings = parse(bytes(row.wkb))[2]
        assert len(rings) == row.holes + 1 and all(g[0] == g[-1] for g in rings)
        assert math.isclose(sum(signed_area(np.array(g[:-1])) for g in rings), row.area)


def smoothed(grid):
    k = np.exp(-(np.arange(-8, 9) ** 2) / 8)
    p = np.pad(grid.astype(float), 8, mode="reflect")
    p = np.apply_along_axis(lambda v: np.convolve(v, k / k.sum(), "valid"), 1, p)
    return np.apply_along_axis(lambda v: np.convolve(v, k / k.sum(), "valid"), 0, p)


def test_buildings(spark):
    grid = blobs(1)
    got = {(r.label >> 31, r.label % (1 << 31)): r for r in V.buildings(pixels(spark, grid), tolerance=0, oversize=60).collect()}
    labels = label_components(T.opened(grid >= 128, np.ones((3, 3), bool)))
    want = {divmod(int(k) - 1, 56): labels == k for k in np.unique(labels[labels > 0]) if (labels == k).sum() >= 15}
    assert want and set(got) == set(want)
    for k, part in want.items():
        assert got[k].area == part.sum() and got[k].oversize == (part.sum() > 60)
        assert got[k].confidence == pytest.approx(grid[part].mean() / 255)
    slim = {(r.label >> 31, r.label % (1 << 31)): r for r in V.buildings(pixels(spark, grid)).collect()}
    assert set(slim) == set(want) and sum(r.corners for r in slim.values()) < sum(r.corners for r in got.values())
    assert all(abs(slim[k].area - got[k].area) <= 0.25 * got[k].area for k in want)
    assert V.buildings(pixels(spark, grid * 0)).count() == 0


def test_roads(spark):
    grid = np.zeros((90, 110), int)
    grid[38:50, 5:105] = 220  # two streets
    grid[5:85, 60:72] = 180
    grid[2:6, 2:6] = 255  # too small
    got = V.roads(pixels(spark, grid)).collect()
    mask = smoothed(grid) >= 128
    k7, k5 = np.ones((7, 7), bool), np.ones((5, 5), bool)
    m = T.opened(T.closed(mask, k7), k5)
    labels = label_components(m, True)
    keep = np.isin(labels, [k for k in np.unique(labels[labels > 0]) if (labels == k).sum() >= 400])
    want = V.line_rows(keep, grid, 30, 15.0, 1.5)
    assert len(want) >= 4
    assert sorted((r.r, r.c, round(r.length, 6), len(r.points), round(r.confidence, 6)) for r in got) == sorted((f[0], f[1], round(n, 6), len(p), round(q, 6)) for f, p, n, q in want)
    assert V.roads(pixels(spark, grid * 0)).count() == 0


def test_spurs_go_and_junctions_stay():
    m = np.zeros((60, 90), bool)
    m[30, 5:85] = True
    m[25:30, 45] = True  # a spur of five pixels
    out = V.pruned(m, 30, 3)
    assert not out[25:29, 45].any() and out[30, 5:85].sum() >= 79
    assert not V.pruned(m[:, :30] & (np.arange(30) < 20), 30, 3).any()  # a short line has two free ends


def test_pieces_in_boxes(spark):
    rnd = np.random.default_rng(7)
    labelled = [(int(k), int(r), int(c)) for k in range(6) for r, c in {(int(a), int(b)) for a, b in rnd.integers(0, 150, (60, 2))}]
    boxes = [(k, int(x), int(y), int(x) + int(w), int(y) + int(h)) for k, (x, y, w, h) in enumerate(rnd.integers(0, 140, (40, 4)))]
    got = {(r.id, r.label, r.px) for r in V.pieces_in(spark.createDataFrame(labelled, "label long, r long, c long"), spark.createDataFrame(boxes, "id long, x0 long, y0 long, x1 long, y1 long"), 20, 0.3).collect()}
    want = set()
    for i, x0, y0, x1, y1 in boxes:
        for k in range(6):
            px = [(r, c) for lab, r, c in labelled if lab == k]
            if sum(y0 <= r < y1 and x0 <= c < x1 for r, c in px) > 0.3 * len(px):
                want.add((i, k, len(px)))
    assert got == want and want


def lines(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize(("rows", "areas"), [
    ([(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)], [100]),
    ([(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0), (-5, 5, 15, 5), (5, 5, 5, 8)], [50, 50]),  # free ends
    ([(0, 0, 10, 10), (0, 10, 10, 0), (0, 0, 10, 0), (10, 0, 10, 10), (0, 10, 10, 10), (0, 0, 0, 10)], [25, 25, 25, 25]),
    ([(0, 0, 300, 0), (300, 0, 300, 200), (100, 0, 500, 0), (0, 200, 300, 200), (0, 0, 0, 200), (0, 0, 0, 200), (7, 7, 7, 7)], [60000]),  # along each other, twice, a point
    ([(0, 0, 9, 0), (0, 5, 9, 5)], []),
    ([], []),
])
def test_faces_of_known_lines(spark, rows, areas):
    assert sorted(round(r.area, 6) for r in faces(lines(spark, rows)).collect()) == areas


def test_faces_obey_euler(spark):
    """Faces of random lines: sides - corners + parts, and together the area of each part's outline."""
    rnd = np.random.default_rng(11)
    rows = [tuple(map(float, r)) for r in rnd.integers(-100, 100, (25, 4))]
    df = lines(spark, rows)
    sides = {((r.px, r.py), (r.qx, r.qy)) for r in noded(df).collect()}
    root = {p: p for s in sides for p in s}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in sides:
        root[find(a)] = find(b)
    parts = len({find(p) for p in root})
    assert faces(df).count() == len(sides) - len(root) + parts


def test_geopackage_written_and_read(spark, tmp_path):
    path = str(tmp_path / "out.gpkg")
    rows = spark.createDataFrame([(1, 'a"b', 1.5, True, b"\x01\x02"), (2, None, None, None, None)], 'id long, "odd name" string, v double, ok boolean, wkb binary'.replace('"odd name"', "`odd name`"))
    assert write_layers({"core": rows, "empty": rows.where("id > 9")}, path, 3857) == ["core"] == layers(path)
    spark.dataSource.register(GeoPackage)
    back = spark.read.format("gpkg").option("layer", "core").option("rows", 1).schema("id bigint, `odd name` string, v double, srid int, wkb binary").load(path)
    assert back.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, 'a"b', 1.5, 3857, bytearray(b"\x01\x02")), (2, None, None, None, None)]
    with sqlite3.connect(path) as db:
        assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
    with pytest.raises(FileExistsError):
        write_layers({"core": rows}, path, 3857)
