"""Value checks of kernels and of the queries that SQL does not express."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasforge.functions.crs import mercator_lat, mercator_lon, utm
from atlasforge.operators import shapes as S
from atlasforge.operators import tiles as T
from atlasforge.operators.greedy import keep_greedy
from atlasforge.operators.matching import block_scores, match, match_flags
from atlasforge.operators.raster import label_components
from atlasforge.operators.spatial import points_in, union_area
from atlasforge.plans.catalog import ORACLES, QUERIES
from atlasforge.plans.fixtures import Tables

DATA = "/root/testdata/sf0.001"


def boxes(spark, rows):
    return spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(rows)], "id long, x0 double, y0 double, x1 double, y1 double")


R1, R2 = (0, 0, 10, 10), (20, 0, 30, 10)


@pytest.mark.parametrize(("preds", "refs", "tp", "split", "merge", "oversize"), [
    ([R1, R2], [R1, R2], 2, 0, 0, 0),
    ([R1, R1, R2], [R1, R2], 2, 1, 0, 0),  # two lie in one
    ([(0, 0, 3.5, 10), (3.5, 0, 6.5, 10), (6.5, 0, 10, 10)], [R1, R2], 0, 1, 0, 0),
    ([(0, 0, 30, 10)], [R1, R2], 0, 0, 2, 2),
    ([], [R1, R2], 0, 0, 0, 0),
    ([(100, 100, 110, 110)], [R1, R2], 0, 0, 0, 0),
    ([(1, 1, 11, 11)], [R1], 1, 0, 0, 0),
])
def test_match_flags_on_known_shapes(spark, preds, refs, tp, split, merge, oversize):
    got = match_flags(boxes(spark, refs), boxes(spark, preds)).collect()
    assert len(got) == len(refs)
    assert [sum(bool(r[k]) for r in got) for k in ("matched", "split_flag", "merge_flag", "oversize_flag")] == [tp, split, merge, oversize]


def test_match_flags_take_the_assignment(spark):
    """Two predictions for one reference, one of which is the only one for another: the sum of IoU decides."""
    refs, preds = [(0, 0, 10, 10), (10, 0, 20, 10)], [(0, 0, 12, 10), (4, 0, 20, 10)]
    got = {r.id: (r.matched, r.pred) for r in match_flags(boxes(spark, refs), boxes(spark, preds)).collect()}
    assert got == {0: (True, 0), 1: (True, 1)}


def test_block_scores_refuse_bad_references(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 200, 200)], "block_id long, x0 long, y0 long, x1 long, y1 long")
    assert [tuple(r)[1:4] for r in block_scores(boxes(spark, [R1, R2]), boxes(spark, [R1]), blocks, 0.5).collect()] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        block_scores(boxes(spark, [R1, (5, 5, 5, 9)]), boxes(spark, [R1]), blocks, 0.5)


def test_points_with_nulls_and_repeats(spark):
    p = spark.createDataFrame([(1, None, 5, 5), (1, None, 5, 5), (2, "a", 500, 5)], "id long, note string, px long, py long")
    b = spark.createDataFrame([(7, 0, 0, 10, 10), (3, 0, 0, 20, 20)], "block_id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted((r.id, r.block_id) for r in points_in(p, b, "px", "py", "block_id").collect()) == [(1, 3), (1, 3), (2, -1)]


def test_union_area(spark):
    rnd = np.random.default_rng(3)
    rows = [(k % 5, int(x), int(y), int(x + w), int(y + h)) for k, (x, y, w, h) in enumerate(rnd.integers(0, 12, (60, 4)))]
    want = defaultdict(set)
    for g, a, b, c, d in rows:
        want[g] |= {(x, y) for x in range(a, c) for y in range(b, d)}
    got = {r.g: r.area for r in union_area(spark.createDataFrame(rows, "g long, x0 long, y0 long, x1 long, y1 long"), "g").collect()}
    assert got == {g: len(s) for g, s in want.items()}


def test_rings():
    square, ell = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    assert S.solidity(square) == 1 and S.solidity(ell) == pytest.approx(7 / 11.5)
    t = math.radians(30)
    turned = np.array([(0, 0), (6, 0), (6, 2), (0, 2)], float) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    _, long, short, angle = S.min_rect(turned)
    assert (long, short, angle) == (pytest.approx(6), pytest.approx(2), pytest.approx(30))
    assert S.simplify(np.array([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], float), 0.5).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    assert S.faults(square) is None and S.faults(square[[0, 2, 1, 3]]) in ("edges cross", "no area") and S.faults(square[:2]) == "too few points"
    assert S.normalized(np.roll(square[::-1], 2, axis=0)).tolist() == S.normalized(square).tolist()
    assert abs(S.signed_area(S.clip_convex(square, square + 2))) == 4 and len(S.clip_convex(square, square + 9)) == 0
    assert S.contains(ell, 0.5, 3) and not S.contains(ell, 3, 3)
    assert S.contains(ell, *S.interior_point(ell))
    ring, method = S.regularized(square)
    assert method == "rect" and abs(S.signed_area(ring)) == pytest.approx(16)


def test_tiles():
    rnd = np.random.default_rng(5)
    a = rnd.random((64, 64))
    dx, dy, response = T.phase_offset(a, np.roll(a, (3, 5), axis=(0, 1)))
    assert (round(dx), round(dy)) == (5, 3) and response > 0.05
    bar = np.zeros((9, 20), bool)
    bar[3:6, 2:18] = True
    thin = T.thin(bar)
    assert (thin <= bar).all() and thin[4, 4:15].all() and thin.sum(axis=0).max() == 1
    cross = np.zeros((9, 9), bool)
    cross[4, :] = cross[:, 4] = True
    assert sum(len(p) - 1 for p in T.trace(cross)) >= 16 and {(0, 4), (8, 4), (4, 0), (4, 8)} <= {q for p in T.trace(cross) for q in (p[0], p[-1])}
    k = np.ones((3, 3), bool)
    assert T.opened(bar, k).tolist() == bar.tolist() and not T.opened(thin, k).any()


def test_utm(spark):
    y = 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(40) / 2))
    x = 6378137.0 * math.radians(-75)
    e, n = spark.range(1).select(*(c.alias(k) for c, k in zip(utm(mercator_lon(F.lit(x)), mercator_lat(F.lit(y)), 18), "en"))).first()
    assert e == pytest.approx(500000, abs=1e-3) and n == pytest.approx(4427757.219, abs=0.01)  # the central meridian at 40 degrees


@pytest.fixture(scope="module")
def grid(spark):
    rows = Tables(spark, DATA).raster.collect()
    g = np.full((max(r.r for r in rows) + 1, max(r.c for r in rows) + 1), 255)
    for r in rows:
        g[r.r, r.c] = r.gray
    return g


def pixels(spark, name):
    return sorted((r.r, r.c) for r in QUERIES[name](spark, DATA).collect())


def test_masks_against_the_whole_raster(spark, grid):
    want = T.opened(grid < 150, T.oriented(15, 99.5)) | T.opened(grid < 150, T.oriented(11, 9.5))
    assert pixels(spark, "line_opening") == sorted(map(tuple, np.argwhere(want).tolist()))
    assert pixels(spark, "skeletonize") == sorted(map(tuple, np.argwhere(T.thin(grid < 110)).tolist()))
    h, w = (n // 4 for n in grid.shape)
    block = np.array([[grid[4 * r : 4 * r + 4, 4 * c : 4 * c + 4].max() for c in range(-(-grid.shape[1] // 4))] for r in range(-(-grid.shape[0] // 4))])
    lab = label_components(block < 120)
    edge = {int(k) for k in np.concatenate((lab[0], lab[-1], lab[:, 0], lab[:, -1])) if k}
    on = ~np.isin(lab, list(edge))
    plate = [(r, c) for r in range(2, on.shape[0] - 2) for c in range(2, on.shape[1] - 2) if on[r - 2 : r + 3, c - 2 : c + 3].all()]
    assert pixels(spark, "plate_mask") == plate


def test_components_against_the_whole_raster(spark, grid):
    k = np.ones((3, 3), bool)
    lab = label_components(T.opened(T.closed(grid < 120, k), k))
    want = sorted((int(r.min()), int(c.min()), int(r.max()), int(c.max()), len(r)) for r, c in (np.nonzero(lab == n) for n in np.unique(lab[lab > 0])) if len(r) >= 10)
    assert sorted(map(tuple, QUERIES["threshold_candidates"](spark, DATA).select("r0", "c0", "r1", "c1", "px").collect())) == want
    dark = label_components(grid < 60)
    want = set()
    for n in np.unique(dark[dark > 0]):
        part = np.pad(dark == n, 8)
        if 2 <= part.sum() < 60:
            ring = (T.dilate(part, T.ellipse(9)) & ~T.dilate(part, T.ellipse(3)))[8:-8, 8:-8]
            want.add((*divmod(int(n) - 1, grid.shape[1]), int(part.sum()), bool((grid[ring] < 110).mean() > 0.30)))
    assert {(r.r, r.c, r.px, r.embedded) for r in QUERIES["embedded_reject"](spark, DATA).collect()} == want
    open_ = label_components(T.opened(grid < 120, k))
    grown = sorted(int((T.dilate(open_ == n, k) & (grid < 120)).sum()) for n in np.unique(open_[open_ > 0]))
    assert sorted(r.px for r in QUERIES["neck_split"](spark, DATA).collect()) == grown


def test_suppression_is_greedy(spark):
    for name, groups, score, t in (("nms_masks", ["tile_no"], lambda r: r.id * 7919 % 10007, 0.5), ("findings_dedupe", ["tile_no", "category"], lambda r: (r.x1 - r.x0) * (r.y1 - r.y0), 0.35)):
        held = defaultdict(list)
        for r in Tables(spark, DATA).findings.where("NOT err").orderBy("id").collect():
            if name == "nms_masks" or r.category is not None:
                held[tuple(r[g] for g in groups)].append(r)
        want = set()
        for rows in held.values():
            keep = keep_greedy(np.array([(r.x0, r.y0, r.x1, r.y1) for r in rows], float), np.array([score(r) for r in rows], float), t)
            want |= {r.id for r, k in zip(rows, keep, strict=True) if k}
        assert {r.id for r in QUERIES[name](spark, DATA).collect()} == want


def test_sum_of_iou(spark):
    pairs = [(1, 1, 0.6), (1, 2, 0.55), (2, 1, 0.55), (3, 3, 0.4)]
    got = match(spark.createDataFrame(pairs, "pred long, ref long, iou double"), 0.5, most_pairs=False).collect()
    assert sorted((r.pred, r.ref) for r in got) == [(1, 2), (2, 1)]


#: What must hold for every row of a query without SQL.
HOLDS = {
    "mrr": "long >= short AND short >= 0 AND angle BETWEEN 0 AND 180", "solidity": "solidity BETWEEN 0 AND 1.000001", "simplify": "kept BETWEEN 2 AND n", "regularize": "method IN ('rect', 'ortho') AND area >= 0",
    "geom_validity": "n > 2", "geom_normalize": "length(digest) = 64", "boundary_dist_pooled": "dist BETWEEN 0 AND 20", "boundary_dist_sym": "dist BETWEEN 0 AND 20", "merc_to_utm18": "easting BETWEEN 500000 AND 700000 AND northing BETWEEN 4400000 AND 4600000",
    "file_hashes": "size > 0 AND length(sha256) = 64", "divider_split": "piece >= 1 AND px >= 8", "drawn_cells": "px >= 8 AND width >= 2", "evidence_bundle": "opened <= ink AND closed <= 1 AND hatch <= hatch_relaxed AND divider <= divider_relaxed",
    "registration_offset": "abs(dx) <= 32", "skeleton_lines": "n >= 1", "shape_measures": "solidity BETWEEN 0 AND 1.000001 AND long >= short", "match_sum_iou": "iou BETWEEN 0.5 AND 1",
    "ink_polygons": "area >= 5 AND holes >= 0 AND length(wkb) > 0", "vectorize_buildings": "confidence > 0 AND confidence <= 1 AND area > 0", "vectorize_roads": "length >= 15 AND size(points) >= 2",
}
CHECKED = {"line_opening", "skeletonize", "plate_mask", "threshold_candidates", "embedded_reject", "neck_split", "nms_masks", "findings_dedupe", "hatch_core"}


def test_every_query_without_sql_is_checked():
    assert set(QUERIES) - set(ORACLES) == set(HOLDS) | CHECKED


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_rows_hold(spark, name):
    df = QUERIES[name](spark, DATA)
    n = df.agg(F.count("*").alias("n"), F.count_if(F.expr(HOLDS[name])).alias("ok")).first()
    assert n.n == n.ok > 0
