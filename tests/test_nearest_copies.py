"""Distances to the nearest segment where points and segments come many times."""

import math

import numpy as np

from atlasforge.functions.columns import segment_distance
from atlasforge.operators.spatial import nearest_segments


def test_copies_are_measured_once(spark):
    """All pairs of copies would be 900,000,000."""
    one = spark.range(30_000)
    points = one.selectExpr("id as k", "id % 2 as px", "3L as py")
    segments = one.selectExpr("0L as ax", "0L as ay", "40L as bx", "0L as by", "0L as s_x0", "0L as s_y0", "40L as s_x1", "0L as s_y1")
    got = nearest_segments(points, segments, 15, segment_distance, ["k"])
    assert got.groupBy("dist").count().collect() == [(3.0, 30_000)]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    p, s = rng.integers(-80, 80, (60, 2)).tolist(), rng.integers(-80, 80, (12, 4)).tolist() + [[7, 7, 7, 7], [15, 0, 15, 60]]
    points = spark.createDataFrame([(k, *x) for k, x in enumerate(p)], "k long, px long, py long")
    segments = spark.createDataFrame([(*x, min(x[0], x[2]), min(x[1], x[3]), max(x[0], x[2]), max(x[1], x[3])) for x in s], "ax long, ay long, bx long, by long, s_x0 long, s_y0 long, s_x1 long, s_y1 long")

    def gap(x, y, ax, ay, bx, by):
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size)) if size else 0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    want = {k: min(gap(*x, *y) for y in s) for k, x in enumerate(p)}
    got = {r.k: r.dist for r in nearest_segments(points, segments, 15, segment_distance, ["k"]).collect()}
    assert got.keys() == {k for k, d in want.items() if d <= 15} and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_metrics_of_lines_drawn_many_times(spark):
    """All pairs would be 400,000,000."""
    from types import SimpleNamespace

    from atlasforge.plans.spatial import line_metrics

    lines = spark.range(40_000).selectExpr("id as line_id", "explode(array(0L, 1L)) as pos").selectExpr("line_id", "pos", "pos * 40 as x", "line_id % 2 * 4 as y")
    assert line_metrics(SimpleNamespace(line_points=lines)).collect() == [(40_000, 0, 40_000, 40_000, 4.0, 4.0)]
