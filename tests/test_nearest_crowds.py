"""Distances to the nearest segment where unlike places and segments are many, and the kernel against all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlasforge.functions.columns import segment_distance
from atlasforge.operators import nearest as N
from atlasforge.operators.spatial import nearest_segments


def gaps(x, y, ends):
    ax, ay, bx, by = ends
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = np.clip(((x[:, None] - ax) * dx + (y[:, None] - ay) * dy) / np.where(size, size, 1), 0, 1)
    return np.hypot(x[:, None] - ax - t * dx, y[:, None] - ay - t * dy)


@pytest.mark.parametrize("chunk", [7, 1 << 19])
@pytest.mark.parametrize("seed", range(12))
def test_kernel_against_all_pairs(seed, chunk, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", chunk)
    rng = np.random.default_rng(seed)
    p, m = int(rng.integers(1, 60)), int(rng.integers(1, 40))
    x, y = rng.uniform(0, 120, (2, p)) if seed % 2 else rng.integers(0, 120, (2, p)).astype(float)
    reach = (150, 30, 4000)[seed % 3]  # long, short, far beyond the tile
    ends = rng.integers(-reach, 120 + reach, (4, m)).astype(float)
    ends[2, : m // 4] = ends[0, : m // 4]  # upright ones
    ends[3, m // 8 : m // 2] = ends[1, m // 8 : m // 2]  # level ones and points
    d, best = gaps(x, y, ends), N.nearest([x, y], list(ends), 15, 120)
    want = d.min(axis=1)
    for k in np.flatnonzero(want <= 15).tolist():
        assert best[k] >= 0 and d[k, best[k]] <= want[k] + 1e-9


def test_exactly_at_the_radius():
    x, y = np.array([0.0, 119.0, 60.0]), np.array([15.0, 104.0, 0.0])
    ends = [np.array([v]) for v in (-500.0, 0.0, 500.0, 0.0)]
    assert N.nearest([x, y], ends, 15, 120).tolist()[::2] == [0, 0]
    assert N.nearest([x, y], [np.array([119.0]), np.array([119.0]), np.array([119.0]), np.array([900.0])], 15, 120)[1] == 0


def test_unlike_lines_in_a_crowd(spark):
    """A cell of 15 has about 310 places and 50,000 segments: by cells, some 10^9 pairs are measured."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 120, (2, 20_000)).round(3)
    ends = np.stack((np.full(100_000, -1000.0), rng.uniform(-50, 170, 100_000).round(3), np.full(100_000, 1120.0), rng.uniform(-50, 170, 100_000).round(3)))
    points = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(x)), "px": x, "py": y}))
    names = ["ax", "ay", "bx", "by", "s_x0", "s_y0", "s_x1", "s_y1"]
    segments = spark.createDataFrame(pd.DataFrame(dict(zip(names, (*ends, ends[0], np.minimum(ends[1], ends[3]), ends[2], np.maximum(ends[1], ends[3])), strict=True))))
    got = {r.k: r.dist for r in nearest_segments(points, segments, 15, segment_distance, ["k"]).collect()}
    assert len(got) == len(x)
    some = rng.choice(len(x), 40, replace=False)
    want = gaps(x[some], y[some], ends).min(axis=1)
    assert all(abs(got[k] - w) < 1e-9 for k, w in zip(some.tolist(), want.tolist(), strict=True))


def test_few_distances_are_measured_by_spark(spark):
    """All pairs of the cell are 400 * 2,000; a distance a segment and tile, and one a place, are enough."""
    rng, count = np.random.default_rng(4), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def distance(px, py, ax, ay, bx, by):
        count.add(1)
        dx, dy = bx - ax, by - ay
        t = min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    x, y = rng.uniform(0, 15, (2, 400))
    ends = np.stack((np.full(2_000, -5.0), rng.uniform(-5, 20, 2_000), np.full(2_000, 20.0), rng.uniform(-5, 20, 2_000)))
    points = spark.createDataFrame([(k, *v) for k, v in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "k long, px double, py double")
    segments = spark.createDataFrame([(*v, v[0], min(v[1], v[3]), v[2], max(v[1], v[3])) for v in ends.T.tolist()], ", ".join(f"{c} double" for c in ("ax", "ay", "bx", "by", "s_x0", "s_y0", "s_x1", "s_y1")))
    got = {r.k: r.dist for r in nearest_segments(points, segments, 15, distance, ["k"]).collect()}
    want = gaps(x, y, ends).min(axis=1)
    assert len(got) == 400 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert count.value <= 40_000
