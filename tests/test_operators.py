"""Kernels against brute force, and documented shapes."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atlasforge.operators.distance import _envelope
from atlasforge.operators.greedy import keep_greedy
from atlasforge.operators.matching import assignment, match
from atlasforge.operators.raster import label_components
from atlasforge.operators.spatial import overlapping


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_cheapest(n, m, rnd):
    cost = np.array([[rnd.randint(-9, 9) for _ in range(m)] for _ in range(n)], float)
    got = sum(cost[i, j] for i, j in assignment(cost))
    a = cost if n <= m else cost.T
    want = min(sum(a[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(a.shape[1]), a.shape[0]))
    assert got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=30))
def test_distance_line(line):
    f = np.where(line, 0.0, np.inf)
    want = [min(((i - j) ** 2 for j, b in enumerate(line) if b), default=np.inf) for i in range(len(line))]
    assert _envelope(f).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=6, max_size=6), min_size=1, max_size=6), st.booleans())
def test_components_flood_fill(grid, eight):
    m = np.array(grid)
    got, seen = label_components(m, eight), {}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (eight or abs(a) + abs(b) == 1)]
    for r, c in zip(*np.nonzero(m), strict=True):
        if (r, c) in seen:
            continue
        stack, seen[(r, c)] = [(r, c)], (r, c)
        while stack:
            y, x = stack.pop()
            for a, b in steps:
                q = (y + a, x + b)
                if 0 <= q[0] < m.shape[0] and 0 <= q[1] < m.shape[1] and m[q] and q not in seen:
                    seen[q] = (r, c)
                    stack.append(q)
    kinds = {}
    for p, root in seen.items():
        assert kinds.setdefault(root, got[p]) == got[p] > 0
    assert len(set(kinds.values())) == len(kinds) and not got[~m].any()


def test_greedy_keeps_the_best():
    box = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [50, 50, 60, 60]], float)
    assert keep_greedy(box, np.array([1.0, 2.0, 0.5]), 0.5).tolist() == [False, True, True]


def shapes(spark, preds, refs):
    box = lambda rows: spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(rows)], "id long, x0 double, y0 double, x1 double, y1 double")
    p = overlapping(box(preds), box(refs))
    area = lambda s: f"(({s}_x1 - {s}_x0) * ({s}_y1 - {s}_y0))"
    return p.selectExpr("a_id pred", "b_id ref", f"inter / ({area('a')} + {area('b')} - inter) iou")


R1, R2 = (0, 0, 10, 10), (20, 0, 30, 10)


@pytest.mark.parametrize("preds, tp", [([R1, R2], 2), ([R1, R1, R2], 2), ([(0, 0, 3.5, 10), (3.5, 0, 6.5, 10), (6.5, 0, 10, 10)], 0), ([(0, 0, 30, 10)], 0), ([(100, 100, 110, 110)], 0)])
def test_scorer_shapes(spark, preds, tp):
    assert match(shapes(spark, preds, [R1, R2]), 0.5).count() == tp


def test_more_pairs_before_more_overlap(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6), (2, 1, 0.55)], "pred long, ref long, iou double")
    assert match(pairs, 0.5).count() == 2
    assert {(r.pred, r.ref) for r in match(pairs, 0.5, most_pairs=False).collect()} == {(1, 2), (2, 1)}


def test_edits_make_a_version(spark):
    from atlasforge.operators.edits import apply_edits

    layer = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id long, x long")
    out = apply_edits(layer, layer.where("id = 1"), spark.createDataFrame([(2, 60), (1, 50)], "id long, x long"), spark.createDataFrame([(9, 90)], "id long, x long"), "id", 4)
    assert sorted((r.id, r.x, r.action, r.version) for r in out.collect()) == [(2, 60, "reshaped", 4), (3, 7, "kept", 4), (9, 90, "added", 4)]


def test_wkb_polygon():
    import struct

    from atlasforge.sources.wkb import parse

    ring = struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    assert parse(struct.pack("<BIiI", 1, 3 | 0x20000000, 3857, 1) + ring) == (3, 3857, [[(0, 0), (1, 0), (1, 1), (0, 0)]])
