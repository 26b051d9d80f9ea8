"""Greedy suppression in rounds of cells against the plain loop over a whole group."""

import numpy as np
import pytest

from atlasforge.operators import greedy
from atlasforge.operators.greedy import keep_greedy, suppress


def rows_of(seed, n, span):
    g = np.random.default_rng(seed)
    at, size = g.integers(-span, span, (n, 2)), g.integers(0, 60, (n, 2))
    return [(k, int(k % 2), int(x), int(y), int(x + w), int(y + h), int(s)) for k, ((x, y), (w, h), s) in enumerate(zip(at, size, g.integers(0, 40, n), strict=True))]


def plain(rows, threshold):
    stay = set()
    for tile in {r[1] for r in rows}:
        part = [r for r in rows if r[1] == tile]
        keep = keep_greedy(np.array([r[2:6] for r in part], float), np.array([r[6] for r in part], float), threshold)
        stay |= {r[0] for r, k in zip(part, keep, strict=True) if k}
    return stay


SCHEMA = "id long, tile long, x0 long, y0 long, x1 long, y1 long, score long"


@pytest.mark.parametrize("threshold, rounds", [(0.5, 16), (0.35, 16), (0.2, 16), (0.35, 1)])
def test_rounds_against_the_plain_loop(spark, monkeypatch, threshold, rounds):
    monkeypatch.setattr(greedy, "ROUNDS", rounds)
    rows = rows_of(8, 3000, 120)
    assert {r.id for r in suppress(spark.createDataFrame(rows, SCHEMA), ["tile"], threshold).collect()} == plain(rows, threshold)


def test_crowds_make_no_pairs(spark):
    """30,000 boxes on 8 by 8 places: their pairs would be some 200,000,000."""
    g = np.random.default_rng(2)
    rows = [(k, 0, int(x), int(y), int(x) + 40, int(y) + 40, int(s)) for k, ((x, y), s) in enumerate(zip(g.integers(0, 8, (30_000, 2)), g.integers(0, 10_000, 30_000), strict=True))]
    assert {r.id for r in suppress(spark.createDataFrame(rows, SCHEMA), ["tile"], 0.5).collect()} == plain(rows, 0.5)


def test_rows_without_a_group_or_a_box_stay(spark):
    rows = [(1, None, 0, 0, 9, 9, 5), (2, None, 0, 0, 9, 9, 4), (3, 0, 0, 0, 0, 9, 5), (4, 0, None, 0, 9, 9, 5), (5, 0, 0, 0, 9, 9, None), (6, 0, 0, 0, 9, 9, 1)]
    assert {r.id for r in suppress(spark.createDataFrame(rows, SCHEMA), ["tile"], 0.5).collect()} == {1, 2, 3, 4, 6}


def test_findings_larger_first_make_no_pairs(spark):
    """24,000 findings of a tile and category on 64 places: their pairs would be some 150,000,000."""
    from types import SimpleNamespace

    from atlasforge.plans.spatial import findings_dedupe

    g = np.random.default_rng(3)
    rows = [(k, 0, "a", False, int(x), int(y), int(x + w), int(y + h)) for k, ((x, y), (w, h)) in enumerate(zip(g.integers(0, 8, (24_000, 2)), g.integers(4, 60, (24_000, 2)), strict=True))]
    f = spark.createDataFrame(rows, "id long, tile_no long, category string, err boolean, x0 long, y0 long, x1 long, y1 long")
    want = plain([(r[0], 0, *r[4:], (r[6] - r[4]) * (r[7] - r[5])) for r in rows], 0.35)
    assert {r.id for r in findings_dedupe(SimpleNamespace(findings=f)).collect()} == want


def test_a_crowd_meets_few_boxes(monkeypatch):
    """Boxes are measured against those near them, not against all of a cell; the outcome is that of all pairs."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 600, (6000, 2)).astype(float)
    box = np.hstack((low, low + rng.integers(4, 60, (6000, 2))))
    box = box[np.argsort(-np.prod(box[:, 2:] - box[:, :2], axis=1), kind="stable")]
    own, measured, over = np.prod(box[:, :2] > 60, axis=1).astype(bool), [], greedy._over
    assert (greedy.hit(box[3000:], box[:3000], 0.35) == over(box[3000:], box[:3000], 0.35).any(axis=1)).all()
    monkeypatch.setattr(greedy, "_over", lambda a, b, t: (measured.append(len(a) * len(b)), over(a, b, t))[1])
    state = greedy.settle(box, own, box[:0], 0.35)
    assert sum(measured) < 0.3 * len(box) ** 2 / 2
    monkeypatch.setattr(greedy, "hit", lambda a, b, t: over(a, b, t).any(axis=1))
    assert (state == greedy.settle(box, own, box[:0], 0.35)).all() and set(state) == {greedy.GONE, greedy.STAYS, greedy.OPEN}
