"""Shares in windows by tables of sums against each window by itself."""

import numpy as np
import pytest

from atlasforge.operators import tiles as T
from atlasforge.operators import windows


def plain(pixels, box):
    """As windows are defined: the bounds of the pixels inside, what isn't there without marks."""
    r0, r1, c0, c1 = box
    held = [(r, c, v) for r, c, v in pixels if r0 <= r <= r1 and c0 <= c <= c1]
    if not held:
        return None
    r, c, v = np.array(held).T
    g = np.zeros((np.ptp(r) + 1, np.ptp(c) + 1), int)
    g[r - r.min(), c - c.min()] = v
    if g.size < 4:
        return None
    m = {k: g & bit > 0 for k, bit in windows.BITS.items()}
    k = np.ones((3, 3), bool)
    m |= {"closed": T.closed(m["ink"], k), "opened": T.opened(m["ink"], k)}
    return tuple(m[name].mean() for name in windows.SHARES)


@pytest.mark.parametrize("missing", [0.0, 0.7, 0.98])
def test_windows_against_each_by_itself(spark, monkeypatch, missing):
    monkeypatch.setattr(windows, "BLOCK", 8)
    monkeypatch.setattr(windows, "WINDOWS", 150)
    rng = np.random.default_rng(5)
    pixels = [(r, c, int(rng.integers(0, 16) * 2 + (rng.random() < 0.6))) for r in range(-10, 30) for c in range(21) if rng.random() >= missing]
    low, size = rng.integers(-16, 34, (400, 2)), rng.integers(-1, 30, (400, 2)) // rng.integers(1, 8, (400, 1))
    boxes = {k: (int(a), int(a + h), int(b), int(b + w)) for k, ((a, b), (h, w)) in enumerate(zip(low, size, strict=True))}
    rows = [(k, *b) for k, b in boxes.items()] + [(7, *boxes[7]), (900, None, None, 1, 2)]
    df = windows.window_shares(spark.createDataFrame(pixels, "r long, c long, v long"), spark.createDataFrame(rows, "id long, r0 long, r1 long, c0 long, c1 long"))
    got = df.collect()
    assert {r.id: tuple(r)[1:] for r in got} == {k: p for k, b in boxes.items() if (p := plain(pixels, b))}
    assert len(got) == len({r.id for r in got}) > 10


def test_a_window_costs_no_row_a_pixel(spark):
    """No finding is exploded to the rows of its window, so it goes through the plan's shuffles once."""
    import __spark_entry__

    def generated(node):
        """The columns of each node that makes several rows of one."""
        below = [c for k in range(node.children().size()) for c in generated(node.children().apply(k))]
        return below + ([node.output().mkString(" ")] if node.nodeName() == "Generate" else [])

    plan = __spark_entry__.queries()["evidence_bundle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    found = generated(plan)
    assert found and not [c for c in found if c.startswith("id#") or " id#" in c]
