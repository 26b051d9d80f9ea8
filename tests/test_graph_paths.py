"""Components in one task and in rounds give the same labels; long paths take few jobs."""

import numpy as np

from atlasforge.operators import graph
from atlasforge.operators.faces import faces


def parted(spark, edges):
    return {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "u long, v long")).collect()}


def test_one_task_against_rounds(spark, monkeypatch):
    edges = np.random.default_rng(6).integers(-50, 250, (140, 2)).tolist()
    one = parted(spark, edges)
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert one == parted(spark, edges)
    assert parted(spark, []) == {}


def test_a_long_path_needs_no_rounds(spark, monkeypatch):
    tables = []
    write = graph.staged
    monkeypatch.setattr(graph, "staged", lambda d, name: tables.append(name) or write(d, name))
    order = np.random.default_rng(7).permutation(5000).tolist()
    assert set(parted(spark, list(zip(order, order[1:], strict=False))).values()) == {0}
    assert len(tables) == 2


def test_parts_of_places_against_one_task(spark, monkeypatch):
    rng = np.random.default_rng(8)
    grid = [(r * 40 + c, r * 40 + c + k, r, c) for r in range(30) for c in range(40) for k in (1, 40) if rng.random() < 0.5]  # also round the edges
    edges = [(int(u) * 7919 % 10007 - 5000, int(v) * 7919 % 10007 - 5000, r, c) for u, v, r, c in grid]
    df = spark.createDataFrame(edges + edges[:9], "u long, v long, r long, c long")
    want = sorted(map(tuple, graph.connected(df.select("u", "v")).collect()))
    assert sorted(map(tuple, graph.connected_near(df, df.r, df.c).collect())) == want
    monkeypatch.setattr(graph, "NEAR_TASK", 100)
    assert sorted(map(tuple, graph.connected_near(df, df.r, df.c).collect())) == want
    assert sorted(map(tuple, graph.connected_near(df, df.u).collect())) == want  # places that say nothing


def test_a_street_grid_leaves_few_edges_over(spark, monkeypatch):
    """Faces of a grid, beyond what one task takes: only sides that two ranges share are left to join."""
    left = []
    solve = graph.connected
    monkeypatch.setattr(graph, "NEAR_TASK", 1000)
    monkeypatch.setattr(graph, "connected", lambda d: left.append(d.count()) or solve(d))
    n = 40
    rows = [(0.0, 5.0 * k, 5.0 * n, 5.0 * k) for k in range(n + 1)] + [(5.0 * k, 0.0, 5.0 * k, 5.0 * n) for k in range(n + 1)]
    found = faces(spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double"), cell=8).collect()
    assert len(found) == n * n and {r.area for r in found} == {25.0}
    assert 0 < sum(left) < 4000  # of more than 6,000 sides in two directions
