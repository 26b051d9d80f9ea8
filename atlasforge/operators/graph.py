"""Connected components by repeated minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasforge.staging import dropped, staged


#: So many distinct edges, counted in both directions, go through one task; more go in rounds.
ONE_TASK = 2_000_000
#: So many edges, about, that lie near each other are contracted in one task.
NEAR_TASK = 400_000


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # a root goes under a smaller one
        while (root[root] != root).any():
            root = root[root]


def _labelled(edges: DataFrame) -> DataFrame:
    """The labels of each partition's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if held:
            node, root = labels_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])

    return edges.mapInArrow(run, "node bigint, component bigint")


def connected_near(edges: DataFrame, *place: Column) -> DataFrame:
    """As `connected`, of edges (u, v) of numbers, none of them null, that lie at places. Edges near each other go through
    one task, in ranges of the places; only nodes that several ranges have are left for `connected`, so its graph is
    small where most edges have both their nodes in one range. The result doesn't depend on the places."""
    parts = 1 + edges.count() // NEAR_TASK
    if parts == 1:
        return connected(edges)
    local = staged(_labelled(edges.repartitionByRange(parts, *place).select("u", "v")), "graph-parts")
    several = local.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    seams = local.join(several, "node", "left_semi").select(F.col("node").alias("u"), F.col("component").alias("v"))
    roots = connected(seams).select(F.col("node").alias("label"), F.col("component").alias("root"))
    label = local.join(roots, F.col("component") == F.col("label"), "left")
    return label.select("node", F.coalesce("root", "component").alias("component")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v); the smallest node names a component. A round takes the minimum
    over neighbours and then over the node it names, so paths halve; each round is a table, so the
    plan does not grow. Up to `ONE_TASK` edges take one task and no rounds."""
    both = staged(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "graph-edges")
    if set(dict(both.dtypes).values()) == {"bigint"} and both.where("u IS NOT NULL AND v IS NOT NULL").count() == both.count() <= ONE_TASK:
        label = staged(_labelled(both.repartition(1)), "graph-labels")
        dropped(both)
        return label
    label = staged(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "graph-labels")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("m").alias("n")), "v").groupBy("u").agg(F.min("n").alias("n"))
        step = label.join(near, "u").select("u", "m", F.least("m", "n").alias("n"))
        far = label.select(F.col("u").alias("n"), F.col("m").alias("far"))
        jump = staged(step.join(far, "n", "left").select("u", "m", F.least("n", F.coalesce("far", "n")).alias("n")), "graph-labels")
        done = not jump.where("n <> m").limit(1).count()
        dropped(label)
        label = jump.select("u", F.col("n").alias("m"))
        if done:
            dropped(both)
            return label.select(F.col("u").alias("node"), F.col("m").alias("component"))
