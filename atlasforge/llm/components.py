"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasforge.llm.common import dropped, staged
from atlasforge.llm.textcore import lean


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of each one's component, by pointer jumping."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: at most one edge for each of its vertices a slice."""
    for batch in batches:
        if batch.num_rows:
            nodes, root = local_components(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            off = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(root[off])], names=["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every vertex of edges (u, v) of longs; a component is its smallest vertex.
    Alternates large and small stars, each a minimum by vertex and a join, until nothing changes;
    every round is a table in the shared folder."""
    schema = "u bigint, v bigint"
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(lean(_contract), schema).distinct(), name)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        following = staged(small, name)
        changed = following.exceptAll(now).limit(1).count()
        dropped(now)
        now = following
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
