"""Map-shaped tables derived from the driver's tables by integer arithmetic, and the same as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Tables:
    """The driver's tables and the derived ones by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def parcels(self) -> DataFrame:
        x0, y0 = "(p_partkey % 50) * 40", "(p_partkey div 50) * 40"
        return self.part.selectExpr("cast(p_partkey as bigint) id", f"cast({x0} as bigint) x0", f"cast({y0} as bigint) y0", f"cast({x0} + 8 + p_size % 24 as bigint) x1", f"cast({y0} + 8 + (p_size * 7) % 24 as bigint) y1")

    @cached_property
    def candidates(self) -> DataFrame:
        p = self.parcels.withColumnRenamed("id", "parcel_id")
        j = self.orders.where("o_orderkey % 4 <> 0").join(p, F.col("o_custkey") == F.col("parcel_id"))
        dx, dy = "(o_orderkey % 13 - 6)", "(o_orderkey % 11 - 5)"
        return j.selectExpr("cast(o_orderkey as bigint) id", "parcel_id", f"cast(x0 + {dx} as bigint) x0", f"cast(y0 + {dy} as bigint) y0", f"cast(x1 + {dx} + o_orderkey % 5 - 2 as bigint) x1", f"cast(y1 + {dy} + o_orderkey % 3 - 1 as bigint) y1", "o_orderpriority prio")

    @cached_property
    def blocks(self) -> DataFrame:
        x, y = "(s_suppkey % 10) * 200", "(s_suppkey div 10) * 200"
        return self.supplier.selectExpr("cast(s_suppkey as bigint) block_id", f"cast({x} as bigint) x0", f"cast({y} as bigint) y0", f"cast({x} + 200 as bigint) x1", f"cast({y} + 200 as bigint) y1")

    @cached_property
    def findings(self) -> DataFrame:
        bx, by = "(event_id * 37) % 640", "(event_id * 53) % 640"
        return self.events.selectExpr(
            "cast(event_id as bigint) id", "cast(user_id % 12 as bigint) tile_no",
            "CASE event_type WHEN 'view' THEN 'missing_feature' WHEN 'click' THEN 'false_positive' WHEN 'signup' THEN 'shape_mismatch' WHEN 'purchase' THEN 'missing_split' END category",
            "event_type = 'error' err", f"cast({bx} as bigint) x0", f"cast({by} as bigint) y0", f"cast({bx} + 4 + event_id % 61 as bigint) x1", f"cast({by} + 4 + event_id % 59 as bigint) y1",
            "CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END confidence",
        )

    @cached_property
    def line_points(self) -> DataFrame:
        pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
        x = F.expr("cast((unix_timestamp(cast(ts as timestamp)) - unix_timestamp(timestamp'2024-01-01 00:00:00')) div 600 as bigint)")
        return self.events.select(F.col("user_id").cast("bigint").alias("line_id"), pos.cast("bigint").alias("pos"), x.alias("x"), F.floor("value").cast("bigint").alias("y"))

    @cached_property
    def raster(self) -> DataFrame:
        pix = self.embeddings.select(F.col("vec_id").cast("bigint").alias("r"), F.posexplode("embedding").alias("c", "e"))
        return pix.selectExpr("r", "cast(c as bigint) c", "cast(floor(least(greatest((cast(e as double) + 0.55D) * 230D, 0D), 255D)) as bigint) gray")

    @cached_property
    def qa_flags(self) -> DataFrame:
        return self.labels.selectExpr("cast(doc_id as bigint) id", "quality = 1 on_plate", "toxic = 1 suspect")


VIEWS = {
    "parcels": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST((p_partkey % 50) * 40 AS BIGINT) AS x0, CAST((p_partkey // 50) * 40 AS BIGINT) AS y0, CAST((p_partkey % 50) * 40 + 8 + p_size % 24 AS BIGINT) AS x1, CAST((p_partkey // 50) * 40 + 8 + (p_size * 7) % 24 AS BIGINT) AS y1 FROM part",
    "candidates": "SELECT CAST(o_orderkey AS BIGINT) AS id, p.id AS parcel_id, CAST(x0 + o_orderkey % 13 - 6 AS BIGINT) AS x0, CAST(y0 + o_orderkey % 11 - 5 AS BIGINT) AS y0, CAST(x1 + o_orderkey % 13 - 6 + o_orderkey % 5 - 2 AS BIGINT) AS x1, CAST(y1 + o_orderkey % 11 - 5 + o_orderkey % 3 - 1 AS BIGINT) AS y1, o_orderpriority AS prio FROM orders JOIN parcels p ON o_custkey = p.id WHERE o_orderkey % 4 <> 0",
    "blocks": "SELECT CAST(s_suppkey AS BIGINT) AS block_id, CAST((s_suppkey % 10) * 200 AS BIGINT) AS x0, CAST((s_suppkey // 10) * 200 AS BIGINT) AS y0, CAST((s_suppkey % 10) * 200 + 200 AS BIGINT) AS x1, CAST((s_suppkey // 10) * 200 + 200 AS BIGINT) AS y1 FROM supplier",
    "findings": "SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id % 12 AS BIGINT) AS tile_no, CASE event_type WHEN 'view' THEN 'missing_feature' WHEN 'click' THEN 'false_positive' WHEN 'signup' THEN 'shape_mismatch' WHEN 'purchase' THEN 'missing_split' END AS category, event_type = 'error' AS err, CAST((event_id * 37) % 640 AS BIGINT) AS x0, CAST((event_id * 53) % 640 AS BIGINT) AS y0, CAST((event_id * 37) % 640 + 4 + event_id % 61 AS BIGINT) AS x1, CAST((event_id * 53) % 640 + 4 + event_id % 59 AS BIGINT) AS y1, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS confidence FROM events",
    "line_points": "SELECT CAST(user_id AS BIGINT) AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) // 600 AS x, CAST(floor(value) AS BIGINT) AS y FROM events",
    "raster": "SELECT CAST(vec_id AS BIGINT) AS r, CAST(c - 1 AS BIGINT) AS c, CAST(floor(least(greatest((CAST(embedding[c] AS DOUBLE) + 0.55) * 230, 0), 255)) AS BIGINT) AS gray FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS c FROM embeddings)",
    "qa_flags": "SELECT CAST(doc_id AS BIGINT) AS id, quality = 1 AS on_plate, toxic = 1 AS suspect FROM labels",
    "pairs": "SELECT p.id AS a_id, c.id AS b_id, (p.x1 - p.x0) * (p.y1 - p.y0) AS a_area, (c.x1 - c.x0) * (c.y1 - c.y0) AS b_area, (least(p.x1, c.x1) - greatest(p.x0, c.x0)) * (least(p.y1, c.y1) - greatest(p.y0, c.y0)) AS inter, c.prio FROM parcels p JOIN candidates c ON p.x0 < c.x1 AND c.x0 < p.x1 AND p.y0 < c.y1 AND c.y0 < p.y1",
}
_NEEDS = {"candidates": ["parcels"], "pairs": ["parcels", "candidates"]}


def with_views(body: str, *views: str) -> str:
    """The SQL with the derived tables that it reads in front."""
    order: list[str] = []
    for v in views:
        for n in [*_NEEDS.get(v, []), v]:
            if n not in order:
                order.append(n)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
