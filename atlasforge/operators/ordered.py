"""Order-dependent operators without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BANDS = 64


def row_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """1-based numbers in the order of a unique numeric key: rows are numbered within ranges, and each
    range starts after what the ranges before it hold. Only the ranges' counts reach the driver."""
    cuts = df.select(F.percentile_approx(key, F.array(*(F.lit(k / BANDS) for k in range(1, BANDS)))).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
    rows = df.withColumn("__band", band)
    before, start = 0, {}
    for r in sorted(rows.groupBy("__band").agg(F.count("*").alias("n")).collect(), key=lambda r: r[0]):
        start[r[0]], before = before, before + r[1]
    if not start:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    offset = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))[F.col("__band")]
    number = F.row_number().over(W.partitionBy("__band").orderBy(key)) + offset
    return rows.withColumn(name, number.cast("bigint")).drop("__band")


def banded(df: DataFrame, key: str, reach: int, expression, name: str, size: int = 4096) -> DataFrame:
    """A window over neighbours of consecutive integer keys: rows near a band's edge go to the band beyond
    it, too, and each row's value is kept from its own band. expression takes the ordered window."""
    own = F.floor(F.col(key) / size)
    bands = F.array_distinct(F.array(own, F.floor((F.col(key) - reach) / size), F.floor((F.col(key) + reach) / size)))
    rows = df.withColumn("__band", F.explode(bands)).withColumn("__own", own)
    return rows.withColumn(name, expression(W.partitionBy("__band").orderBy(key))).where("__band = __own").drop("__band", "__own")


def around(df: DataFrame, key: str, value: str, size: int = 4096) -> DataFrame:
    """Adds before, before_key, after, after_key: the nearest value that is not null at or before (at or
    after) each row in the order of a numeric key. Bands of keys are filled by themselves, then from the
    ends of the bands around; only those ends, two rows a band, meet in one order."""
    some = F.when(F.col(value).isNotNull(), F.struct(F.col(key).alias("k"), F.col(value).alias("v")))
    rows = df.withColumn("__band", F.floor(F.col(key) / size)).withColumn("__s", some)
    ends = rows.groupBy("__band").agg(F.max("__s").alias("__last"), F.min("__s").alias("__first"))
    order = W.orderBy("__band")
    carried = ends.select("__band", F.last("__last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("__last"), F.first("__first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("__first"))
    own = W.partitionBy("__band").orderBy(key)
    here = rows.withColumn("__b", F.last("__s", True).over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("__a", F.first("__s", True).over(own.rowsBetween(0, W.unboundedFollowing)))
    both = here.join(carried, "__band").withColumn("__b", F.coalesce("__b", "__last")).withColumn("__a", F.coalesce("__a", "__first"))
    return both.select(*df.columns, F.col("__b.v").alias("before"), F.col("__b.k").alias("before_key"), F.col("__a.v").alias("after"), F.col("__a.k").alias("after_key"))
