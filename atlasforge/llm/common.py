"""Session helpers of the corpus operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one under the warehouse's
    parent only where the cluster names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").removeprefix("file:")
        named = os.path.join(os.path.dirname(os.path.abspath(warehouse)), "spark-checkpoints")
    return named


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    """How many parts hashed keys are dealt to: the session's shuffle width, which grows with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string")) % 5


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows that go to Python at once: ten thousand long texts would take much memory twice over.
    Called where an operator starts; a session that sets a smaller number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))
