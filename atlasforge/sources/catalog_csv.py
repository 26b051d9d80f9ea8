"""Delimited text decoded by a catalog of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only this text is null; an empty string is a value.
NULL_TEXT = "\\N"
_CASTS = {"integer": "bigint", "bigint": "bigint", "smallint": "bigint", "numeric": "double", "double": "double"}


def typed(value: Column, kind: str) -> Column:
    """A text cell as its catalog type: integers, numerics as double, booleans t and f, all else text."""
    v = F.when(value != NULL_TEXT, value)
    if kind in _CASTS:
        return v.try_cast(_CASTS[kind])
    if kind == "boolean":
        return F.when(v == "t", True).when(v == "f", False)
    if kind == "geometry":
        return F.unhex(v)
    return v


def decode(raw: DataFrame, catalog: list[tuple[str, str]]) -> DataFrame:
    """Casts text columns; the header must be the catalog's columns in its order."""
    if raw.columns != [c for c, _ in catalog]:
        raise ValueError(f"header {raw.columns} is not the catalog's {[c for c, _ in catalog]}")
    return raw.select(*(typed(F.col(c), kind).alias(c) for c, kind in catalog))


def read(spark: SparkSession, path: str, catalog: list[tuple[str, str]]) -> DataFrame:
    """A file with a header, all columns read as text and then decoded."""
    schema = ", ".join(f"`{c}` string" for c, _ in catalog)
    return decode(spark.read.schema(schema).csv(path, header=True, enforceSchema=False, nullValue="\x00", emptyValue="", quote='"', escape='"'), catalog)
