"""Text rules of attribute comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_text(c: Column) -> Column:
    """Trimmed; spellings of null are null, an integer written as a float loses its zeros."""
    v = F.trim(c)
    v = F.when(~F.lower(v).isin("", "\\n", "null", "none", "nan"), v)
    return F.regexp_replace(v, r"^(-?[0-9]+)\.0+$", "$1")


def number_or(c: Column, standard: Column) -> Column:
    """A whole number given as text, or the standard value where there is none."""
    return F.coalesce(F.trim(c).try_cast("int"), standard)
