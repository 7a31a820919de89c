"""Exploding computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, values: Column, item: str, at: str | None = None) -> DataFrame:
    """Rows of an array column expression, with their position when `at` is named.

    A plain explode makes Spark add a size filter on the array below it, which computes an
    expensive array again. The outer form does not; its null row for an empty array is dropped
    by position.
    """
    name = at or "_at"
    rows = df.select(*keep, F.posexplode_outer(values).alias(name, item)).filter(F.col(name).isNotNull())
    return rows if at else rows.drop(name)
