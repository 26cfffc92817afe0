"""Exploding of computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_each(df: DataFrame, array: Column, *keep: str, pos: str = "pos", item: str = "v") -> DataFrame:
    """Columns ``keep`` with one row per element of a computed array.

    A plain explode makes the optimizer add a filter on the size of the array
    and push it to the scan, where the array is computed once more. The outer
    form does not; the rows of empty arrays are dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())
