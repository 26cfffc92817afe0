"""Places of rows inside their group, however many rows one group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, stored

# monotonically_increasing_id() = partition number << 33 | row number in it.
_ROW_BITS = 33


def places_in_groups(df: DataFrame, group: str, order: list[str], pos: str = "pos", size: str = "n") -> DataFrame:
    """The rows with their place 0, 1, ... in their ``group`` by ``order``, and the number of rows of the group.

    Rows are range partitioned by group and order, sorted and written once. A group may span
    many partitions: one row per group and partition holds the rows that come before, and the
    rows are joined with it on both, so a group with most rows meets in no single task.
    ``group`` must not be null, and ``order`` must end in a column that is different in every row.
    """
    keys = [group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    rows = stored(ranged, "ranged").withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    pieces = rows.groupBy(group, "_part").agg(F.min("_mid").alias("_first"), F.count("*").alias("_held"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.select(
        group,
        "_part",
        (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_held").over(of_group).alias(size),
    )
    joined = rows.join(hinted(stored(numbered, "pieces"), 96), [group, "_part"])
    return joined.withColumn(pos, F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")
