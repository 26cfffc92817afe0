"""Global numbering and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# monotonically_increasing_id() = partition number << 33 | row number in it.
_ROW_BITS = 33
_CHUNK_BITS = 16


def dense_ids(df: DataFrame, order_cols: list[str], id_col: str = "id", start: int | Column = 0) -> DataFrame:
    """Dense ids ``start, start+1, ...`` in the order of ``order_cols``.

    Rows are range partitioned and sorted, numbered inside their partition, and
    written once; the partition offsets come from one row per partition. The
    order must be total for ids to be the same in every run.
    """
    ranged = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    rows = materialize(ranged, "ordered")
    part = F.shiftright("_mid", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per range partition, so this window and this broadcast stay small.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    first = F.lit(start).cast("bigint") if isinstance(start, int) else start
    number = first + F.col("_offset") + F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_col, number)
        .drop("_part", "_mid", "_offset")
    )


def running_total(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str, per_key: DataFrame | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows of the same keys up to and including this one.

    ``seq`` is an integer, unique per key. Rows are summed in chunks of 65,536
    sequence numbers and the chunks in chunks again, so no window sorts more
    than one chunk of rows however many rows one key has. ``per_key`` (one row
    per key) adds its columns to every row; it is joined to the chunks, so a key
    with most of the rows does not gather them in one task.
    """
    chunked = df.withColumns(
        {"_v": value, "_c1": F.shiftright(seq, _CHUNK_BITS), "_c2": F.shiftright(seq, 2 * _CHUNK_BITS)}
    )
    small = chunked.groupBy(*keys, "_c2", "_c1").agg(F.sum("_v").alias("_s1"))
    large = small.groupBy(*keys, "_c2").agg(F.sum("_s1").alias("_s2"))

    def before(part: list[str], order: str):
        return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(column: str, part: list[str], order: str) -> Column:
        return F.coalesce(F.sum(column).over(before(part, order)), F.lit(0))

    large_base = large.select(*keys, "_c2", sum_before("_s2", keys, "_c2").alias("_b2"))
    small_base = small.join(large_base, [*keys, "_c2"]).select(
        *keys, "_c1", (F.col("_b2") + sum_before("_s1", [*keys, "_c2"], "_c1")).alias("_b1")
    )
    if per_key is not None:
        small_base = small_base.join(per_key, keys)
    inside = (
        Window.partitionBy(*keys, "_c1").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        chunked.join(small_base, [*keys, "_c1"])
        .withColumn(out, F.col("_b1") + F.sum("_v").over(inside))
        .drop("_v", "_c1", "_c2", "_b1")
    )
