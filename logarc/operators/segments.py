"""Segments: bounded stretches of events that have dictionaries of their own.

Ids of the compact form have 16 bits. They are dense per segment, and a segment is a
stretch of events in the order of ``(source, seq)`` with a bounded number of dictionary
variables, so they fit however large the archive is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COMPACT_MAX_ID, DICT_KIND, ENTRY_MAX_BYTES
from ..functions.digests import digest
from ..session import BROADCAST_BYTES, materialize
from .dictionary import first_seen
from .explode import explode_each

# Dictionary variables after which a new segment begins. Half of all ids, so that the event that crosses the mark fits too.
SEGMENT_VARIABLES = (COMPACT_MAX_ID + 1) // 2
_ID_BITS = 16
# monotonically_increasing_id() = partition number << 33 | row number in it; rows are added up by stretches of 1,024.
_ROW_BITS, _CHUNK_BITS = 33, 10


def wide_id(segment: Column, number: Column) -> Column:
    """One number for an id of a segment, unique in the archive."""
    return F.shiftleft(segment.cast("bigint"), _ID_BITS) + number.cast("bigint")


def in_segment(segment: Column, text: Column) -> Column:
    """A text that stands for this one in this segment."""
    return F.concat(segment.cast("string"), F.lit(":"), text)


def with_segments(encoded: DataFrame, variables: int = SEGMENT_VARIABLES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Encoded events, stored, with the number of their ``segment``.

    Events count as many as they have dictionary variables, at least one, and a segment ends
    with the event that fills it. Rows are stored, range partitioned and stored again. Their
    running total is made of narrow rows: in stretches of 1,024 rows, over the stretches of
    a partition, and over partitions. One row per stretch then tells where segments begin.
    """
    keys = ["source", "seq"]
    # The range sampling reads its input a second time, so what made it must not run again.
    encoded = materialize(encoded, "encoded")
    ranged = encoded.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    rows = materialize(ranged, "ordered-events").withColumn("_chunk", F.shiftright("_mid", _CHUNK_BITS))
    size = F.greatest(F.size(F.filter("vars", lambda v: v["kind"] == DICT_KIND)), F.lit(1)).cast("bigint")
    narrow = rows.select("_chunk", "_mid", size.alias("_size"))

    def before(part: str | None, order: str):
        window = Window.partitionBy(part) if part else Window.partitionBy(F.lit(0))
        return window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    part = F.shiftright("_chunk", _ROW_BITS - _CHUNK_BITS)
    chunks = materialize(narrow.groupBy("_chunk").agg(F.sum("_size").alias("_sum")).withColumn("_part", part), "stretches")
    # One row per range partition.
    parts = chunks.groupBy("_part").agg(F.sum("_sum").alias("_total"))
    parts = parts.select("_part", F.coalesce(F.sum("_total").over(before(None, "_part")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_sum").over(before("_part", "_chunk")), F.lit(0))
    starts = chunks.join(F.broadcast(parts), "_part").select("_chunk", (F.col("_base") + inside).alias("_start"))
    so_far = Window.partitionBy("_chunk").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("_start") + F.sum("_size").over(so_far)
    counted = narrow.join(starts, "_chunk").select("_chunk", "_mid", F.floor((total - 1) / variables).cast("bigint").alias("_segment"))
    firsts = counted.groupBy("_chunk", "_segment").agg(F.min("_mid").alias("_from"))
    marks = firsts.groupBy("_chunk").agg(F.sort_array(F.collect_list(F.struct("_segment", "_from"))).alias("_marks"))
    marks = materialize(marks, "segment-marks")
    # A stretch has few marks but for those of events that fill segments alone, which have a mark each.
    small = chunks.count() * 64 <= broadcast_bytes and marks.agg(F.coalesce(F.sum(F.size("_marks") * 16 + 32), F.lit(0)).alias("b")).first().b <= broadcast_bytes
    joined = rows.join(F.broadcast(marks) if small else marks, "_chunk")
    begun = F.filter("_marks", lambda m: m["_from"] <= F.col("_mid"))
    return joined.withColumn("segment", F.array_max(begun)["_segment"]).drop("_chunk", "_mid", "_marks")


def segment_dictionary(occurrences: DataFrame, name: str, long_entries: bool = False) -> DataFrame:
    """``(segment, id, digest, value, n)`` of occurrences ``(segment, value, first)``; ids by first occurrence in the segment.

    A segment that needs more ids than there are, which takes one event with more
    different variables than that, raises an error, and so does an entry of over 65,535 bytes
    unless ``long_entries`` are allowed: only the exported form has 16-bit lengths.
    """
    distinct = occurrences.groupBy("segment", "value").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    # A segment has a bounded number of entries, so this window is bounded too.
    number = F.row_number().over(Window.partitionBy("segment").orderBy("first", "value")) - 1
    many = F.raise_error(F.lit(f"{name}: more than {COMPACT_MAX_ID + 1} entries in one segment")).cast("int")
    long = F.raise_error(F.concat(F.lit(f"{name}: an entry is over {ENTRY_MAX_BYTES} bytes: "), F.left("value", F.lit(40)))).cast("int")
    fits = F.when(F.col("_number") > COMPACT_MAX_ID, many).otherwise(F.col("_number"))
    if not long_entries:
        fits = F.when(F.octet_length("value") > ENTRY_MAX_BYTES, long).otherwise(fits)
    return distinct.withColumn("_number", number).select(
        "segment", fits.cast("bigint").alias("id"), digest(F.col("value")).alias("digest"), "value", "n"
    )


def segment_logtypes(encoded: DataFrame, long_entries: bool = False) -> DataFrame:
    """Dictionary of the templates of each segment."""
    found = encoded.select("segment", F.col("logtype").alias("value"), first_seen(F.col("seq"), F.lit(0)).alias("first"))
    return segment_dictionary(found.where("value IS NOT NULL"), "logtypes", long_entries)


def segment_variables(encoded: DataFrame, long_entries: bool = False) -> DataFrame:
    """Dictionary of the variables of each segment."""
    found = explode_each(encoded, F.col("vars"), "segment", "seq").where(F.col("v.kind") == DICT_KIND)
    values = found.select("segment", F.col("v.text").alias("value"), first_seen(F.col("seq"), F.col("pos")).alias("first"))
    return segment_dictionary(values, "variables", long_entries)
