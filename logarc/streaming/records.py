"""Deduplication of literals in a record stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import materialize
from .batches import read_batches, run_batches, write_batch
from .grown import GrownTable, prefixes


def stream_literals(records: DataFrame, shared: bool = False, expiry: str | None = None, time: str = "ts") -> DataFrame:
    """Literals of a stream, each once per source.

    State is one row per ``(source, kind, digest)`` and is kept for ever, or for
    ``expiry`` of event time in column ``time``; a literal seen again after that
    is sent again. References need no state: they are all the other records. All
    records of one literal go to one state partition; where a literal may be in
    most records, use :func:`stream_new_literals`.
    """
    keys = ["source", "digest"] if shared else ["source", "op", "digest"]
    literals = records.where("literal is not null")
    if expiry is None:
        return literals.dropDuplicates(keys)
    return literals.withWatermark(time, expiry).dropDuplicatesWithinWatermark(keys)


LITERAL_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("op", T.ByteType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("literal", T.StringType()),
    ]
)


def read_sent_literals(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """Literals sent so far, or by batches before a given one."""
    return read_batches(spark, LITERAL_SCHEMA, path, before_batch)


def send_batch(records: DataFrame, batch_id: int, path: str) -> None:
    """Write the literals of a micro-batch that no batch before it has sent.

    The batch is reduced to distinct literals before its rows are shuffled, so
    one literal in most records does not load one task. A replay overwrites the
    folder of its batch with the same rows.
    """
    keys = ["source", "op", "digest"]
    sent = read_sent_literals(records.sparkSession, path, before_batch=batch_id).select(*keys)
    distinct = records.where("literal is not null").select(*keys, "literal").distinct()
    write_batch(distinct.join(sent, keys, "left_anti"), batch_id, path)


def stream_new_literals(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Literals of a stream, each once per source and kind, for skewed streams.

    Like :func:`stream_literals`, with the table of sent literals in place of
    operator state.
    """
    return run_batches(records, checkpoint, lambda batch, batch_id: send_batch(batch, batch_id, path))


LAST_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("op", T.ByteType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("last", T.LongType()),
    ]
)
SENT_SCHEMA = T.StructType([*LITERAL_SCHEMA.fields, T.StructField("ts", T.TimestampType())])


def send_expiring_batch(records: DataFrame, batch_id: int, path: str, expiry_ms: int) -> None:
    """Write the literals of a micro-batch that were not seen for longer than ``expiry_ms`` before.

    Occurrences are reduced to their first and last time in each stretch of that length, where
    no gap can be longer, before any row is shuffled; so a literal in most records loads
    no task, and the gaps between stretches are exact. The last time of each literal is found by
    digest in a growing table. Records without a time count as of the year 1970.
    """
    keys = ["source", "op", "digest"]
    spark = records.sparkSession
    time = F.coalesce(F.unix_millis("ts"), F.lit(0).cast("bigint"))
    # The literal is a key beside its digest: as an aggregate, a text would make all records be sorted before they combine.
    spans = (
        records.where("literal IS NOT NULL")
        .groupBy(*keys, "literal", F.floor(time / expiry_ms).alias("span"))
        .agg(F.min(time).alias("low"), F.max(time).alias("high"))
    )
    spans = materialize(spans, "spans")
    table = GrownTable(spark, f"{path}/last", LAST_SCHEMA, F.col("digest"), lambda rows: rows.groupBy(*keys).agg(F.max("last").alias("last")))
    before = table.version(batch_id)
    known = table.read(before, prefixes(spans)).groupBy(*keys).agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.greatest("last", F.max("high").over(earlier))
    seen = spans.join(known, keys, "left").withColumn("previous", previous)
    sent = seen.where(F.col("previous").isNull() | (F.col("low") - F.col("previous") > expiry_ms))
    write_batch(sent.select(*keys, "literal", F.timestamp_millis("low").alias("ts")), batch_id, f"{path}/sent")
    newest = materialize(spans.groupBy(*keys).agg(F.max("high").alias("last")), "newest")
    table.append(newest, newest.count(), batch_id, before)


def stream_expiring_literals(records: DataFrame, path: str, checkpoint: str, expiry_ms: int) -> StreamingQuery:
    """Literals of a stream, sent again when they come back after ``expiry_ms`` of event time without them."""
    return run_batches(records, checkpoint, lambda batch, batch_id: send_expiring_batch(batch, batch_id, path, expiry_ms))


def read_expiring_literals(spark: SparkSession, path: str) -> DataFrame:
    """``(source, op, digest, literal, ts)`` of all literals sent, with the time of the record that sent them."""
    return read_batches(spark, SENT_SCHEMA, f"{path}/sent")


def stream_references(records: DataFrame) -> DataFrame:
    """The record stream with digests in place of literals."""
    return records.withColumn("literal", F.lit(None).cast("string"))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table until present input is written."""
    return (
        df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )
