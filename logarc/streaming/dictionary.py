"""Dictionaries that grow with a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.digests import digest
from ..operators.dictionary import distinct_values, number_values
from ..session import materialize
from .batches import run_batches
from .grown import GrownTable, prefixes

ENTRY_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.StringType())])
COUNT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])


def _entries(spark: SparkSession, path: str) -> GrownTable:
    return GrownTable(spark, f"{path}/entries", ENTRY_SCHEMA, digest(F.col("value")))


def _counts(spark: SparkSession, path: str) -> GrownTable:
    """Occurrences by batch and id; no batch reads them, they are only added up."""
    return GrownTable(spark, f"{path}/counts", COUNT_SCHEMA, None, lambda rows: rows.groupBy("id").agg(F.sum("n").alias("n")))


def read_stream_dictionary(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """Entries written so far, or by batches before a given one, with their occurrences in all of these."""
    entries, counts = _entries(spark, path), _counts(spark, path)
    totals = counts.read(counts.version(before_batch)).groupBy("id").agg(F.sum("n").alias("n"))
    rows = entries.read(entries.version(before_batch)).join(totals, "id")
    return rows.select("id", digest(F.col("value")).alias("digest"), "value", "n")


def upsert_batch(values: DataFrame, batch_id: int, path: str) -> DataFrame:
    """Add one micro-batch of occurrences ``(value, first)``; gives the batch's own entries.

    Only the buckets of the batch's values are read. New values get the ids after the last
    one, which the log holds. Ids follow from the batches before this one, so a replay
    writes the same table again.
    """
    spark = values.sparkSession
    entries, counts = _entries(spark, path), _counts(spark, path)
    before = entries.version(batch_id)
    counted = materialize(distinct_values(values).withColumn("digest", digest(F.col("value"))), "batch-values")
    wanted = prefixes(counted)
    known = entries.read(before, wanted).select(digest(F.col("value")).alias("digest"), "id")
    placed = counted.join(known, "digest", "left")
    if before.next_id:  # of a table without entries nothing is known, and the values are stored already
        placed = materialize(placed, "batch-known")
    fresh = number_values(placed.where("id IS NULL").drop("id"), before.next_id)
    added = placed.where("id IS NULL").count()
    entries.append(fresh.select("id", "value"), added, batch_id, before, before.next_id + added)
    own = placed.where("id IS NOT NULL").select("id", "digest", "value", "n").unionByName(fresh)
    counts.append(own.select("id", "n"), sum(wanted.values()), batch_id, counts.version(batch_id))
    return own


def stream_dictionary(occurrences: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the dictionary of a stream of ``(value, first)`` occurrences."""
    return run_batches(occurrences, checkpoint, lambda batch, batch_id: upsert_batch(batch, batch_id, path))
