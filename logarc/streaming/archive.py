"""Archives that grow: events appended to the columnar form, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import first_seen, variable_occurrences
from ..operators.encode import encode
from ..operators.lookup import lookup
from ..operators.records import RECORD_SCHEMA, assembled_events
from ..plans.archive import Archive, attach_ids, inline_form
from ..session import BROADCAST_BYTES, materialize
from .batches import read_batches, run_batches, write_batch
from .dictionary import read_stream_dictionary, upsert_batch
from .grown import GrownTable, prefixes

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("logtype_id", T.LongType()),
        T.StructField("vars", T.ArrayType(T.LongType())),
    ]
)

LITERAL_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("literal", T.StringType())])
# Numbers of one stretch of the key index, so that a source with gaps has a range for each stretch it is in.
STRETCH_BITS = 16
PLACE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("stretch", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
    ]
)


def append_batch(encoded: DataFrame, batch_id: int, path: str, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Add one batch of encoded events to a growing archive.

    Places ``(source, seq)`` that the batch has twice or the archive has already raise an
    error before anything is written. Then both dictionaries grow, the events are
    written with their ids, and the ranges of their places join the key index. Each
    has a part per batch, which a replay overwrites.
    """
    base = materialize(inline_form(encoded), "batch")
    ranges = _place_ranges(base)
    _check_places(base, ranges, batch_id, path)
    templates = base.select(F.col("logtype").alias("value"), first_seen(F.col("seq"), F.lit(0)).alias("first"))
    logtypes = upsert_batch(templates, batch_id, f"{path}/logtypes")
    variables = upsert_batch(variable_occurrences(base), batch_id, f"{path}/variables")
    events = attach_ids(base, logtypes, variables, broadcast_bytes)
    write_batch(events.select(*EVENT_SCHEMA.fieldNames()), batch_id, f"{path}/events")
    write_batch(ranges, batch_id, f"{path}/places")


def _place_ranges(base: DataFrame) -> DataFrame:
    """First and last place of each source, per stretch of 65,536 numbers; a place taken twice raises an error."""
    stretch = F.shiftright("seq", STRETCH_BITS)
    own = base.groupBy("source", "seq").agg(F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("two events of the batch have the place "), F.col("source"), F.lit(" "), F.col("seq").cast("string")))
    single = own.select("source", F.when(F.col("n") == 1, F.col("seq")).otherwise(twice.cast("bigint")).alias("seq"))
    found = single.groupBy("source", stretch.alias("stretch")).agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    return materialize(found, "places")


def _check_places(base: DataFrame, ranges: DataFrame, batch_id: int, path: str) -> None:
    """Raise if the archive has an event at a place of the batch; only batches whose ranges meet the new ones are read."""
    spark = base.sparkSession
    old = read_batches(spark, PLACE_SCHEMA, f"{path}/places", before_batch=batch_id, keep_batch=True)
    new = ranges.select("source", "stretch", F.col("low").alias("_low"), F.col("high").alias("_high"))
    meets = old.join(new, ["source", "stretch"]).where("low <= _high AND high >= _low")
    batches = [r.batch for r in meets.select("batch").distinct().collect()]
    if not batches:
        return
    stored = read_batches(spark, EVENT_SCHEMA, f"{path}/events", keep_batch=True).where(F.col("batch").isin(batches))
    clash = stored.select("source", "seq").join(base.select("source", "seq"), ["source", "seq"], "left_semi").first()
    if clash is not None:
        raise ValueError(f"the archive already has an event at {clash.source!r}, {clash.seq}")


def append_archive(encoded: DataFrame, path: str) -> int:
    """Add a table of encoded events after all batches that a growing archive has; gives the batch's number."""
    spark = encoded.sparkSession
    last = read_batches(spark, EVENT_SCHEMA, f"{path}/events", keep_batch=True).agg(F.max("batch").alias("last")).first().last
    batch_id = 0 if last is None else last + 1
    append_batch(encoded, batch_id, path)
    return batch_id


def stream_archive(events: DataFrame, path: str, checkpoint: str, message: str = "msg", mode: str = "standard") -> StreamingQuery:
    """Encode a stream of ``(source, seq, ts, msg)`` into a growing columnar archive until present input is written."""
    return run_batches(encode(events, message, mode), checkpoint, lambda batch, batch_id: append_batch(batch, batch_id, path))


def serve_batch(records: DataFrame, batch_id: int, path: str, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Take in one micro-batch of records of any deduplication mode.

    Records wait under ``path/open`` until their event is whole: its timestamp record has
    come, which is its last, there are as many records as places up to it, and each
    reference has its literal. Literals that came with a digest are kept under
    ``path/literals`` and are found by digest, whichever kind they were sent as and
    whether they come before or after their references. Whole events go to the archive.
    """
    spark = records.sparkSession
    waiting = read_batches(spark, RECORD_SCHEMA, f"{path}/open", only_batch=batch_id - 1)
    arrived = materialize(records.select(*RECORD_SCHEMA.fieldNames()).unionByName(waiting), "records")
    literals = GrownTable(spark, f"{path}/literals", LITERAL_SCHEMA, F.col("digest"))
    before = literals.version(batch_id)
    named = arrived.where("digest IS NOT NULL").groupBy("digest").agg(F.max("literal").alias("sent"), F.count("*").alias("n"))
    named = materialize(named, "named")
    known = literals.read(before, prefixes(named))
    named = materialize(named.join(known, "digest", "left"), "literals")
    fresh = named.where("sent IS NOT NULL AND literal IS NULL").select("digest", F.col("sent").alias("literal"))
    literals.append(fresh, fresh.count(), batch_id, before)
    found = named.select("digest", F.coalesce("literal", "sent").alias("value"), "n").where("value IS NOT NULL")
    spread = F.xxhash64("source", "seq", "pos")
    filled = lookup(arrived, found, "digest", "digest", {"value": "_found"}, spread, broadcast_bytes)
    filled = filled.withColumn("literal", F.coalesce("literal", "_found")).drop("_found")
    events = materialize(assembled_events(filled), "events")
    append_batch(events.where("whole").drop("whole"), batch_id, path, broadcast_bytes)
    still = arrived.join(events.where("NOT whole").select("source", "seq"), ["source", "seq"], "left_semi")
    write_batch(still.select(*RECORD_SCHEMA.fieldNames()), batch_id, f"{path}/open")


def stream_records_archive(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Turn a stream of records, deduplicated in any mode, into a growing archive.

    Events may be cut anywhere between batches, and a reference may come before its
    literal (:func:`serve_batch`). What is not whole when the input ends stays in
    :func:`open_records` and is completed by a later run over the same checkpoint.
    """
    return run_batches(records, checkpoint, lambda batch, batch_id: serve_batch(batch, batch_id, path))


def open_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of events that aren't whole yet after the last batch."""
    literals = GrownTable(spark, f"{path}/literals", LITERAL_SCHEMA, F.col("digest"))
    last = max(literals.batches(), default=-1)
    return read_batches(spark, RECORD_SCHEMA, f"{path}/open", only_batch=last)


def read_stream_archive(spark: SparkSession, path: str) -> Archive:
    """All batches of a growing archive."""
    return Archive(
        read_batches(spark, EVENT_SCHEMA, f"{path}/events"),
        read_stream_dictionary(spark, f"{path}/logtypes"),
        read_stream_dictionary(spark, f"{path}/variables"),
    )
