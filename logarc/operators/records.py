"""Record streams: events as tagged records, deduplicated per source and merged.

A record is ``(source, seq, pos, op, digest, literal, first, value, ts)``; ``ts`` is
the event's time, so that a stream of records can expire what it keeps. Per event
the order is variables, logtype, timestamp. ``first`` says that no earlier
record of the same source had this content.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    DEDUP_MODES,
    DICT_KIND,
    INT_KIND,
    OP_ENCODED32,
    OP_ENCODED64,
    OP_LOGTYPE,
    OP_TIMESTAMP,
    OP_VARIABLE,
)
from ..functions.digests import digest
from ..session import BROADCAST_BYTES, materialize
from .dictionary import first_seen, number_values
from .explode import explode_each
from .lookup import lookup

RECORD_KEY = ("source", "seq", "pos")
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("op", T.ByteType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("literal", T.StringType()),
        T.StructField("first", T.BooleanType()),
        T.StructField("value", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def to_records(encoded: DataFrame, compact: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed record rows of encoded events; every literal is present. Columns ``keep`` of the event come last."""
    encoded_op = OP_ENCODED32 if compact else OP_ENCODED64

    def record(op: Column | int, literal: Column, value: Column) -> Column:
        code = F.lit(op) if isinstance(op, int) else op
        return F.struct(
            code.cast("tinyint").alias("op"),
            literal.cast("string").alias("literal"),
            value.cast("bigint").alias("value"),
        )

    nothing = F.lit(None)
    of_variable = F.transform(
        "vars",
        lambda v: record(
            F.when(v["kind"] == DICT_KIND, F.lit(OP_VARIABLE)).otherwise(F.lit(encoded_op)),
            F.when(v["kind"] == DICT_KIND, v["text"]),
            v["enc"],
        ),
    )
    tail = F.array(
        record(OP_LOGTYPE, F.col("logtype"), nothing), record(OP_TIMESTAMP, nothing, F.unix_millis("ts"))
    )
    rows = explode_each(encoded, F.concat(of_variable, tail), "source", "seq", "ts", *keep, item="rec")
    return rows.select(
        *RECORD_KEY,
        "rec.op",
        digest(F.col("rec.literal")).alias("digest"),
        "rec.literal",
        F.lit(None).cast("boolean").alias("first"),
        "rec.value",
        "ts",
        *keep,
    )


def assembled_events(records: DataFrame) -> DataFrame:
    """Encoded events ``(source, seq, ts, logtype, vars)`` of records with their literals, and whether each is ``whole``.

    An event is whole if it has its timestamp record, a record for every place up to it,
    and a literal wherever one belongs. More records than places raise an error.
    """
    is_variable = ~F.col("op").isin(OP_LOGTYPE, OP_TIMESTAMP)
    part = F.struct(
        "pos",
        F.when(F.col("op") == OP_VARIABLE, F.lit(DICT_KIND)).otherwise(F.lit(INT_KIND)).cast("tinyint").alias("kind"),
        F.col("literal").alias("text"),
        F.col("value").alias("enc"),
    )
    lacks = F.col("op").isin(OP_LOGTYPE, OP_VARIABLE) & F.col("literal").isNull()
    events = records.groupBy("source", "seq").agg(
        F.timestamp_millis(F.max(F.when(F.col("op") == OP_TIMESTAMP, F.col("value")))).alias("ts"),
        F.max(F.when(F.col("op") == OP_LOGTYPE, F.col("literal"))).alias("logtype"),
        F.sort_array(F.collect_list(F.when(is_variable, part))).alias("parts"),
        F.max(F.when(F.col("op") == OP_TIMESTAMP, F.col("pos"))).alias("last"),
        F.count("*").alias("n"),
        F.count_if(lacks).alias("lacking"),
    )
    # Which of the two kinds of number a variable is only its template says; ids don't need to know.
    variables = F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"), p["enc"].alias("enc")))
    place = F.concat(F.col("source"), F.lit(" "), F.col("seq").cast("string"))
    many = F.raise_error(F.concat(F.lit("more records than places in the event "), place)).cast("boolean")
    whole = F.when(F.col("n") > F.col("last") + 1, many).otherwise((F.col("n") == F.col("last") + 1) & (F.col("lacking") == 0))
    return events.select("source", "seq", "ts", "logtype", variables.alias("vars"), F.coalesce(whole, F.lit(False)).alias("whole"))


def dedup_records(records: DataFrame, mode: str = "separate") -> DataFrame:
    """Send each content once per source.

    ``none``: literals always, no digest. ``shared`` / ``separate``: digest
    always, literal on first sight, with one set for both kinds or one per kind.
    ``marked``: literal always, ``first`` tells new from seen.

    The first place of each content is a minimum per content, combined before
    the shuffle; it is joined back on the record's own place, which is unique,
    so a content that fills a third of the stream stays spread out.
    """
    if mode not in DEDUP_MODES:
        raise ValueError(f"mode must be one of {DEDUP_MODES}, not {mode!r}")
    if mode == "none":
        return records.withColumns({"digest": F.lit(None).cast("binary"), "first": F.lit(None).cast("boolean")})
    kinds = [] if mode == "shared" else ["op"]
    place = first_seen(F.col("seq"), F.col("pos"))
    firsts = (
        records.where("digest is not null")
        .groupBy("source", *kinds, "digest")
        .agg(F.min(place).alias("place"))
        .select("source", "place", F.lit(True).alias("_first"))
    )
    seen = (
        records.withColumn("place", place)
        .join(firsts, ["source", "place"], "left")
        .withColumn("first", F.when(F.col("digest").isNotNull(), F.col("_first").isNotNull()))
        .drop("place", "_first")
    )
    return _as_sent(seen, mode).select(records.columns)


def ordered_records(records: DataFrame, mode: str = "separate", files: int | None = None) -> DataFrame:
    """:func:`dedup_records` in stream order: ranges of whole events, each sorted.

    The first places go into the range partitioning as rows of their own, which meet their records in
    the sorted range; so the stream is shuffled and sorted once, and a content in most records gathers nowhere.
    """
    order, count = ["source", "seq"], [] if files is None else [files]
    if mode not in DEDUP_MODES or mode == "none":
        stream = dedup_records(records, mode).repartitionByRange(*count, *order)
        return stream.sortWithinPartitions(*RECORD_KEY)
    marks = _first_places(records, mode).withColumn("_mark", F.lit(True))
    met = records.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    at_place = Window.partitionBy(*RECORD_KEY)
    ranged = met.repartitionByRange(*count, *order).withColumn("_first", F.max("_mark").over(at_place)).where("NOT _mark")
    seen = ranged.withColumn("first", F.when(F.col("digest").isNotNull(), F.col("_first")))
    return _as_sent(seen, mode).select(records.columns)


def _first_places(records: DataFrame, mode: str) -> DataFrame:
    """``(source, seq, pos)`` of the first record of each content, stored."""
    kinds = [] if mode == "shared" else ["op"]
    place = first_seen(F.col("seq"), F.col("pos"))
    firsts = materialize(
        records.where("digest is not null").groupBy("source", *kinds, "digest").agg(F.min(place).alias("place")).select("source", "place"),
        "first-places",
    )
    step = F.lit(1 << 31).cast("decimal(10,0)")
    seq = F.floor(F.col("place") / step)
    return firsts.select("source", seq.cast("bigint").alias("seq"), (F.col("place") - seq * step).cast("int").alias("pos"))


def ordered_event_records(encoded: DataFrame, mode: str = "separate", files: int | None = None, compact: bool = False) -> DataFrame:
    """:func:`ordered_records` of :func:`to_records` of encoded events, which are read two or three times: pass a written table.

    Events are shuffled and sorted whole, one row each with the places of its first contents, and
    are taken apart into records where they lie; so digests and copies of keys are never shuffled.
    """
    if mode not in DEDUP_MODES:
        raise ValueError(f"mode must be one of {DEDUP_MODES}, not {mode!r}")
    order, count = ["source", "seq"], [] if files is None else [files]
    if mode == "none":
        return dedup_records(to_records(encoded.repartitionByRange(*count, *order).sortWithinPartitions(*order), compact), mode)
    firsts = _first_places(to_records(encoded, compact), mode)
    # Group size is at most the number of records of one event.
    marks = firsts.groupBy(*order).agg(F.collect_list("pos").alias("_marks")).withColumn("_event", F.lit(False))
    met = encoded.withColumn("_event", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    of_event = F.first("_marks", ignorenulls=True).over(Window.partitionBy(*order))
    ranged = met.repartitionByRange(*count, *order).withColumn("_marks", of_event).where("_event")
    records = to_records(ranged, compact, keep=("_marks",))
    is_first = F.coalesce(F.array_contains("_marks", F.col("pos")), F.lit(False))
    seen = records.withColumn("first", F.when(F.col("literal").isNotNull(), is_first)).drop("_marks")
    return _as_sent(seen, mode)


def _as_sent(seen: DataFrame, mode: str) -> DataFrame:
    if mode == "marked":
        return seen.withColumn("digest", F.lit(None).cast("binary"))
    return seen.withColumn("literal", F.when(F.col("first"), F.col("literal")))


def record_marker(mode: str) -> Column:
    """Marker byte: operation in the high nibble, literal length class in the low one."""
    size = F.octet_length("literal")
    length_class = F.when(size <= 127, 1).when(size <= 32767, 2).otherwise(3)
    seen_offset = F.when(F.col("first"), 3).otherwise(0) if mode == "marked" else F.lit(0)
    return F.col("op") + F.when(F.col("literal").isNull(), 0).otherwise(length_class + seen_offset)


def record_size(mode: str) -> Column:
    """Bytes one record takes on the wire."""
    size = F.octet_length("literal").cast("bigint")
    length_bytes = F.when(size <= 127, 1).when(size <= 32767, 2).otherwise(4)
    literal = F.when(F.col("literal").isNull(), 0).otherwise(length_bytes + size)
    key = 32 if mode in ("shared", "separate") else 0
    return (
        F.when(F.col("op").isin(OP_TIMESTAMP, OP_ENCODED64), F.lit(9))
        .when(F.col("op") == OP_ENCODED32, F.lit(5))
        .otherwise(1 + key + literal)
        .cast("bigint")
    )


def record_bytes(records: DataFrame, mode: str, *keys: str) -> DataFrame:
    """Wire size of a record stream, in total or per key."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("records"), F.coalesce(F.sum(record_size(mode)), F.lit(0)).alias("bytes")
    )


def merge_sources(*streams: DataFrame) -> DataFrame:
    """One stream of the records of many sources."""
    return reduce(DataFrame.unionByName, streams)


def record_dictionaries(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(logtypes, variables)`` rebuilt from literals and references.

    A reference may name a literal that was sent as the other kind, so both
    dictionaries are resolved against the literals of both.
    """
    keyed = records.where(F.col("op").isin(OP_LOGTYPE, OP_VARIABLE)).withColumn(
        "digest", F.coalesce("digest", digest(F.col("literal")))
    )
    literals = keyed.where("literal is not null").groupBy("digest", "literal").agg(F.count("*").alias("_sent"))
    # A logtype counts from its event, wherever its record is, as in an archive made directly.
    place = F.when(F.col("op") == OP_LOGTYPE, 0).otherwise(F.col("pos"))
    uses = keyed.groupBy("op", "digest").agg(
        F.min(first_seen(F.col("seq"), place)).alias("first"), F.count("*").alias("n")
    )
    values = uses.join(literals, "digest", "left").select(
        "op", F.coalesce("literal", F.raise_error(F.lit("digest without a literal"))).alias("value"), "first", "n"
    )
    values = materialize(values, "record-values")

    def of(op: int) -> DataFrame:
        return number_values(values.where(F.col("op") == op).drop("op"))

    return of(OP_LOGTYPE), of(OP_VARIABLE)


def records_to_archive(records: DataFrame, broadcast_bytes: int = BROADCAST_BYTES):
    """``(events, logtypes, variables)`` of a record stream in any dedup mode."""
    logtypes, variables = record_dictionaries(records)
    logtypes, variables = materialize(logtypes, "logtypes"), materialize(variables, "variables")
    references = records.select(
        *RECORD_KEY,
        "op",
        "value",
        F.coalesce("digest", digest(F.col("literal"))).alias("_digest"),
    )
    # Records of numbers and times have no reference: they pass by the one look-up, which finds both kinds.
    entries = _by_kind(logtypes, OP_LOGTYPE).unionByName(_by_kind(variables, OP_VARIABLE))
    named = references.where("_digest IS NOT NULL").withColumn("_ref", _kind_key(F.col("op"), F.col("_digest")))
    found = lookup(named, entries, "_ref", "key", {"id": "_id"}, F.xxhash64(*RECORD_KEY), broadcast_bytes)
    plain = references.where("_digest IS NULL").withColumn("_id", F.lit(None).cast("bigint"))
    resolved = found.select(*plain.columns).unionByName(plain).withColumns(
        {
            "_logtype_id": F.when(F.col("op") == OP_LOGTYPE, F.col("_id")),
            "_variable_id": F.when(F.col("op") == OP_VARIABLE, F.col("_id")),
        }
    )
    place = F.struct("pos", F.coalesce("value", "_variable_id").alias("v"))
    is_variable = ~F.col("op").isin(OP_LOGTYPE, OP_TIMESTAMP)
    events = resolved.groupBy("source", "seq").agg(
        F.timestamp_millis(F.max(F.when(F.col("op") == OP_TIMESTAMP, F.col("value")))).alias("ts"),
        F.max("_logtype_id").alias("logtype_id"),
        F.transform(F.sort_array(F.collect_list(F.when(is_variable, place))), lambda p: p["v"]).alias("vars"),
    )
    return events, logtypes, variables


def _kind_key(op: Column, content: Column) -> Column:
    """Key of a content as one of the two kinds."""
    return F.concat(F.unhex(F.lpad(F.hex(op.cast("bigint")), 2, "0")), content)


def _by_kind(dictionary: DataFrame, op: int) -> DataFrame:
    return dictionary.select(_kind_key(F.lit(op), F.col("digest")).alias("key"), "id", "n")
