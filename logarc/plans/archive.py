"""Archive layouts: columnar, compact, row-major and inline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ARCHIVE_VERSION, COMPACT_MAX_ID, DICT_KIND
from ..functions.digests import big_endian, digest
from ..operators.decode import decode_encoded, decode_events, decode_row_major
from ..operators.dictionary import logtype_dictionary, lookup_ids, variable_dictionary
from ..operators.explode import explode_each
from ..operators.segments import in_segment, segment_logtypes, segment_variables, with_segments
from ..session import BROADCAST_BYTES, materialize


@dataclass
class Archive:
    """Events that refer to two dictionaries by id."""

    events: DataFrame
    logtypes: DataFrame
    variables: DataFrame
    compact: bool = False

    def decode(self, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        return decode_events(
            self.events, self.logtypes, self.variables, self.compact, broadcast_bytes=broadcast_bytes
        )


def attach_ids(
    encoded: DataFrame, logtypes: DataFrame, variables: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(source, seq, ts, logtype_id, vars)``: texts replaced by dictionary ids.

    Two events of one ``(source, seq)``, or a value that the dictionaries lack, raise an error.
    Events with a ``segment`` get the ids of their segment's dictionaries, and keep it.
    """
    own = [c for c in ("segment",) if c in encoded.columns]
    if own:
        texts = F.transform("vars", lambda v: v.withField("text", in_segment(F.col("segment"), v["text"])))
        encoded = encoded.withColumns({"vars": texts, "logtype": in_segment(F.col("segment"), F.col("logtype"))})
        logtypes, variables = (
            d.withColumn("digest", digest(in_segment(F.col("segment"), F.col("value")))) for d in (logtypes, variables)
        )
    # Dealt out by event once: what is found for an event's variables joins it where it lies.
    encoded = encoded.repartition("source", "seq")
    references = (
        explode_each(encoded, F.col("vars"), "source", "seq")
        .where(F.col("v.kind") == DICT_KIND)
        .select("source", "seq", "pos", F.col("v.text").alias("text"))
    )
    found = lookup_ids(references, variables, "text", "enc", F.xxhash64("source", "seq", "pos"), broadcast_bytes)
    # Group size is the number of variables of one event.
    per_event = found.groupBy("source", "seq").agg(F.collect_list(F.struct("pos", "enc")).alias("_found"))
    numeric = F.filter(
        F.transform("vars", lambda v, i: F.struct(i.alias("pos"), v["enc"].alias("enc"))),
        lambda p: p["enc"].isNotNull(),
    )
    found_ids = F.coalesce("_found", F.array().cast("array<struct<pos:int,enc:bigint>>"))
    due = F.size(F.filter("vars", lambda v: v["kind"] == DICT_KIND))
    whole = (F.size(found_ids) == due) & ~F.exists(found_ids, lambda p: p["enc"].isNull())
    lost = F.raise_error(F.lit("a dictionary entry is missing, or two events have one (source, seq)"))
    in_order = F.sort_array(F.concat(numeric, F.when(whole, found_ids).otherwise(lost.cast("array<struct<pos:int,enc:bigint>>"))))
    named = lookup_ids(encoded, logtypes, "logtype", "logtype_id", F.xxhash64("source", "seq"), broadcast_bytes)
    return named.join(per_event, ["source", "seq"], "left").select(
        "source", "seq", "ts", *own, "logtype_id", F.transform(in_order, lambda p: p["enc"]).alias("vars")
    )


def inline_form(encoded: DataFrame) -> DataFrame:
    """Encoded events without the text that decoding does not need."""
    slim = F.transform(
        "vars",
        lambda v: F.struct(
            v["kind"].alias("kind"), F.when(v["kind"] == DICT_KIND, v["text"]).alias("text"), v["enc"].alias("enc")
        ),
    )
    return encoded.withColumn("vars", slim)


def build_archive(
    encoded: DataFrame, compact: bool = False, broadcast_bytes: int = BROADCAST_BYTES, long_entries: bool = False
) -> Archive:
    """Columnar form of encoded events.

    The encoded events are written once and read three times: for each
    dictionary only its own column, and once for the ids. ``long_entries`` lets the compact form
    hold entries of over 65,535 bytes, which :func:`export_dictionary` cannot write.
    """
    return _with_dictionaries(inline_form(encoded), lambda df, name: materialize(df, name), compact, broadcast_bytes, long_entries)


def _with_dictionaries(encoded: DataFrame, keep, compact: bool, broadcast_bytes: int, long_entries: bool) -> Archive:
    """Ids of the whole archive, or in the compact form those of each segment."""
    if not compact:
        base = materialize(encoded, "encoded")
        logtypes = keep(logtype_dictionary(base), "logtypes")
        variables = keep(variable_dictionary(base), "variables")
        return Archive(attach_ids(base, logtypes, variables, broadcast_bytes), logtypes, variables)
    base = materialize(with_segments(encoded, broadcast_bytes=broadcast_bytes), "segmented")
    logtypes = keep(segment_logtypes(base, long_entries), "logtypes")
    variables = keep(segment_variables(base, long_entries), "variables")
    events = attach_ids(base, logtypes, variables, broadcast_bytes)
    return Archive(events.withColumn("vars", F.col("vars").cast("array<int>")), logtypes, variables, compact)


def write_archive(
    encoded: DataFrame,
    path: str,
    compact: bool = False,
    codec: str = "zstd",
    level: int = 3,
    by_date: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    long_entries: bool = False,
) -> Archive:
    """Write encoded events as a columnar Parquet archive and open it.

    Level 0 writes uncompressed files. The dictionaries are written first and
    joined from there; the ``info`` table comes last and marks the archive
    whole. Events are range partitioned by ``(source, seq)``, so a source that
    holds most events still spreads out. ``long_entries``: see :func:`build_archive`.
    """
    spark, options = encoded.sparkSession, codec_options(codec, level)

    def keep(df: DataFrame, name: str) -> DataFrame:
        return _keep_dictionary(df, f"{path}/{name}", options)

    archive = _with_dictionaries(inline_form(encoded), keep, compact, broadcast_bytes, long_entries)
    events, order = archive.events, ["source", "seq"]
    if by_date:
        events, order = events.withColumn("date", F.to_date("ts")), ["date", "source", "seq"]
    # The range sampling reads its input a second time, so the ids must not be joined again for it.
    events = materialize(events, "events")
    writer = events.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options)
    (writer.partitionBy("date") if by_date else writer).parquet(f"{path}/events")
    info = spark.range(1).select(F.lit(ARCHIVE_VERSION).alias("version"), F.lit(compact).alias("compact"))
    info.coalesce(1).write.parquet(f"{path}/info")
    return read_archive(spark, path)


def _keep_dictionary(df: DataFrame, path: str, options: dict[str, str]) -> DataFrame:
    """Write a dictionary without its digests, which follow from the values, and open it."""
    segmented = "segment" in df.columns
    df.select(*["segment"] * segmented, "id", "value", "n").write.options(**options).parquet(path)
    return read_dictionary(df.sparkSession, path, segmented)


def read_dictionary(spark: SparkSession, path: str, segmented: bool = False) -> DataFrame:
    """A stored dictionary; the digest of a value is made only where it is used."""
    own = ["segment"] * segmented
    rows = spark.read.schema(", ".join([*(f"{c} bigint" for c in own), "id bigint, value string, n bigint"])).parquet(path)
    return rows.select(*own, "id", digest(F.col("value")).alias("digest"), "value", "n")


def codec_options(codec: str = "zstd", level: int = 3) -> dict[str, str]:
    """Writer options for a codec and its level; level 0 means no compression."""
    if level == 0 or codec == "none":
        return {"compression": "uncompressed"}
    options = {"compression": codec}
    if codec == "zstd":
        options["parquet.compression.codec.zstd.level"] = str(level)
    return options


def read_archive(spark: SparkSession, path: str) -> Archive:
    """Open an archive written by :func:`write_archive`."""
    info = spark.read.parquet(f"{path}/info").first()
    if info.version != ARCHIVE_VERSION:
        raise ValueError(f"archive version {info.version} is not {ARCHIVE_VERSION}")
    events = spark.read.parquet(f"{path}/events")
    segmented = "segment" in events.columns
    dictionaries = [read_dictionary(spark, f"{path}/{name}", segmented) for name in ("logtypes", "variables")]
    return Archive(events, *dictionaries, info.compact)


def row_major(archive: Archive, id_bytes: int = 8) -> DataFrame:
    """``(source, seq, payload)``: time, logtype id and variables in one value. An event without a time raises."""
    var_bytes = 4 if archive.compact else 8
    logtype_id = F.col("logtype_id")
    if id_bytes < 8:
        limit = COMPACT_MAX_ID if id_bytes == 2 else (1 << (8 * id_bytes)) - 1
        logtype_id = F.when(logtype_id <= limit, logtype_id).otherwise(
            F.raise_error(F.lit(f"logtype id over {limit}")).cast("bigint")
        )
    no_time = F.raise_error(F.lit("row-major events need a time")).cast("bigint")
    time = F.coalesce(F.unix_millis("ts"), no_time)
    words = F.array_join(F.transform("vars", lambda v: big_endian(v, var_bytes)), "")
    payload = F.unhex(F.concat(big_endian(time), big_endian(logtype_id, id_bytes), words))
    own = [c for c in ("segment",) if c in archive.events.columns]
    return archive.events.select("source", "seq", *own, payload.alias("payload"))


def write_row_major(archive: Archive, path: str, codec: str = "zstd", level: int = 3, id_bytes: int = 8) -> None:
    """Write the row-major form with both dictionaries: payloads under ``events``."""
    spark, options = archive.events.sparkSession, codec_options(codec, level)
    for name in ("logtypes", "variables"):
        _keep_dictionary(getattr(archive, name), f"{path}/{name}", options)
    rows = row_major(archive, id_bytes)
    ordered = rows.repartitionByRange("source", "seq").sortWithinPartitions("source", "seq")
    ordered.write.options(**options).parquet(f"{path}/events")
    info = spark.range(1).select(
        F.lit(ARCHIVE_VERSION).alias("version"), F.lit(archive.compact).alias("compact"), F.lit(id_bytes).alias("id_bytes")
    )
    info.coalesce(1).write.parquet(f"{path}/info")


def read_row_major(spark: SparkSession, path: str) -> Archive:
    """Open a row-major archive; its events come back as columns, and ``decode`` gives their text."""
    info = spark.read.parquet(f"{path}/info").first()
    if info.version != ARCHIVE_VERSION:
        raise ValueError(f"archive version {info.version} is not {ARCHIVE_VERSION}")
    payloads = spark.read.parquet(f"{path}/events")
    segmented = "segment" in payloads.columns
    events = decode_row_major(payloads, info.id_bytes, 4 if info.compact else 8)
    return Archive(events, *[read_dictionary(spark, f"{path}/{name}", segmented) for name in ("logtypes", "variables")], info.compact)


def write_inline(encoded: DataFrame, path: str, codec: str = "zstd", level: int = 3, by_date: bool = False) -> None:
    """Write encoded events with their texts in place.

    Parquet's own dictionary pages hold each repeated text once, so this form
    needs no global ids: one narrow job to write, none of the joins to read.
    """
    rows = inline_form(encoded)
    writer = (rows.withColumn("date", F.to_date("ts")) if by_date else rows).write.options(**codec_options(codec, level))
    (writer.partitionBy("date") if by_date else writer).parquet(path)


def read_inline(spark: SparkSession, path: str, compact: bool = False) -> DataFrame:
    """Decoded events of an inline archive."""
    return decode_encoded(spark.read.parquet(path), compact)
