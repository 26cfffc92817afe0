"""The registered queries: each operator run over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, tokens
from ..functions.digests import digest
from ..functions.layout import render_layout, strip_layout_timestamp
from ..operators.decode import decode_encoded, render_timestamp
from ..operators.dictionary import (
    dictionary_bytes,
    distinct_values,
    export_dictionary,
    logtype_dictionary,
    lookup_ids,
    upsert_dictionary,
    variable_dictionary,
    variable_occurrences,
)
from ..operators.encode import count_kinds, encode, filter_level, with_error_policy
from ..operators.explode import explode_each
from ..operators.ordering import running_total
from ..operators.records import (
    dedup_records,
    merge_sources,
    record_bytes,
    record_marker,
    records_to_archive,
    to_records,
)
from ..operators.segments import segment_variables, with_segments
from ..operators.report import ir_compressed_report, ir_size_report, logtype_stats
from ..operators.stitch import split_timestamp, stitch_events, strip_trailing
from ..session import materialize, scratch_path
from ..sources.logs import parse_lines_fixed, parse_logs
from ..sources.records import read_records, stream_records, write_event_records, write_records
from ..sources.synthetic import synthetic_columns, synthetic_logs
from ..sources.text_sinks import read_text, read_zstd_column, rolling_files, write_rolling_text, write_text, write_zstd_column
from ..streaming.archive import append_archive, read_stream_archive, stream_archive, stream_records_archive
from ..streaming.dictionary import read_stream_dictionary, stream_dictionary
from ..streaming.ingest import stream_encode, stream_logs
from ..streaming.observe import batch_rates, observed
from ..streaming.records import (
    read_expiring_literals,
    read_sent_literals,
    stream_expiring_literals,
    stream_literals,
    stream_new_literals,
    write_stream,
)
from ..streaming.rolling import read_rolled, stream_rolling_text
from ..streaming.stitch import read_stitched, stream_lines, stream_stitch
from .archive import (
    build_archive,
    inline_form,
    read_archive,
    read_inline,
    read_row_major,
    row_major,
    write_archive,
    write_inline,
    write_row_major,
)
from .formats import compare_all_formats
from .tables import event_logs, log_file_lines, messages, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _hex(name: str, out: str | None = None) -> Column:
    return F.lower(F.hex(name)).alias(out or name)


def _joined(name: str) -> Column:
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


# --- sources -----------------------------------------------------------------


def stitch_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines, eight to a split, put together again as multi-line events."""
    docs = read_table(spark, folder, "documents")
    text = F.concat(F.lit("24/01/01 00:00:00 "), F.col("text"))
    lines = explode_each(docs, F.split(text, "\n"), "source", "doc_id", item="value").select(
        F.col("source").alias("file_path"),
        (F.col("doc_id") * 1_000_000 + F.floor(F.col("pos") / 8)).cast("bigint").alias("block"),
        F.col("pos").cast("bigint").alias("mid"),
        "value",
    )
    return stitch_events(lines).select("source", "seq", F.sha2("value", 256).alias("text_digest"))


def _log_folder(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "logs")
    write_text(log_file_lines(read_table(spark, folder, "events")), path)
    return path


def _parsed(df: DataFrame) -> DataFrame:
    return df.select(F.unix_millis("ts").alias("ts_ms"), "msg")


def parse_log_files(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(parse_logs(spark, _log_folder(spark, folder)))


def parse_whole_log_files(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(parse_logs(spark, _log_folder(spark, folder), whole_files=True))


def parse_logs_unstripped(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(parse_logs(spark, _log_folder(spark, folder), strip=False))


def parse_fixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(parse_lines_fixed(spark, _log_folder(spark, folder)))


def split_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    lines = log_file_lines(read_table(spark, folder, "events")).withColumnRenamed("line", "value")
    return split_timestamp(lines).select("seq", F.unix_millis("ts").alias("ts_ms"), strip_trailing(F.col("msg")).alias("msg"))


def synthetic_log_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The operator's first messages, as many as there are events, joined to them."""
    events = read_table(spark, folder, "events").select("event_id")
    made = synthetic_logs(spark, events.count())
    return events.join(made, F.col("event_id") == F.col("id")).select("event_id", "msg")


def synthetic_column_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("event_id")
    made = synthetic_columns(spark, events.count(), 4)
    return events.join(made, F.col("event_id") == F.col("ts")).select("ts", "logtype", _joined("vars"))


# --- sinks -------------------------------------------------------------------


def _text_round_trip(codec: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, f"text-{codec}")
        write_text(log_file_lines(read_table(spark, folder, "events")), path, codec)
        return read_text(spark, path).select(F.col("value").alias("line"))

    return query


def zstd_column_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "zstd-column")
    write_zstd_column(log_file_lines(read_table(spark, folder, "events")), path)
    return read_zstd_column(spark, path).select(F.col("value").alias("line"))


def _event_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = render_timestamp(messages(spark, folder, "events"), "yy/MM/dd HH:mm:ss ")
    return lines.select("source", "seq", "line")


def rolled_file_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_files(_event_lines(spark, folder), max_bytes=20_000).select("source", "seq", "file_no")


def rolling_text_newest(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "rolling")
    write_rolling_text(_event_lines(spark, folder), path, max_bytes=10_000, max_files=10)
    return spark.read.text(path).select("source", _long("file_no"), F.col("value").alias("line"))


def running_bytes(spark: SparkSession, folder: str) -> DataFrame:
    docs = messages(spark, folder, "documents")
    total = running_total(docs, ["source"], "seq", F.octet_length("msg").cast("bigint"), "total_bytes")
    return total.select("seq", "total_bytes")


# --- tokens ------------------------------------------------------------------


def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = messages(spark, folder, "documents").withColumn("t", tokens.tokenize(F.col("msg")))
    return found.select(
        "seq", F.size("t").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_digest")
    )


def _variables_of(table: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = messages(spark, folder, table)
        found = explode_each(rows, tokens.variables(F.col("msg")), "source", "seq", item="token")
        return found.select("source", "seq", _long("pos"), "token")

    return query


def _token_rows(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Every token with the character in front of it."""
    delimited = F.concat(F.lit("\n"), F.col("msg"))
    found = F.regexp_extract_all(delimited, F.lit(tokens.DELIMITED_TOKEN_REGEX), F.lit(0))
    rows = explode_each(messages(spark, folder, table), found, "seq", item="pair")
    return rows.select("seq", F.left("pair", F.lit(1)).alias("before"), F.substr("pair", F.lit(2)).alias("token"))


def hex_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _token_rows(spark, folder, "documents")
    hexes = rows.where(tokens.is_hex_token(F.col("token")))
    return hexes.groupBy("token").agg(F.count("*").alias("n"))


def eq_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens behind an equals sign that are variables for no other reason."""
    rows = _token_rows(spark, folder, "events").where("before = '=' AND NOT token RLIKE '[0-9]'")
    rows = rows.where(~tokens.is_hex_token(F.col("token")) & tokens.is_variable_token(F.col("token"), F.col("before")))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def variable_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _token_rows(spark, folder, "pages")
    kept = rows.where(tokens.is_variable_token(F.col("token"), F.col("before")))
    return kept.groupBy("seq").agg(F.count("*").alias("n_variables"))


def _classified(mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = explode_each(messages(spark, folder, "pages"), tokens.variables(F.col("msg")), "seq", item="token")
        return rows.select("seq", "token", tokens.classify_variable(F.col("token"), mode).cast("bigint").alias("kind"))

    return query


def _logtypes_of(table: str, mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = messages(spark, folder, table)
        return rows.select("source", "seq", tokens.logtype(F.col("msg"), mode).alias("logtype"))

    return query


def _encoded_variables(table: str, mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = encode(messages(spark, folder, table), mode=mode)
        return explode_each(rows, F.col("vars"), "source", "seq").select(
            "source", "seq", _long("pos"), F.col("v.kind").cast("bigint").alias("kind"), "v.text", "v.enc"
        )

    return query


def template_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per template, with variables per kind."""
    return count_kinds(encode(messages(spark, folder, "documents")), "logtype")


def number_token(kind: str) -> Column:
    """Number-like tokens of a line item: signs and zero padding vary by line."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("")
    pad = F.when(F.col("l_linenumber") % 3 == 0, "0").otherwise("")
    # Products of whole numbers as decimals: beyond 64 bits they are numbers that don't fit, at any size of the table.
    product = F.col("l_orderkey").cast("decimal(38,0)") * F.col("l_partkey") * F.col("l_suppkey")
    whole = {
        "int32": product,
        "int64": product * F.lit(98_765_432),
        "decimal": F.col("l_extendedprice").cast("decimal(12,2)"),
        "long_decimal": F.col("l_extendedprice").cast("decimal(14,2)") * F.lit(1_000_003).cast("decimal(7,0)"),
    }[kind]
    return F.concat(sign, pad, whole.cast("string"))


def _number_query(kind: str, encoder, decoder=None) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        token = F.col("token")
        rows = read_table(spark, folder, "lineitem").select("l_orderkey", _long("l_linenumber"), number_token(kind).alias("token"))
        coded = rows.withColumn("enc", encoder(token))
        return coded if decoder is None else coded.withColumn("decoded", decoder(F.col("enc"))).drop("enc")

    return query


def level_filter(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(read_table(spark, folder, "events"))
    return filter_level(logs, "WARN", condition=F.col("seq") % 5 != 0).select("seq", "level", "msg")


LAYOUT = "%d{HH:mm:ss.SSS} %-5level [%t] %c - %msg%n"


def render_layouts(spark: SparkSession, folder: str) -> DataFrame:
    logs = event_logs(read_table(spark, folder, "events"))
    return logs.select("seq", render_layout(LAYOUT).alias("line"))


def strip_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Layout without its timestamp, and the time printed by the stripped format."""
    time_format, rest = strip_layout_timestamp(LAYOUT)
    logs = event_logs(read_table(spark, folder, "events"))
    return logs.select("seq", F.date_format("ts", time_format).alias("time"), render_layout(rest).alias("line"))


def quarantined_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events with every seventh timestamp missing and every eleventh message not UTF-8."""
    logs = event_logs(read_table(spark, folder, "events")).select(
        "seq",
        F.when(F.col("seq") % 7 != 0, F.col("ts")).alias("ts"),
        F.when(F.col("seq") % 11 == 0, F.concat(F.unhex(F.lit("C3")), F.encode("msg", "UTF-8")).cast("string"))
        .otherwise(F.col("msg"))
        .alias("msg"),
    )
    good, bad = with_error_policy(logs, on_error="quarantine")
    return good.select("seq", F.lit("good").alias("outcome")).unionByName(bad.select("seq", F.col("reason").alias("outcome")))


# --- dictionaries ------------------------------------------------------------


def _logtype_dictionary_of(table: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        entries = logtype_dictionary(materialize(encode(messages(spark, folder, table)), "encoded"))
        return entries.select("id", _hex("digest"), "value", "n")

    return query


def _variable_dictionary_of(table: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        entries = variable_dictionary(encode(messages(spark, folder, table)))
        return entries.select("id", _hex("digest"), "value", "n")

    return query


def digests(spark: SparkSession, folder: str) -> DataFrame:
    rows = messages(spark, folder, "conversations")
    return rows.select("source", "seq", F.lower(F.hex(digest(F.col("msg")))).alias("digest"))


def dense_ids_from_one(spark: SparkSession, folder: str) -> DataFrame:
    entries = logtype_dictionary(encode(messages(spark, folder, "events"), mode="int_only"), start=1)
    return entries.select("id", "value")


def looked_up_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Dictionary id of every dictionary variable of the events, by shuffle join with hot values apart."""
    encoded = materialize(encode(messages(spark, folder, "events")), "encoded")
    dictionary = materialize(variable_dictionary(encoded), "variables")
    uses = explode_each(encoded, F.col("vars"), "source", "seq").where("v.kind = 18")
    rows = uses.select("source", "seq", _long("pos"), F.col("v.text").alias("text"))
    return lookup_ids(rows, dictionary, "text", "id", F.xxhash64("source", "seq", "pos"), broadcast_bytes=0)


def upserted_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Variables of the documents, then those of the pages added."""
    known = materialize(variable_dictionary(encode(messages(spark, folder, "documents"))), "variables")
    batch = distinct_values(variable_occurrences(encode(messages(spark, folder, "pages"))))
    return upsert_dictionary(batch, known).select("id", "value", "n")


def dictionary_sizes(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode(messages(spark, folder, "events"))
    return dictionary_bytes(variable_dictionary(encoded))


def exported_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode(messages(spark, folder, "events"))
    return export_dictionary(logtype_dictionary(encoded)).select("id", F.lower(F.hex("entry")).alias("entry"))


def compact_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Variables of the compact form, numbered in each segment of the events."""
    segmented = with_segments(inline_form(encode(messages(spark, folder, "events"), mode="compact")))
    return segment_variables(materialize(segmented, "segmented")).select("segment", "id", "value", "n")


# --- archives ----------------------------------------------------------------


def _event_columns(events: DataFrame) -> DataFrame:
    own = [c for c in ("segment",) if c in events.columns]
    return events.select("source", "seq", F.unix_millis("ts").alias("ts_ms"), *own, "logtype_id", _joined("vars"))


def _archive_columns_of(table: str, mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        encoded = encode(messages(spark, folder, table), mode=mode)
        return _event_columns(build_archive(encoded, compact=mode == "compact").events)

    return query


def _archive_round_trip(table: str, mode: str, by_date: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, "archive")
        encoded = encode(messages(spark, folder, table), mode=mode)
        write_archive(encoded, path, compact=mode == "compact", by_date=by_date, long_entries=True)
        decoded = read_archive(spark, path).decode()
        return decoded.select("source", "seq", F.unix_millis("ts").alias("ts_ms"), "msg")

    return query


def _codec_round_trip(codec: str, level: int) -> Query:
    """Documents through an archive of another codec or level; its file names tell the codec."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, f"archive-{codec}-{level}")
        write_archive(encode(messages(spark, folder, "documents")), path, codec=codec, level=level)
        archive = read_archive(spark, path)
        ending = {"gzip": ".gz.parquet", "zstd": ".zstd.parquet", "none": ".parquet"}["none" if level == 0 else codec]
        named = archive.events.select(F.input_file_name().endswith(ending).alias("named")).agg(F.bool_and("named").alias("named"))
        return _times_and_text(archive.decode()).withColumn("named", F.lit(named.first()["named"]))

    return query


def _inline_round_trip(table: str, mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, "inline")
        write_inline(encode(messages(spark, folder, table), mode=mode), path)
        decoded = read_inline(spark, path, compact=mode == "compact")
        return decoded.select("source", "seq", F.unix_millis("ts").alias("ts_ms"), "msg")

    return query


def decode_in_place(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decode_encoded(materialize(encode(messages(spark, folder, "documents")), "encoded"))
    return decoded.select("source", "seq", "msg")


def decode_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines of an archive, timestamp regenerated."""
    archive = build_archive(encode(messages(spark, folder, "events")))
    lines = render_timestamp(archive.decode(), "yyyy-MM-dd HH:mm:ss.SSS ")
    return lines.select("seq", "line")


def _row_major_payloads(mode: str, id_bytes: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        archive = build_archive(encode(messages(spark, folder, "events"), mode=mode), compact=mode == "compact")
        payloads = row_major(archive, id_bytes)
        return payloads.select("source", "seq", *[c for c in ("segment",) if c in payloads.columns], _hex("payload"))

    return query


def row_major_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "row-major")
    write_row_major(build_archive(encode(messages(spark, folder, "events"))), path)
    return _event_columns(read_row_major(spark, path).events)


def row_major_text_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Text of a row-major archive, from its own files alone."""
    path = scratch_path(spark, "row-major-text")
    encoded = encode(messages(spark, folder, "pages"), mode="compact")
    write_row_major(build_archive(encoded, compact=True, long_entries=True), path, id_bytes=2)
    return _times_and_text(read_row_major(spark, path).decode())


def _times_and_text(events: DataFrame) -> DataFrame:
    return events.select("source", "seq", F.unix_millis("ts").alias("ts_ms"), "msg")


def _odd_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events of which every eleventh message is not UTF-8."""
    broken = F.concat(F.unhex(F.lit("75C328")), F.encode("msg", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    return messages(spark, folder, "events").withColumn("msg", F.when(F.col("seq") % 11 == 0, broken).otherwise(F.col("msg")))


def _invalid_utf8_round_trip(archived: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        coded = encode(_odd_messages(spark, folder))
        path = scratch_path(spark, "bytes")
        if archived:
            write_archive(coded, path)
            back = read_archive(spark, path).decode()
        else:
            write_inline(coded, path)
            back = read_inline(spark, path)
        return back.select("source", "seq", F.lower(F.hex(F.col("msg").cast("binary"))).alias("bytes"))

    return query


def leading_lines_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Log files that begin in the middle of an event: every line comes back out of the archive."""
    logs = log_file_lines(read_table(spark, folder, "events"))
    tail = F.concat(F.lit("\ttail of "), F.col("seq").cast("string"), F.lit("\n"), F.col("line"))
    path, out = scratch_path(spark, "leading"), scratch_path(spark, "leading-archive")
    write_text(logs.select(tail.alias("line")), path)
    write_archive(encode(parse_logs(spark, path, strip=False)), out)
    return read_archive(spark, out).decode().select(F.explode(F.split("msg", "\n")).alias("line"))


# --- records -----------------------------------------------------------------


def _record_columns(records: DataFrame) -> DataFrame:
    return records.select(
        "source", "seq", _long("pos"), _long("op"), _hex("digest"), "literal", _long("first"), "value"
    )


def _records_of(mode: str, compact: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        encoded = encode(messages(spark, folder, "events"), mode="compact" if compact else "standard")
        records = materialize(to_records(encoded, compact), "records")
        return _record_columns(dedup_records(records, mode))

    return query


def _record_bytes_of(mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        records = materialize(to_records(encode(messages(spark, folder, "pages"))), "records")
        return record_bytes(dedup_records(records, mode), mode, "source")

    return query


def record_markers(spark: SparkSession, folder: str) -> DataFrame:
    records = materialize(to_records(encode(messages(spark, folder, "documents"))), "records")
    marked = dedup_records(records, "marked").withColumn("marker", record_marker("marked").cast("bigint"))
    return marked.groupBy("marker").agg(F.count("*").alias("n"))


def _records_archive(mode: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, "records")
        write_event_records(materialize(encode(messages(spark, folder, "events")), "encoded"), path, mode)
        events, _, _ = records_to_archive(read_records(spark, path))
        return _event_columns(events)

    return query


def merged_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and conversations as separate streams, merged into one archive."""
    streams = [
        dedup_records(materialize(to_records(encode(messages(spark, folder, t))), "records"), "separate")
        for t in ("documents", "conversations")
    ]
    events, _, _ = records_to_archive(materialize(merge_sources(*streams), "merged"))
    return _event_columns(events)


# --- reports -----------------------------------------------------------------


def size_report(spark: SparkSession, folder: str) -> DataFrame:
    encoded = materialize(encode(messages(spark, folder, "events"), mode="int_only", keep_message=True), "encoded")
    original = F.sum(F.octet_length("msg").cast("bigint") + 1)
    report = ir_size_report(encoded, original)
    return report.select(*[_long(n) for n, t in report.dtypes if t != "double"], "ratio_max", "ratio_min")


def event_template_stats(spark: SparkSession, folder: str) -> DataFrame:
    return logtype_stats(encode(messages(spark, folder, "events")))


def compressed_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = messages(spark, folder, "events")
    original = rows.agg(F.sum(F.octet_length("msg") + 1).alias("b")).first().b
    archive = build_archive(encode(rows))
    archive.events = materialize(archive.events, "events")
    report = ir_compressed_report(archive, original)
    return report.select("part", "n_rows", (F.col("bytes") > 0).alias("has_bytes"))


def compressed_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes, shares and ratio of the parts of an archive; they depend on the files written."""
    rows = messages(spark, folder, "events")
    original = rows.agg(F.sum(F.octet_length("msg") + 1).alias("b")).first().b
    archive = build_archive(encode(rows))
    archive.events = materialize(archive.events, "events")
    return ir_compressed_report(archive, original).select("part", "n_rows", "bytes", "pct", "ratio")


def format_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every format of the events, and their ratio to plain text."""
    return compare_all_formats(messages(spark, folder, "events")).select("format", "n_events", "bytes", "ratio")


def format_sizes(spark: SparkSession, folder: str) -> DataFrame:
    sizes = compare_all_formats(messages(spark, folder, "events"))
    return sizes.select("format", "n_events", (F.col("bytes") > 0).alias("has_bytes"))


# --- streams -----------------------------------------------------------------


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream."""
    events = read_table(spark, folder, "events")
    files = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
    return event_logs(files.parquet(folder)).select("source", "seq", "ts", "msg")


def streamed_encode(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stream-inline")
    stream_encode(_event_stream(spark, folder), path, f"{path}-progress").awaitTermination()
    return spark.read.parquet(path).select("source", "seq", "logtype", F.size("vars").cast("bigint").alias("n_vars"))


def streamed_logs(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stream-logs")
    write_stream(stream_logs(spark, _log_folder(spark, folder)), path, f"{path}-progress").awaitTermination()
    return _parsed(spark.read.parquet(path))


def streamed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """One log of all events, arriving in three pieces that are cut inside events, stitched line by line."""
    path = scratch_path(spark, "pieces")
    logs = log_file_lines(read_table(spark, folder, "events"))
    lines = explode_each(logs, F.split("line", "\n"), "seq", item="value")
    last = logs.agg(F.max("seq").alias("last")).first().last or 0
    # The second line of every third part of the log begins the next piece, so the event in front of it is cut in two.
    cut = F.floor((F.col("seq") * 4 + F.least("pos", F.lit(3)) - 1) * 3 / (4 * (last + 1)))
    lines = materialize(lines.withColumn("piece", F.greatest(cut, F.lit(0))), "lines")
    for k in range(3):
        piece = lines.where(F.col("piece") == k).repartitionByRange("seq", "pos").sortWithinPartitions("seq", "pos")
        piece.select("value").write.text(f"{path}-logs/piece={k}")
        arrived = stream_lines(spark, f"{path}-logs/*")
        stream_stitch(arrived, path, f"{path}-progress", pieces=r"^(.*)/piece=([0-9]+)/part-([0-9]+)-[^/]*$").awaitTermination()
    finished, still_open = read_stitched(spark, path)
    return _parsed(finished.unionByName(still_open))


def streamed_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stream-dictionary")

    def run(events: DataFrame) -> None:
        stream_dictionary(variable_occurrences(encode(events)), path, f"{path}-progress").awaitTermination()

    _in_three_runs(spark, folder, run)
    return read_stream_dictionary(spark, path).select("id", "value", "n")


def _in_three_runs(spark: SparkSession, folder: str, run: Callable[[DataFrame], object]) -> None:
    """The events table arriving in three parts; each is one batch of the stream that ``run`` starts and waits for."""
    events = read_table(spark, folder, "events")
    source = scratch_path(spark, "arriving")
    last = events.agg(F.max("event_id").alias("last")).first().last or 0
    for k in range(3):
        events.where(F.floor(F.col("event_id") * 3 / (last + 1)) == k).write.mode("append").parquet(source)
        run(event_logs(spark.readStream.schema(events.schema).parquet(source)).select("source", "seq", "ts", "msg"))


def observed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events and bytes of each batch of a stream, observed while it is encoded."""
    path = scratch_path(spark, "observed")

    def run(events: DataFrame) -> None:
        size = F.sum(F.octet_length("msg").cast("bigint")).alias("n_bytes")
        stream_encode(observed(events, size), path, f"{path}-progress").awaitTermination()

    with batch_rates(spark) as batches:
        _in_three_runs(spark, folder, run)
    rows = [(b["batch"], b["n_rows"], b["n_bytes"], b["rows_per_second"] > 0) for b in batches]
    return spark.createDataFrame(rows, "batch bigint, n_events bigint, n_bytes bigint, has_rate boolean")


def streamed_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """The events' lines in size-rolled files, written in three batches; the newest ten of each source are left."""
    path = scratch_path(spark, "stream-rolling")

    def run(events: DataFrame) -> None:
        lines = render_timestamp(events, "yy/MM/dd HH:mm:ss ").select("source", "seq", "line")
        stream_rolling_text(lines, path, f"{path}-progress", max_bytes=10_000, max_files=10).awaitTermination()

    _in_three_runs(spark, folder, run)
    return read_rolled(spark, path).select("source", "file_no", F.col("value").alias("line"))


# Event time without a literal after which it is sent again.
EXPIRY_MS = 6 * 3600 * 1000


def resent_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Literals of a stream in three batches, sent again after six hours without them."""
    path = scratch_path(spark, "stream-resent")

    def run(events: DataFrame) -> None:
        stream_expiring_literals(to_records(encode(events)), path, f"{path}-progress", EXPIRY_MS).awaitTermination()

    _in_three_runs(spark, folder, run)
    return read_expiring_literals(spark, path).select("source", _long("op"), _hex("digest"), "literal", F.unix_millis("ts").alias("ts_ms"))


def streamed_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Literals that a stream of records sends: one per source, kind and content."""
    path = scratch_path(spark, "stream-records")
    write_records(to_records(encode(messages(spark, folder, "events"))), path, "none")
    records = stream_records(spark, path).withColumn("digest", digest(F.col("literal")))
    out = f"{path}-literals"
    write_stream(stream_literals(records), out, f"{path}-progress").awaitTermination()
    return spark.read.parquet(out).select("source", _long("op"), _hex("digest"), "literal")


def streamed_new_literals(spark: SparkSession, folder: str) -> DataFrame:
    """The same, told apart batch by batch against the literals already sent."""
    path = scratch_path(spark, "stream-new")

    def run(events: DataFrame) -> None:
        stream_new_literals(to_records(encode(events)), path, f"{path}-progress").awaitTermination()

    _in_three_runs(spark, folder, run)
    return read_sent_literals(spark, path).select("source", _long("op"), _hex("digest"), "literal")


def streamed_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended to a columnar archive in three batches, decoded."""
    path = scratch_path(spark, "stream-archive")
    _in_three_runs(spark, folder, lambda events: stream_archive(events, path, f"{path}-progress").awaitTermination())
    return _times_and_text(read_stream_archive(spark, path).decode())


def streamed_archive_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the events, written batch by batch and turned into an archive as they come."""
    path = scratch_path(spark, "stream-record-archive")

    def run(events: DataFrame) -> None:
        write_stream(to_records(encode(events)), f"{path}-records", f"{path}-sent").awaitTermination()
        stream_records_archive(stream_records(spark, f"{path}-records"), path, f"{path}-progress").awaitTermination()

    _in_three_runs(spark, folder, run)
    return _times_and_text(read_stream_archive(spark, path).decode())


# Files that the records of each event are dealt out to.
_CUT_FILES = 96


def _served_archive(mode: str, cut: bool = False) -> Query:
    """A written record stream, taken in three batches of files; ``cut`` deals the records of each event out to all files."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, "served")
        encoded = encode(messages(spark, folder, "events"))
        if cut:
            dealt = dedup_records(materialize(to_records(encoded), "records"), mode)
            dealt.repartition(_CUT_FILES, "source", "seq", "pos").write.parquet(f"{path}-records")
        else:
            write_event_records(materialize(encoded, "encoded"), f"{path}-records", mode)
        files = len(read_records(spark, f"{path}-records").inputFiles())
        arriving = stream_records(spark, f"{path}-records", files_per_batch=-(-files // 3) or 1)
        stream_records_archive(arriving, path, f"{path}-progress").awaitTermination()
        return _times_and_text(read_stream_archive(spark, path).decode())

    return query


def appended_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, then conversations appended to one archive."""
    path = scratch_path(spark, "append-archive")
    for name in ("documents", "conversations"):
        append_archive(encode(messages(spark, folder, name)), path)
    return _times_and_text(read_stream_archive(spark, path).decode())


def expired_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Literals of a record stream whose state expires; in one batch nothing does, so each is sent once."""
    path = scratch_path(spark, "stream-expiry")
    write_records(to_records(encode(messages(spark, folder, "events"))), path, "none")
    records = stream_records(spark, path).withColumn("digest", digest(F.col("literal")))
    out = f"{path}-literals"
    write_stream(stream_literals(records, expiry="400 days"), out, f"{path}-progress").awaitTermination()
    return spark.read.parquet(out).select("source", _long("op"), _hex("digest"), "literal")


QUERIES: dict[str, Query] = {
    "stitch_events": stitch_documents,
    "parse_logs": parse_log_files,
    "parse_logs_whole_files": parse_whole_log_files,
    "parse_logs_unstripped": parse_logs_unstripped,
    "parse_lines_fixed": parse_fixed_lines,
    "split_timestamp": split_timestamps,
    "synthetic_logs": synthetic_log_messages,
    "synthetic_columns": synthetic_column_rows,
    "plain_text": _text_round_trip("none"),
    "gzip_text": _text_round_trip("gzip"),
    "zstd_text": _text_round_trip("zstd"),
    "zstd_column": zstd_column_round_trip,
    "rolling_files": rolled_file_numbers,
    "rolling_text": rolling_text_newest,
    "running_bytes": running_bytes,
    "tokenize_documents": tokenize_documents,
    "variables_documents": _variables_of("documents"),
    "variables_pages": _variables_of("pages"),
    "variables_conversations": _variables_of("conversations"),
    "hex_tokens": hex_tokens,
    "eq_tokens": eq_tokens,
    "variable_tokens": variable_token_counts,
    "classify_standard": _classified("standard"),
    "classify_compact": _classified("compact"),
    "logtype_documents": _logtypes_of("documents", "standard"),
    "logtype_events": _logtypes_of("events", "standard"),
    "logtype_int_only": _logtypes_of("events", "int_only"),
    "logtype_compact": _logtypes_of("events", "compact"),
    "logtype_pages": _logtypes_of("pages", "standard"),
    "encode_events": _encoded_variables("events", "standard"),
    "encode_documents": _encoded_variables("documents", "standard"),
    "encode_compact": _encoded_variables("events", "compact"),
    "encode_int_only": _encoded_variables("events", "int_only"),
    "template_counts": template_counts,
    "encode_ints": _number_query("int64", numbers.encode_int64),
    "encode_ints32": _number_query("int32", numbers.encode_int32),
    "encode_decimals64": _number_query("decimal", numbers.encode_decimal64),
    "encode_decimals32": _number_query("decimal", numbers.encode_decimal32),
    "encode_long_decimals": _number_query("long_decimal", numbers.encode_decimal64),
    "decode_ints": _number_query("int64", numbers.encode_int64, numbers.decode_int),
    "decode_decimals64": _number_query("long_decimal", numbers.encode_decimal64, numbers.decode_decimal64),
    "decode_decimals32": _number_query("decimal", numbers.encode_decimal32, numbers.decode_decimal32),
    "level_filter": level_filter,
    "render_layout_events": render_layouts,
    "strip_layout_timestamp": strip_layout,
    "error_policy": quarantined_rows,
    "logtype_dictionary": _logtype_dictionary_of("events"),
    "logtype_dictionary_documents": _logtype_dictionary_of("documents"),
    "variable_dictionary": _variable_dictionary_of("documents"),
    "variable_dictionary_pages": _variable_dictionary_of("pages"),
    "digest_dictionary": digests,
    "dense_logtype_ids": dense_ids_from_one,
    "lookup_ids": looked_up_ids,
    "upsert_dictionary": upserted_dictionary,
    "dictionary_bytes": dictionary_sizes,
    "dictionary_export": exported_dictionary,
    "compact_dictionary": compact_dictionary,
    "archive_columns": _archive_columns_of("events", "standard"),
    "archive_columns_documents": _archive_columns_of("documents", "standard"),
    "archive_columns_compact": _archive_columns_of("events", "compact"),
    "decode_roundtrip_documents": _archive_round_trip("documents", "standard"),
    "decode_roundtrip_pages": _archive_round_trip("pages", "compact"),
    "decode_roundtrip_events": _archive_round_trip("events", "standard", by_date=True),
    "decode_roundtrip_conversations": _archive_round_trip("conversations", "int_only"),
    "archive_codec_gzip": _codec_round_trip("gzip", 3),
    "archive_level_19": _codec_round_trip("zstd", 19),
    "archive_uncompressed": _codec_round_trip("zstd", 0),
    "inline_roundtrip": _inline_round_trip("documents", "standard"),
    "inline_roundtrip_compact": _inline_round_trip("events", "compact"),
    "decode_encoded": decode_in_place,
    "decode_lines": decode_lines,
    "row_major_payload": _row_major_payloads("standard", 8),
    "row_major_compact": _row_major_payloads("compact", 2),
    "row_major_roundtrip": row_major_round_trip,
    "row_major_text_roundtrip": row_major_text_round_trip,
    "roundtrip_invalid_utf8": _invalid_utf8_round_trip(archived=True),
    "roundtrip_invalid_utf8_inline": _invalid_utf8_round_trip(archived=False),
    "roundtrip_leading_lines": leading_lines_round_trip,
    "records_none": _records_of("none"),
    "records_shared": _records_of("shared"),
    "records_separate": _records_of("separate"),
    "records_marked": _records_of("marked"),
    "records_compact": _records_of("separate", compact=True),
    "record_bytes_none": _record_bytes_of("none"),
    "record_bytes_shared": _record_bytes_of("shared"),
    "record_bytes_separate": _record_bytes_of("separate"),
    "record_bytes_marked": _record_bytes_of("marked"),
    "record_markers": record_markers,
    "records_to_archive": _records_archive("separate"),
    "records_to_archive_shared": _records_archive("shared"),
    "records_to_archive_none": _records_archive("none"),
    "records_to_archive_marked": _records_archive("marked"),
    "records_multi_source": merged_sources,
    "ir_size_report": size_report,
    "logtype_stats": event_template_stats,
    "ir_compressed_report": compressed_report,
    "compare_formats": format_sizes,
    "ir_compressed_sizes": compressed_sizes,
    "compare_format_sizes": format_bytes,
    "stream_encode": streamed_encode,
    "stream_logs": streamed_logs,
    "stream_stitch": streamed_pieces,
    "stream_dictionary": streamed_dictionary,
    "stream_literals": streamed_literals,
    "stream_new_literals": streamed_new_literals,
    "stream_literals_expiry": expired_literals,
    "stream_archive_roundtrip": streamed_archive,
    "stream_records_to_archive": streamed_archive_columns,
    "stream_records_none": _served_archive("none"),
    "stream_records_shared": _served_archive("shared"),
    "stream_records_separate": _served_archive("separate"),
    "stream_records_marked": _served_archive("marked"),
    "stream_records_cut": _served_archive("separate", cut=True),
    "stream_observed": observed_batches,
    "stream_rolling_text": streamed_rolling,
    "stream_literals_resent": resent_literals,
    "append_archive": appended_archive,
}
