"""Decoding: archives and encoded events back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DECIMAL_KIND, DICT_KIND, INT_KIND, LINE_TIME_FORMAT, RAW_MARK
from ..functions.digests import from_big_endian
from ..functions.numbers import decode_decimal32, decode_decimal64, decode_int
from ..functions.tokens import as_message, unescape
from ..session import BROADCAST_BYTES
from .explode import explode_each
from .lookup import lookup
from .segments import wide_id

_PLACEHOLDERS = "[\x11-\x13]"


def placeholder_kinds(logtype: Column) -> Column:
    """Kinds of the variables of a logtype, in order."""
    return F.regexp_extract_all(logtype, F.lit(_PLACEHOLDERS), F.lit(0))


def is_raw(logtype: Column) -> Column:
    """Whether the message was not UTF-8."""
    return logtype.startswith(RAW_MARK)


def constant_parts(logtype: Column) -> Column:
    """Constant text around the variables, unescaped: one more part than variables."""
    text = F.when(is_raw(logtype), F.substr(logtype, F.lit(len(RAW_MARK) + 1))).otherwise(logtype)
    same = F.translate(text, chr(INT_KIND) + chr(DECIMAL_KIND), chr(DICT_KIND) * 2)
    return F.transform(F.split(same, chr(DICT_KIND)), unescape)


def decode_variable(kind: Column, enc: Column, text: Column, compact: bool = False) -> Column:
    """Text of one variable."""
    decimal = decode_decimal32(enc) if compact else decode_decimal64(enc)
    return (
        F.when(kind == DICT_KIND, text)
        .when(kind == INT_KIND, decode_int(enc))
        .when(kind == DECIMAL_KIND, decimal)
    )


def assemble(parts: Column, texts: Column) -> Column:
    """Constant parts and variable texts, interleaved. A variable without text raises."""
    # Both arrays are arguments: neither is computed again per element.
    ends = F.concat(texts, F.array(F.lit("")))
    lost = F.raise_error(F.lit("a variable of this template has no text"))
    return F.array_join(F.zip_with(parts, ends, lambda part, text: F.coalesce(F.concat(part, text), lost)), "")


def decode_encoded(encoded: DataFrame, compact: bool = False, out: str = "msg") -> DataFrame:
    """Message text of events that still hold ``vars`` with their text."""
    texts = F.transform("vars", lambda v: decode_variable(v["kind"], v["enc"], v["text"], compact))
    logtype = F.col("logtype")
    return encoded.withColumn(out, as_message(assemble(constant_parts(logtype), texts), is_raw(logtype))).drop("logtype", "vars")


def decode_events(
    events: DataFrame,
    logtypes: DataFrame,
    variables: DataFrame,
    compact: bool = False,
    out: str = "msg",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Message text of archive events ``(source, seq, ts, logtype_id, vars)``.

    An entry that the dictionaries lack, or two events of one ``(source, seq)``,
    raise an error. Only dictionary variables are exploded and looked up; the rest of an event
    never leaves its row. Templates are taken apart once per dictionary entry,
    not once per event. Where events and dictionaries have a ``segment``, ids are those of it.
    """
    own = [c for c in ("segment",) if c in events.columns]
    if own:
        logtypes, variables = (d.withColumn("id", wide_id(F.col("segment"), F.col("id"))).drop("segment") for d in (logtypes, variables))
        events = events.withColumn("logtype_id", wide_id(F.col("segment"), F.col("logtype_id")))
    # Dealt out by event once: the texts found for an event's variables join it where it lies.
    events = events.repartition("source", "seq")
    spread = F.xxhash64("source", "seq")
    templates = logtypes.withColumns(
        {
            "kinds": F.transform(placeholder_kinds(F.col("value")), lambda kind: F.ascii(kind).cast("tinyint")),
            "parts": constant_parts(F.col("value")),
            "raw": is_raw(F.col("value")),
        }
    )
    take = {"kinds": "_kinds", "parts": "_parts", "raw": "_raw"}
    named = lookup(events, templates, "logtype_id", "id", take, spread, broadcast_bytes)
    # A missing template has no kinds, so the sizes differ (or one is NULL).
    fits = F.coalesce(F.size("_kinds") == F.size("vars"), F.lit(False))
    kinds = F.when(fits, F.col("_kinds")).otherwise(F.raise_error(F.lit("no template of as many variables for this event")))
    typed = named.withColumn(
        "_typed",
        F.zip_with(
            kinds.cast("array<tinyint>"),
            F.col("vars"),
            lambda kind, enc: F.struct(kind.alias("kind"), enc.cast("bigint").alias("enc")),
        ),
    ).drop("vars", "logtype_id", "_kinds")
    entry = wide_id(F.col("segment"), F.col("v.enc")) if own else F.col("v.enc")
    references = (
        explode_each(typed, F.col("_typed"), "source", "seq", *own)
        .where(F.col("v.kind") == DICT_KIND)
        .select("source", "seq", "pos", entry.alias("_ref"))
    )
    found = lookup(
        references, variables, "_ref", "id", {"value": "text"}, F.xxhash64("source", "seq", "pos"), broadcast_bytes
    )
    # Group size is the number of variables of one event.
    per_event = found.groupBy("source", "seq").agg(F.collect_list(F.struct("pos", "text")).alias("_found"))
    numeric = F.filter(
        F.transform(
            "_typed",
            lambda v, i: F.struct(
                i.alias("pos"), decode_variable(v["kind"], v["enc"], F.lit(None), compact).alias("text")
            ),
        ),
        lambda p: p["text"].isNotNull(),
    )
    found_texts = F.coalesce("_found", F.array().cast("array<struct<pos:int,text:string>>"))
    due = F.size(F.filter("_typed", lambda v: v["kind"] == DICT_KIND))
    whole = (F.size(found_texts) == due) & ~F.exists(found_texts, lambda p: p["text"].isNull())
    lost = F.raise_error(F.lit("a dictionary entry is missing, or two events have one (source, seq)"))
    checked = F.when(whole, found_texts).otherwise(lost.cast("array<struct<pos:int,text:string>>"))
    in_order = F.sort_array(F.concat(numeric, checked))
    return (
        typed.join(per_event, ["source", "seq"], "left")
        .withColumn("_texts", F.transform(in_order, lambda p: p["text"]))
        .withColumn(out, as_message(assemble(F.col("_parts"), F.col("_texts")), F.col("_raw")))
        .drop("_parts", "_raw", "_typed", "_found", "_texts", *own)
    )


def decode_row_major(rows: DataFrame, id_bytes: int = 8, var_bytes: int = 8) -> DataFrame:
    """``(source, seq, ts, logtype_id, vars)`` of row-major payloads."""
    payload = F.col("payload")
    count = ((F.octet_length(payload) - 8 - id_bytes) / var_bytes).cast("int")
    starts = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: (i * var_bytes + 9 + id_bytes).cast("int")
    )
    words = F.transform(starts, lambda start: from_big_endian(payload, start, var_bytes))
    logtype_id = from_big_endian(payload, 9, id_bytes)
    if id_bytes < 8:
        logtype_id = F.pmod(logtype_id, F.lit(1 << (8 * id_bytes)))
    return rows.select(
        "source",
        "seq",
        *[c for c in ("segment",) if c in rows.columns],
        F.timestamp_millis(from_big_endian(payload, 1)).alias("ts"),
        logtype_id.alias("logtype_id"),
        F.when(count > 0, words).otherwise(F.array().cast("array<bigint>")).alias("vars"),
    )


def render_timestamp(df: DataFrame, ts_format: str = LINE_TIME_FORMAT, message: str = "msg", out: str = "line"):
    """Log lines: the timestamp in the given format, then the message."""
    return df.withColumn(out, F.concat(F.date_format("ts", ts_format), F.col(message)))
