"""Lookup of dictionary columns that holds up when one value is in most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES

# A value is hot when it makes up at least 1/HOT_SHARE of all occurrences, so
# there are never more than HOT_SHARE hot values.
HOT_SHARE = 1024
# Copies of an entry that is hot but too long to broadcast.
# Each copy answers at most about as many rows as a value that is just hot has.
MAX_SALTS = 1024


def lookup(
    rows: DataFrame,
    dictionary: DataFrame,
    key: str,
    dict_key: str,
    take: dict[str, str],
    spread: Column,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join ``rows`` with the dictionary columns in ``take`` (name → new name).

    ``dictionary`` has unique ``dict_key`` values, a text column ``value`` and
    the number of occurrences ``n``. A dictionary below ``broadcast_bytes`` is
    broadcast whole. A larger one is joined by shuffle, except for its hot
    values (see ``HOT_SHARE``): short ones are broadcast, and the rows they
    answer go into the shuffle under a key made from ``spread`` that no entry
    has, which deals them out evenly; long ones are salted. ``spread`` is any
    well spread BIGINT of the row.
    """
    renamed = {new: F.col(name) for name, new in take.items()}
    entry_bytes = F.lit(64).cast("bigint")
    for name in take:
        entry_bytes = entry_bytes + _held_bytes(F.col(name), dictionary.schema[name].dataType.simpleString())
    total = dictionary.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum(entry_bytes), F.lit(0)).alias("bytes")
    ).first()
    if total.bytes <= broadcast_bytes:
        small = F.broadcast(dictionary.select(F.col(dict_key).alias("_key"), *_named(renamed)))
        return rows.join(small, F.col(key) == F.col("_key"), "left").drop("_key")

    hot = F.col("n") * HOT_SHARE >= F.lit(total.occurrences)
    copies = F.least(F.lit(MAX_SALTS), F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total.occurrences, 1)))).cast("int")
    # At most HOT_SHARE entries pass, so those this short fit in broadcast_bytes.
    short = entry_bytes <= max(broadcast_bytes // HOT_SHARE, 64)
    marks = dictionary.where(hot).select(
        F.col(dict_key).alias("_hot_key"),
        short.alias("_short"),
        copies.alias("_copies"),
        *_named({f"_hot_{new}": F.when(short, column) for new, column in renamed.items()}),
    )
    marked = rows.join(F.broadcast(marks), F.col(key) == F.col("_hot_key"), "left")
    salt = F.when(F.col("_short") == False, F.pmod(spread, F.col("_copies"))).otherwise(F.lit(0))  # noqa: E712
    elsewhere = _foreign_key(rows.schema[key].dataType.typeName(), spread)
    answered = F.coalesce(F.col("_short"), F.lit(False)) | F.col(key).isNull()
    marked = marked.withColumns(
        {"_row_key": F.when(answered, elsewhere).otherwise(F.col(key)), "_row_salt": salt.cast("int")}
    )
    salts = F.when(hot, F.sequence(F.lit(0), copies - 1)).otherwise(F.array(F.lit(0)))
    rest = dictionary.where(~(hot & short)).select(
        F.col(dict_key).alias("_key"), F.explode(salts).alias("_salt"), *_named(renamed)
    )
    joined = marked.join(rest, (F.col("_row_key") == F.col("_key")) & (F.col("_row_salt") == F.col("_salt")), "left")
    merged = {new: F.coalesce(F.col(f"_hot_{new}"), F.col(new)) for new in renamed}
    return joined.withColumns(merged).drop(
        "_key", "_salt", "_hot_key", "_short", "_copies", "_row_key", "_row_salt", *[f"_hot_{new}" for new in renamed]
    )


def _held_bytes(value: Column, kind: str) -> Column:
    """Bytes of a value inside a row in memory: offset and size, and the content in words of 8 bytes."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if kind == "array<string>":
        text = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        return F.coalesce(text, F.lit(0).cast("bigint")) + 24
    if kind.startswith("array"):
        return F.coalesce(F.size(value), F.lit(0)).cast("bigint") * 8 + 24
    return F.lit(8).cast("bigint")


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def _foreign_key(key_type: str, spread: Column) -> Column:
    """A key no dictionary entry has: a negative id, or a digest of 8 bytes."""
    if key_type == "binary":
        return F.unhex(F.lpad(F.hex(spread), 16, "0"))
    return -1 - F.pmod(spread, F.lit(1 << 40))
