"""Dictionaries: distinct values with stable dense ids and content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COMPACT_MAX_ID, DICT_KIND, ENTRY_MAX_BYTES
from ..functions.digests import digest, entry_bytes
from ..session import BROADCAST_BYTES, materialize
from .explode import explode_each
from .lookup import lookup
from .ordering import dense_ids

DICTIONARY_COLUMNS = ("id", "digest", "value", "n")


def first_seen(seq: Column, pos: Column) -> Column:
    """Order of an occurrence: event first, then place in the event.

    One decimal instead of a struct, because a minimum over a fixed-width value
    stays in the hash aggregate and combines before the shuffle.
    """
    return (seq.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + pos).cast("decimal(38,0)")


def distinct_values(occurrences: DataFrame) -> DataFrame:
    """``(value, first, n)`` of a table of occurrences ``(value, first)``."""
    return occurrences.groupBy("value").agg(F.min("first").alias("first"), F.count("*").alias("n"))


def variable_occurrences(encoded: DataFrame) -> DataFrame:
    """One row per dictionary variable of the encoded events."""
    return (
        explode_each(encoded, F.col("vars"), "seq")
        .where(F.col("v.kind") == DICT_KIND)
        .select(F.col("v.text").alias("value"), first_seen(F.col("seq"), F.col("pos")).alias("first"))
    )


def number_values(values: DataFrame, start: int = 0) -> DataFrame:
    """Give distinct values their ids, in order of first occurrence."""
    numbered = dense_ids(values, ["first", "value"], "id", start)
    return numbered.select("id", digest(F.col("value")).alias("digest"), "value", "n")


def logtype_dictionary(encoded: DataFrame, start: int = 0) -> DataFrame:
    """Distinct logtypes with ids by first occurrence."""
    found = encoded.select(F.col("logtype").alias("value"), first_seen(F.col("seq"), F.lit(0)).alias("first"))
    return number_values(distinct_values(found.where("value is not null")), start)


def variable_dictionary(encoded: DataFrame, start: int = 0) -> DataFrame:
    """Distinct dictionary variables with ids by first occurrence."""
    return number_values(distinct_values(variable_occurrences(encoded)), start)


def new_entries(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Values not yet in the dictionary, numbered after its last id.

    Both sides hold each value once, so the anti join has no hot key.
    """
    last = dictionary.agg(F.max("id").alias("id")).first().id
    unseen = (
        values.withColumn("digest", digest(F.col("value")))
        .join(dictionary.select("digest"), "digest", "left_anti")
        .drop("digest")
    )
    return number_values(unseen, 0 if last is None else last + 1)


def upsert_dictionary(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The dictionary with unseen values added and counts brought up to date.

    Known values keep their ids. The batch is stored first, since it is read for the counts
    and for the new entries.
    """
    values = materialize(values, "batch-values")
    counts = values.select(digest(F.col("value")).alias("digest"), F.col("n").alias("_more"))
    kept = dictionary.join(counts, "digest", "left").select(
        "id", "digest", "value", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")
    )
    return kept.unionByName(new_entries(values, dictionary))


def lookup_ids(
    rows: DataFrame,
    dictionary: DataFrame,
    text: str,
    id_col: str,
    spread: Column,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Replace a text column by dictionary ids, joining on the content key."""
    keyed = rows.withColumn("_digest", digest(F.col(text))).drop(text)
    return lookup(keyed, dictionary, "_digest", "digest", {"id": id_col}, spread, broadcast_bytes).drop("_digest")


def check_compact(dictionary: DataFrame, name: str = "dictionary") -> None:
    """Raise if a dictionary does not fit the compact form."""
    row = dictionary.agg(F.max("id").alias("last"), F.max(F.octet_length("value")).alias("longest")).first()
    if row.last is not None and row.last > COMPACT_MAX_ID:
        raise ValueError(f"{name}: id {row.last} is over {COMPACT_MAX_ID}")
    if row.longest is not None and row.longest > ENTRY_MAX_BYTES:
        raise ValueError(f"{name}: an entry of {row.longest} bytes is over {ENTRY_MAX_BYTES}")


def dictionary_bytes(dictionary: DataFrame, prefix_bytes: int = 2) -> DataFrame:
    """Serialized size of a dictionary: a length prefix and the text per entry."""
    size = F.octet_length("value").cast("bigint") + prefix_bytes
    return dictionary.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def export_dictionary(dictionary: DataFrame) -> DataFrame:
    """``(id, entry)`` with the binary form of each entry."""
    fits = F.octet_length("value") <= ENTRY_MAX_BYTES
    entry = F.when(fits, entry_bytes(F.col("value"))).otherwise(
        F.raise_error(F.lit(f"dictionary entry over {ENTRY_MAX_BYTES} bytes")).cast("binary")
    )
    return dictionary.select("id", entry.alias("entry"))
