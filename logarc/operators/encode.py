"""Encoding of messages into templates and typed variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEVELS
from ..functions.tokens import marked_logtype, marked_message, marked_variables


def encode(df: DataFrame, message: str = "msg", mode: str = "standard", keep_message: bool = False) -> DataFrame:
    """Replace a message column by ``logtype`` and ``vars``.

    A narrow projection: no shuffle, no Python. ``_marked`` is named twice above
    it, so Catalyst keeps it as its own projection and computes it once.
    """
    coded = (
        df.withColumn("_marked", marked_message(F.col(message), mode))
        .withColumns({"logtype": marked_logtype(F.col("_marked")), "vars": marked_variables(F.col("_marked"), mode)})
        .drop("_marked")
    )
    return coded if keep_message else coded.drop(message)


def filter_level(df: DataFrame, minimum: str, level: str = "level", condition: Column | None = None) -> DataFrame:
    """Keep events at or above a level, and optionally those meeting a condition."""
    if minimum not in LEVELS:
        raise ValueError(f"unknown level {minimum!r}")
    kept = LEVELS[LEVELS.index(minimum):]
    out = df.where(F.upper(F.col(level)).isin(*kept))
    return out if condition is None else out.where(condition)


def with_error_policy(df: DataFrame, message: str = "msg", ts: str | None = "ts", on_error: str = "fail"):
    """Split off events that cannot be encoded without loss.

    ``fail`` returns one DataFrame that raises when such a row is read; ``drop``
    returns only the good rows; ``quarantine`` returns ``(good, bad)``, where bad
    rows carry a ``reason``.
    """
    reason = F.when(F.col(message).isNull(), "missing message")
    if ts is not None:
        reason = reason.when(F.col(ts).isNull(), "bad timestamp")
    reason = reason.when(~F.is_valid_utf8(F.col(message)), "invalid UTF-8")
    if on_error == "fail":
        failing = F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(F.lit(True))
        return df.where(failing.cast("boolean"))
    if on_error == "drop":
        return df.where(reason.isNull())
    if on_error == "quarantine":
        return df.where(reason.isNull()), df.withColumn("reason", reason).where("reason is not null")
    raise ValueError("on_error must be fail, drop or quarantine")


def count_kinds(encoded: DataFrame, *keys: str) -> DataFrame:
    """Number of events and of variables per kind."""
    kinds = {"n_int": 17, "n_dict": 18, "n_decimal": 19}

    def how_many(kind: int) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("vars", lambda v: v["kind"] == kind))), F.lit(0))

    return encoded.groupBy(*keys).agg(
        F.count("*").alias("n_events"), *[how_many(k).alias(name) for name, k in kinds.items()]
    )
