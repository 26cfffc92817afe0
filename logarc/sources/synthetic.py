"""Generators of the synthetic workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_message(i: Column) -> Column:
    """Message number ``i`` of the synthetic log (text is a fixed value)."""
    return F.concat(
        F.lit("This is a log message with one spark unique app id per line: app-20201119"),
        (i % 1000).cast("string"),
        F.lit("-"),
        (i % 20000).cast("string"),
        F.lit(" from spark-node-"),
        (i % 1000).cast("string"),
    )


def synthetic_logs(spark: SparkSession, n: int = 10_000_000) -> DataFrame:
    """``(id, msg)`` for ids 0 to n-1."""
    return spark.range(n).select("id", synthetic_message(F.col("id")).alias("msg"))


def synthetic_vars(i: Column, k: int) -> Column:
    """The ``k`` consecutive values that belong to row ``i``."""
    return F.sequence(i * k, i * k + (k - 1))


def synthetic_columns(spark: SparkSession, n: int = 100_000, k: int = 4) -> DataFrame:
    """``(ts, logtype, vars)``: the three columns of a made-up archive."""
    i = F.col("id")
    return spark.range(n).select(i.alias("ts"), i.alias("logtype"), synthetic_vars(i, k).alias("vars"))
