"""The given tables seen as messages: ``(source, seq, ts, msg)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def event_level() -> Column:
    """Log level of an event, by its type."""
    kind = F.col("event_type")
    return (
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "view", "DEBUG").otherwise("INFO")
    )


# Letters only: variables because of the equals sign in front of them.
OWNERS = ("alice", "bob", "carol", "dave")


def event_message() -> Column:
    """One log message per event."""
    return F.concat(
        F.col("event_type"),
        F.lit(" user="),
        F.col("user_id").cast("string"),
        F.lit(" owner="),
        F.element_at(F.array(*map(F.lit, OWNERS)), (F.col("user_id") % len(OWNERS) + 1).cast("int")),
        F.lit(" value="),
        F.col("value").cast("decimal(12,2)").cast("string"),
        F.lit(" session=s"),
        F.col("user_id").cast("string"),
        F.lit("-"),
        (F.col("event_id") % 40).cast("string"),
        F.lit(" props="),
        F.col("props"),
    )


def event_logs(events: DataFrame) -> DataFrame:
    """``(source, seq, ts, level, logger, thread, msg)`` of the events table, batch or stream."""
    return events.select(
        F.col("event_type").alias("source"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        event_level().alias("level"),
        F.concat(F.lit("app."), F.col("event_type")).alias("logger"),
        F.concat(F.lit("worker-"), (F.col("user_id") % 8).cast("string")).alias("thread"),
        event_message().alias("msg"),
    )


def messages(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the text tables as messages."""
    df = read_table(spark, folder, name)
    if name == "events":
        return event_logs(df).select("source", "seq", "ts", "msg")
    source, seq, msg = {
        "documents": (F.lit("documents"), "doc_id", "text"),
        "pages": (F.lit("pages"), "page_id", "html"),
        "conversations": (F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), "turn", "text"),
        "benchmark": (F.lit("benchmark"), "item_id", "text"),
    }[name]
    return df.select(
        source.alias("source"), F.col(seq).alias("seq"), F.timestamp_seconds(F.col(seq)).alias("ts"), F.col(msg).alias("msg")
    )


def log_file_lines(events: DataFrame) -> DataFrame:
    """``(source, seq, line)``: log file text of events; errors have stack traces, some lines end in spaces."""
    logs = event_logs(events)
    trace = F.concat(F.lit("\n\tat app.run("), F.col("thread"), F.lit(")\n\tat app.main"))
    tail = F.when(F.col("level") == "ERROR", trace).when(F.col("level") == "WARN", "  ").otherwise("")
    return logs.select(
        "source",
        "seq",
        F.concat(
            F.date_format("ts", "yy/MM/dd HH:mm:ss"), F.lit(" "), "level", F.lit(" "), "logger", F.lit(": "), "msg", tail
        ).alias("line"),
    )
