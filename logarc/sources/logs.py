"""Log text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LINE_HEAD, LINE_HEAD_CHARS, LINE_TIME_FORMAT
from ..operators.explode import explode_each
from ..operators.stitch import split_file_text, split_timestamp, stitch_events, strip_trailing


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file_path, block, mid, value)`` of the lines of text files.

    ``mid`` is set right on the scan, where row order is file order.
    """
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("mid"),
            "value",
        )
    )


def read_whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(source, seq, value)`` of the events of many small files.

    Each file is one row, cut into events where a timestamp head starts a line:
    no shuffle at all. A file has to fit in one task; use the line form for
    large ones.
    """
    files = spark.read.text(path, wholetext=True)
    return _events_of_files(files.select(F.col("_metadata.file_path").alias("source"), "value"))


def _events_of_files(files: DataFrame, head_regex: str = LINE_HEAD) -> DataFrame:
    events = explode_each(files, split_file_text(F.col("value"), head_regex), "source", item="event")
    return events.select("source", "event.seq", "event.value")


def parse_logs(
    spark: SparkSession,
    path: str | list[str],
    strip: bool = True,
    whole_files: bool = False,
    ts_format: str = LINE_TIME_FORMAT,
) -> DataFrame:
    """``(source, seq, ts, msg)`` of log files with multi-line events."""
    events = read_whole_files(spark, path) if whole_files else stitch_events(read_log_lines(spark, path))
    return finish_events(events, strip, ts_format)


def finish_events(events: DataFrame, strip: bool = True, ts_format: str = LINE_TIME_FORMAT) -> DataFrame:
    """Timestamp and message of stitched events; a line in front of all events is all message, without a time."""
    whole = events.withColumn("_whole", F.when(F.col("seq") < 0, F.col("value")))
    parsed = split_timestamp(whole, ts_format).withColumn("msg", F.coalesce("_whole", "msg")).drop("_whole")
    return parsed.withColumn("msg", strip_trailing(F.col("msg"))) if strip else parsed


def parse_lines_fixed(
    spark: SparkSession, path: str | list[str], width: int = LINE_HEAD_CHARS, ts_format: str = LINE_TIME_FORMAT
) -> DataFrame:
    """``(file_path, block, mid, ts, msg)``: every line is one event, no stitching, no shuffle."""
    return split_timestamp(read_log_lines(spark, path), ts_format, width)
