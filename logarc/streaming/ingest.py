"""Append-mode ingest: new log files to encoded events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import LINE_TIME_FORMAT
from ..operators.encode import encode
from ..plans.archive import codec_options, inline_form
from ..sources.logs import _events_of_files, finish_events


def stream_logs(spark: SparkSession, path: str, strip: bool = True, ts_format: str = LINE_TIME_FORMAT) -> DataFrame:
    """``(source, seq, ts, msg)`` of log files as they arrive.

    Files are read whole, because a stream has no row order to stitch by.
    """
    files = spark.readStream.text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("source"), "value")
    return finish_events(_events_of_files(named), strip, ts_format)


def stream_encode(
    events: DataFrame, path: str, checkpoint: str, message: str = "msg", mode: str = "standard", level: int = 3
) -> StreamingQuery:
    """Encode a stream into an inline archive; no state is kept.

    Runs until all present input is written, then stops; run it again with the
    same checkpoint to add what is new.
    """
    coded = inline_form(encode(events, message, mode))
    return (
        coded.writeStream.format("parquet")
        .options(**codec_options("zstd", level))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def stream_console(events: DataFrame, checkpoint: str, emit: Callable[[str], None] = print) -> StreamingQuery:
    """Print every event of a stream, one line each: the console output, or a debug tee beside another query.

    Rows come to the driver, whose console it is, a partition at a time.
    """

    def show(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            emit("\t".join("" if value is None else str(value) for value in row))

    return (
        events.writeStream.foreachBatch(show)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
