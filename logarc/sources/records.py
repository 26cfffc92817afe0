"""Record streams at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.records import RECORD_SCHEMA, ordered_event_records, ordered_records
from ..plans.archive import codec_options
from ..session import materialize


def write_records(
    records: DataFrame, path: str, mode: str = "separate", codec: str = "zstd", level: int = 3, files: int | None = None
) -> None:
    """Deduplicate a record stream and write it in stream order, each event in one file.

    Ranges are of whole events, so no file ends inside one; a source with most events
    still spreads over many files (``files``: how many at most).
    """
    if mode != "none":
        # Finding first places reads the records a second time.
        records = materialize(records, "records")
    ordered_records(records, mode, files).write.options(**codec_options(codec, level)).parquet(path)


def write_event_records(
    encoded: DataFrame, path: str, mode: str = "separate", codec: str = "zstd", level: int = 3, files: int | None = None
) -> None:
    """:func:`write_records` of the records of encoded events, by shuffling events. Pass a written table."""
    ordered_event_records(encoded, mode, files).write.options(**codec_options(codec, level)).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A written record stream, as a batch."""
    return spark.read.schema(RECORD_SCHEMA).parquet(path)


def stream_records(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A written record stream, as a stream of new files."""
    files = spark.readStream.schema(RECORD_SCHEMA)
    if files_per_batch is not None:
        files = files.option("maxFilesPerTrigger", files_per_batch)
    return files.parquet(path)
