"""Plain and compressed text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_total


# Size at which a rolling file is full, as logging configurations mean "1M" (fixed value).
MEGABYTE = 1 << 20
# The codec that comes with Spark's Parquet library; Hadoop's own needs a native library on every machine.
_ZSTD_CODEC = "org.apache.parquet.hadoop.codec.ZstandardCodec"


def write_text(lines: DataFrame, path: str, codec: str = "none", column: str = "line", level: int = 3) -> None:
    """Text files: ``none``, ``gzip`` or ``zstd`` (``level``: of zstd).

    Zstd files are plain zstd streams of the lines, compressed by the executors with the
    codec that comes with Spark; any zstd tool reads them.
    """
    rows = lines.select(F.col(column).alias("value")).write
    if codec == "zstd":
        rows = rows.option("parquet.compression.codec.zstd.level", str(level))
    rows.option("compression", _ZSTD_CODEC if codec == "zstd" else codec).text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines written by :func:`write_text`; the codec is told by the files' names."""
    return spark.read.option("io.compression.codecs", _ZSTD_CODEC).text(path, lineSep="\n")


def write_zstd_column(lines: DataFrame, path: str, column: str = "line") -> None:
    """A Parquet table of one plainly encoded column: the bytes of the text, compressed with zstd."""
    rows = lines.select(F.col(column).alias("value"))
    rows.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def read_zstd_column(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines written by :func:`write_zstd_column`."""
    return spark.read.schema("value string").parquet(path).select(F.explode(F.split("value", "\n")).alias("value"))


def write_plain_text(lines: DataFrame, path: str, column: str = "line") -> None:
    write_text(lines, path, "none", column)


def write_gzip_text(lines: DataFrame, path: str, column: str = "line") -> None:
    write_text(lines, path, "gzip", column)


def write_zstd_text(lines: DataFrame, path: str, column: str = "line") -> None:
    write_text(lines, path, "zstd", column)


def rolling_files(
    lines: DataFrame, max_bytes: int = MEGABYTE, max_files: int | None = None, column: str = "line"
) -> DataFrame:
    """Add ``file_no``: a source goes to its next file once ``max_bytes`` are written.

    A line counts with its line end. ``max_files`` keeps only the newest files
    of a source, as a rolling log does.
    """
    size = F.octet_length(column).cast("bigint") + 1
    # One row per source: where its last line starts.
    last = lines.groupBy("source").agg((F.sum(size) - F.max_by(size, F.col("seq"))).alias("_last_start"))
    totals = running_total(lines.withColumn("_size", size), ["source"], "seq", F.col("_size"), "_total", last)

    def file_of(start):
        return F.floor(start / max_bytes).cast("bigint")

    rolled = totals.withColumn("file_no", file_of(F.col("_total") - F.col("_size")))
    if max_files is not None:
        rolled = rolled.where(F.col("file_no") > file_of(F.col("_last_start")) - max_files)
    return rolled.drop("_size", "_total", "_last_start")


def write_rolling_text(
    lines: DataFrame,
    path: str,
    max_bytes: int = MEGABYTE,
    max_files: int | None = None,
    codec: str = "gzip",
    column: str = "line",
) -> None:
    """Size-rolled text files, one folder per source and file number."""
    rolled = rolling_files(lines, max_bytes, max_files, column)
    # All lines of one file have one range key, so they reach one task; a file is max_bytes long.
    placed = rolled.repartitionByRange("source", "file_no").sortWithinPartitions("source", "file_no", "seq")
    placed.select("source", "file_no", F.col(column).alias("value")).write.partitionBy("source", "file_no").option(
        "compression", codec
    ).text(path)
