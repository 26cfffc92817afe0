"""Every output format of the same events, for size and speed comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LINE_TIME_FORMAT, OP_TIMESTAMP
from ..operators.decode import render_timestamp
from ..operators.encode import encode
from ..operators.report import compare_formats
from ..session import materialize
from ..sources.records import read_records, write_event_records
from ..sources.text_sinks import read_text, read_zstd_column, write_gzip_text, write_plain_text, write_zstd_column
from .archive import read_archive, write_archive, write_inline, write_row_major


def compare_all_formats(events: DataFrame, level: int = 3) -> DataFrame:
    """Text baselines, archive layouts and record streams of ``(source, seq, ts, msg)``.

    Every format counts with all it needs to be read again, dictionaries included. The row-major
    form is made from the columnar one as it was written, so ids are given once.
    """
    lines = render_timestamp(events, LINE_TIME_FORMAT).select("line")
    encoded = materialize(encode(events), "encoded")
    writers = {
        "plain": lambda p: write_plain_text(lines, p),
        "gzip": lambda p: write_gzip_text(lines, p),
        "zstd": lambda p: write_zstd_column(lines, p),
        "columnar": lambda p: write_archive(encoded, p, level=level),
        "row_major": lambda p: write_row_major(read_archive(events.sparkSession, _beside(p, "columnar")), p, level=level),
        "inline": lambda p: write_inline(encoded, p, level=level),
        **{
            f"records_{mode}": (lambda p, m=mode: write_event_records(encoded, p, m, level=level))
            for mode in ("none", "shared", "separate", "marked")
        },
    }
    sizes = compare_formats(events.sparkSession, writers, _stored_events)
    plain = sizes.where("format = 'plain'").first().bytes
    return sizes.withColumn("ratio", F.round(F.lit(plain) / F.col("bytes"), 4))


def _beside(path: str, name: str) -> str:
    """Folder of another format, written before."""
    return f"{path.rsplit('/', 1)[0]}/{name}"


def _stored_events(spark: SparkSession, name: str, path: str) -> int:
    """Events that a written format holds, counted in its files."""
    if name in ("plain", "gzip"):
        return read_text(spark, path).count()
    if name == "zstd":
        return read_zstd_column(spark, path).count()
    if name.startswith("records"):
        return read_records(spark, path).where(F.col("op") == OP_TIMESTAMP).count()
    return spark.read.parquet(path if name == "inline" else f"{path}/events").count()
