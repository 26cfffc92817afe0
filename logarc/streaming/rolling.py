"""Size-rolled text files of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import running_total
from ..session import materialize
from ..sources.text_sinks import MEGABYTE
from .batches import read_batches, run_batches, write_batch

# One row per source: bytes written so far, and where its last line begins.
STATE_SCHEMA = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("last_start", T.LongType())]
)
FILE_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("file_no", T.LongType())])


def roll_batch(
    lines: DataFrame, batch_id: int, path: str, max_bytes: int = MEGABYTE, max_files: int | None = None, codec: str = "gzip", column: str = "line"
) -> None:
    """Add one batch of ``(source, seq, line)`` to the files of its sources.

    A source's lines come in the order of ``seq``, over the batches too. The file of a line
    follows from the bytes of its source before it, as in the batch form
    (:func:`rolling_files`); those of earlier batches are kept as one number a source. With
    ``max_files`` files that have become too old are deleted. A replay writes the same again.
    """
    spark = lines.sparkSession
    size = F.octet_length(column).cast("bigint") + 1
    rows = materialize(lines.select("source", "seq", F.col(column).alias("value"), size.alias("_size")), "rolling")
    state = read_batches(spark, STATE_SCHEMA, f"{path}/state", only_batch=batch_id - 1)
    added = rows.groupBy("source").agg(F.sum("_size").alias("added"), F.max_by("_size", "seq").alias("last"))
    known = F.coalesce("bytes", F.lit(0))
    sums = materialize(added.join(state.select("source", "bytes"), "source", "left").select("source", known.alias("_before"), "added", "last"), "sums")
    last_start = F.col("_before") + F.col("added") - F.col("last")
    per_source = sums.select("source", "_before", last_start.alias("_last_start"))
    totals = running_total(rows, ["source"], "seq", F.col("_size"), "_total", per_source)

    def file_of(start):
        return F.floor(start / max_bytes).cast("bigint")

    rolled = totals.withColumn("file_no", file_of(F.col("_before") + F.col("_total") - F.col("_size")))
    if max_files is not None:
        rolled = rolled.where(F.col("file_no") > file_of(F.col("_last_start")) - max_files)
    placed = rolled.repartitionByRange("source", "file_no").sortWithinPartitions("source", "file_no", "seq")
    target = f"{path}/files/batch={batch_id}"
    placed.select("source", "file_no", "value").write.mode("overwrite").partitionBy("source", "file_no").option("compression", codec).text(target)
    after = state.join(sums.select("source", (F.col("_before") + F.col("added")).alias("total"), last_start.alias("start")), "source", "full")
    after = after.select("source", F.coalesce("total", "bytes").alias("bytes"), F.coalesce("start", "last_start").alias("last_start"))
    after = materialize(after, "rolling-state")
    write_batch(rolled.select("source", "file_no").distinct(), batch_id, f"{path}/index")
    if max_files is not None:
        _retire(spark, path, state, after, max_bytes, max_files)
    write_batch(after, batch_id, f"{path}/state")


def _retire(spark: SparkSession, path: str, before: DataFrame, after: DataFrame, max_bytes: int, max_files: int) -> None:
    """Delete files that the sources' last lines have left behind in this batch; each is ``max_bytes`` long, so they are few."""
    last = F.floor(F.col("last_start") / max_bytes) - max_files
    old = before.select("source", last.alias("_was"))
    limits = after.select("source", last.alias("_now")).join(old, "source", "left")
    index = read_batches(spark, FILE_SCHEMA, f"{path}/index", keep_batch=True)
    gone = index.join(limits, "source").where("file_no <= _now AND (_was IS NULL OR file_no > _was)")
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for row in gone.toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if row.source in (None, "") else escape(row.source)
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/files/batch={row.batch}/source={name}/file_no={row.file_no}")
        place.getFileSystem(configuration).delete(place, True)


def stream_rolling_text(
    lines: DataFrame, path: str, checkpoint: str, max_bytes: int = MEGABYTE, max_files: int | None = None, codec: str = "gzip", column: str = "line"
) -> StreamingQuery:
    """Write a stream of lines to size-rolled files until present input is written."""

    def add(batch: DataFrame, batch_id: int) -> None:
        roll_batch(batch, batch_id, path, max_bytes, max_files, codec, column)

    return run_batches(lines, checkpoint, add)


def read_rolled(spark: SparkSession, path: str) -> DataFrame:
    """``(source, file_no, value)`` of the files that are left."""
    stored = "value string, batch bigint, source string, file_no bigint"
    return spark.read.schema(stored).text(f"{path}/files", lineSep="\n").select("source", "file_no", "value")
