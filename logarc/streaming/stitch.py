"""Line-wise stitching of logs that arrive piece by piece.

The lines of a log come in files, its pieces, over any number of batches. What a later piece
may still add to is kept: the last event of each log. All others are written at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..constants import LINE_HEAD, LINE_TIME_FORMAT
from ..operators.stitch import LEADING, stitch_events
from ..session import materialize
from ..sources.logs import finish_events
from .batches import read_batches, run_batches, write_batch

# The log's name, then numbers that order its pieces: "app.log.7" is piece 7 of "app.log".
PIECE = r"^(.*)\.([0-9]+)$"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("msg", T.StringType()),
    ]
)
# One row per log: the piece read last, events and leading lines so far, and the text of the last event.
STATE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("piece", T.ArrayType(T.LongType())),
        T.StructField("events", T.LongType()),
        T.StructField("leading", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of new text files: ``(file_path, block, value)``."""
    lines = spark.readStream.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), "value")


def stitch_batch(
    lines: DataFrame, batch_id: int, path: str, pieces: str = PIECE, strip: bool = True, ts_format: str = LINE_TIME_FORMAT, head_regex: str = LINE_HEAD
) -> None:
    """Add the files of one batch to the logs they are pieces of.

    Each file is stitched by its splits as in batch (:func:`stitch_events`). Lines in front of
    its first event continue the last event of the piece before it, in this batch or an
    earlier one. Pieces of one batch may come in any order; one that comes after a later
    piece was read raises an error. A replay writes the same again.
    """
    spark = lines.sparkSession
    # Row order in a split is file order, so the numbers are given right on the scan.
    numbered = lines.select("file_path", "block", F.monotonically_increasing_id().alias("mid"), "value")
    found = stitch_events(numbered, head_regex).withColumnRenamed("source", "file")
    groups = pieces.count("(") - pieces.count(r"\(") - pieces.count("(?")
    number = [F.regexp_extract("file", pieces, i).try_cast("bigint") for i in range(2, groups + 1)]
    named = F.col("file").rlike(pieces)
    found = found.withColumns(
        {
            "source": F.when(named, F.regexp_extract("file", pieces, 1)).otherwise(F.col("file")),
            "piece": F.when(named, F.array(*number)).otherwise(F.array(F.lit(0).cast("bigint"))),
        }
    )
    found = materialize(found, "piece-events")
    state = read_batches(spark, STATE_SCHEMA, f"{path}/state", only_batch=batch_id - 1)
    state = state.select("source", F.col("piece").alias("last"), "events", "leading", "text")
    files = found.groupBy("source", "piece", "file").agg(F.count_if(F.col("seq") >= 0).alias("n"), F.count_if(F.col("seq") < 0).alias("loose"))
    earlier = Window.partitionBy("source").orderBy("piece", "file").rowsBetween(Window.unboundedPreceding, -1)
    late = F.raise_error(F.concat(F.lit("a later piece was read before "), "file")).cast("bigint")

    def before(column: str) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    base = F.coalesce("events", F.lit(0)) + before("n")
    files = files.join(state, "source", "left")
    files = files.select(
        *["source", "piece", "file", "n", "loose"],
        F.when(F.col("piece") <= F.col("last"), late).otherwise(base).alias("base"),
        # Lines that belong to no event are numbered on through the pieces, until the log's first event.
        (F.coalesce("leading", F.lit(0)) + before("loose")).alias("skipped"),
    )
    files = materialize(files, "piece-files")
    rows = found.join(files.select("file", "base", "skipped", "n"), "file")
    own_line = F.col("seq") - F.lit(LEADING)
    placed = rows.select(
        "source",
        F.when(F.col("seq") >= 0, F.col("base") + F.col("seq")).when(F.col("base") > 0, F.col("base") - 1).alias("seq"),
        (F.lit(LEADING) + F.col("skipped") + own_line).alias("lead"),
        "piece",
        "file",
        F.when(F.col("seq") < 0, own_line).otherwise(-1).alias("line"),
        "value",
        ((F.col("seq") < 0) | (F.col("seq") == F.col("n") - 1)).alias("edge"),
    )
    placed = materialize(placed, "piece-places")
    nothing = F.lit(None)
    opened = state.where("text IS NOT NULL").select(
        "source", (F.col("events") - 1).alias("seq"), nothing.cast("array<bigint>").alias("piece"), nothing.cast("string").alias("file"), F.lit(-2).cast("bigint").alias("line"), F.col("text").alias("value")
    )
    # Only what may be continued is gathered: the last event of a file and the lines in front of the next one's first.
    edges = placed.where("edge AND seq IS NOT NULL").select(*opened.columns).unionByName(opened)
    order = F.struct(F.col("piece").isNotNull().alias("later"), F.coalesce("piece", F.array().cast("array<bigint>")).alias("piece"), "file", "line", "value")
    gathered = edges.groupBy("source", "seq").agg(F.sort_array(F.collect_list(order)).alias("parts"))
    joined = gathered.select("source", "seq", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    joined = materialize(joined, "piece-edges")
    totals = files.groupBy("source").agg(F.max("piece").alias("seen"), F.max(F.col("base") + F.col("n")).alias("total"), F.sum("loose").alias("more"))
    after = state.join(totals, "source", "full").select(
        "source",
        F.coalesce("seen", "last").alias("piece"),
        F.coalesce("total", "events").alias("events"),
        # Once a log has events, such lines are theirs; only those before count on.
        F.when(F.coalesce("events", F.lit(0)) > 0, F.col("leading")).otherwise(F.coalesce("leading", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("leading"),
    )
    last = joined.withColumnRenamed("value", "text").withColumn("events", F.col("seq") + 1).drop("seq")
    after = materialize(after.join(last, ["source", "events"], "left").select(*STATE_SCHEMA.fieldNames()), "piece-state")
    done = joined.join(after.select("source", "events"), "source").where("seq < events - 1").drop("events")
    lead = placed.where("seq IS NULL").select("source", F.col("lead").alias("seq"), "value")
    inner = placed.where("NOT edge").select("source", "seq", "value")
    events = finish_events(inner.unionByName(done).unionByName(lead), strip, ts_format)
    write_batch(events.select(*EVENT_SCHEMA.fieldNames()), batch_id, f"{path}/events")
    write_batch(after, batch_id, f"{path}/state")


def stream_stitch(lines: DataFrame, path: str, checkpoint: str, pieces: str = PIECE, strip: bool = True, ts_format: str = LINE_TIME_FORMAT) -> StreamingQuery:
    """Stitch a stream of lines until present input is read; run it again as more pieces arrive."""

    def add(batch: DataFrame, batch_id: int) -> None:
        stitch_batch(batch, batch_id, path, pieces, strip, ts_format)

    return run_batches(lines, checkpoint, add)


def read_stitched(spark: SparkSession, path: str, strip: bool = True, ts_format: str = LINE_TIME_FORMAT) -> tuple[DataFrame, DataFrame]:
    """``(source, seq, ts, msg)`` of the events that are finished, and of the last event of each log, which is still open."""
    state = read_batches(spark, STATE_SCHEMA, f"{path}/state", keep_batch=True)
    newest = state.agg(F.max("batch").alias("batch")).first().batch
    state = state.where(F.col("batch") == F.lit(newest)).where("text IS NOT NULL")
    opened = state.select("source", (F.col("events") - 1).alias("seq"), F.col("text").alias("value"))
    return read_batches(spark, EVENT_SCHEMA, f"{path}/events"), finish_events(opened, strip, ts_format).select(*EVENT_SCHEMA.fieldNames())
