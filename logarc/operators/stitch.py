"""From lines to events: multi-line messages, timestamps, trailing space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LINE_HEAD, LINE_HEAD_CHARS, LINE_TIME_FORMAT
from ..session import materialize


# Lines in front of a file's first event are numbered from here, by their place in the file.
LEADING = -(1 << 62)


def stitch_events(lines: DataFrame, head_regex: str = LINE_HEAD) -> DataFrame:
    """Append each line that has no timestamp head to the event before it.

    ``lines`` is ``(file_path, block, mid, value)``: ``block`` is the start of
    the file split, ``mid`` increases along the lines of one split. Returns
    ``(source, seq, value)`` with ``seq`` counting the events of a file from 0.

    Lines are put in order per split, so a file of any size is spread over as
    many tasks as it has splits. They are read, sorted and gathered once and
    written; a split's first event number then comes from one row per split, and
    only the last event of a split and the loose lines at the start of the next
    ones are joined across splits. Lines in front of the first event of a file
    belong to none: each stays a row of its own, with a negative ``seq``.
    """
    headed = lines.withColumn("_head", F.col("value").rlike(r"\A" + head_regex).cast("int"))
    split = Window.partitionBy("file_path", "block").orderBy("mid")
    so_far = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = headed.withColumns({"_event": F.sum("_head").over(so_far), "_line": F.count("*").over(so_far)})
    # Lines that stand before the first head of their split may belong to no event, so they aren't gathered yet.
    loose = F.when(F.col("_event") == 0, F.col("_line"))
    gathered = (
        numbered.withColumn("_loose", loose)
        .groupBy("file_path", "block", "_event", "_loose")
        .agg(F.sort_array(F.collect_list(F.struct("mid", "value"))).alias("_lines"))
    )
    text = F.array_join(F.transform("_lines", lambda line: line["value"]), "\n")
    pieces = materialize(gathered.select("file_path", "block", "_event", "_loose", text.alias("value")), "pieces")
    splits = pieces.groupBy("file_path", "block").agg(F.max("_event").alias("_heads"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_heads").over(earlier), F.lit(0)))
    placed = pieces.join(splits, ["file_path", "block"]).select(
        F.col("file_path").alias("source"),
        # Loose lines have event number 0 in their split: the last one before it.
        (F.col("_base") + F.col("_event") - 1).alias("seq"),
        "block",
        "_loose",
        "value",
        ((F.col("_event") == 0) | (F.col("_event") == F.col("_heads"))).alias("_edge"),
    )
    # A line takes a byte at least, so block + number is in the order of the file and names one line.
    leading = placed.where("seq < 0").select("source", (F.lit(LEADING) + F.col("block") + F.col("_loose")).alias("seq"), "value")
    inner = placed.where(~F.col("_edge")).select("source", "seq", "value")
    edges = (
        placed.where(F.col("_edge") & (F.col("seq") >= 0))
        .groupBy("source", "seq")
        .agg(F.sort_array(F.collect_list(F.struct("block", "_loose", "value"))).alias("_pieces"))
        .select("source", "seq", F.array_join(F.transform("_pieces", lambda p: p["value"]), "\n").alias("value"))
    )
    return inner.unionByName(edges).unionByName(leading)


def strip_trailing(message: Column) -> Column:
    """The message without the white space at its end."""
    return F.regexp_replace(message, r"\p{javaWhitespace}++\z", "")


def split_timestamp(
    df: DataFrame, ts_format: str = LINE_TIME_FORMAT, width: int = LINE_HEAD_CHARS, value: str = "value"
) -> DataFrame:
    """Replace ``value`` by ``ts`` and ``msg``; a bad timestamp gives NULL.

    ``msg`` keeps the space after the timestamp.
    """
    text = F.col(value)
    ts = F.try_to_timestamp(F.substr(text, F.lit(1), F.lit(width)), F.lit(ts_format))
    if ts_format == LINE_TIME_FORMAT:
        # A failing parse costs an exception; lines of a stack trace never get that far.
        ts = F.when(text.rlike(r"\A" + LINE_HEAD), ts)
    return df.withColumns(
        {
            "ts": ts,
            "msg": F.substr(text, F.lit(width + 1)),
        }
    ).drop(value)


def split_file_text(text: Column, head_regex: str = LINE_HEAD) -> Column:
    """Events of a whole file's text: an array of ``(seq, value)``, numbered as :func:`stitch_events` does."""
    pieces = F.split(text, r"(?md)(?=^" + head_regex + ")")

    def whole(piece: Column) -> Column:
        return F.regexp_replace(piece, r"\n\z", "")

    events = F.filter(pieces, lambda piece: piece.rlike(r"\A" + head_regex))
    numbered = F.transform(events, lambda e, i: F.struct(i.cast("bigint").alias("seq"), whole(e).alias("value")))
    first = F.filter(pieces, lambda piece, i: (i == 0) & (piece != "") & ~piece.rlike(r"\A" + head_regex))
    lines = F.flatten(F.transform(first, lambda piece: F.split(whole(piece), "\n", -1)))
    leading = F.transform(lines, lambda line, i: F.struct((F.lit(LEADING) + i + 1).alias("seq"), line.alias("value")))
    return F.concat(leading, numbered)
