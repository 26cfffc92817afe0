"""Size reports, template statistics and throughput."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .dictionary import distinct_values, variable_occurrences


def _dictionary_size(values: DataFrame, prefix_bytes: int, name: str) -> DataFrame:
    return values.agg(
        F.coalesce(F.sum(F.octet_length("value").cast("bigint") + prefix_bytes), F.lit(0)).alias(f"{name}_dict_bytes"),
        F.count("*").alias(f"{name}s"),
    )


def ir_size_report(encoded: DataFrame, original_bytes: Column | int, prefix_bytes: int = 1) -> DataFrame:
    """One row: bytes of each part of the columnar form, shares and ratios.

    Times take 8 bytes, variables 8, logtype ids 2 (least) to 8 (most). A
    ``prefix_bytes`` of 1 counts dictionary entries as the size report of the
    original format does; 2 is what its dictionary files hold. ``encoded`` is
    read three times: pass a written table.
    """
    original = F.lit(original_bytes) if isinstance(original_bytes, int) else original_bytes
    columns = encoded.agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum(F.size("vars")), F.lit(0)).alias("variables_total"),
        original.cast("bigint").alias("original_bytes"),
    )
    logtypes = _dictionary_size(
        encoded.select(F.col("logtype").alias("value")).distinct(), prefix_bytes, "logtype"
    )
    variables = _dictionary_size(distinct_values(variable_occurrences(encoded)), prefix_bytes, "variable")
    rows = columns.unionByName(logtypes, True).unionByName(variables, True)
    sized = rows.agg(*[F.max(name).alias(name) for name in rows.columns]).withColumns(
        {
            "ts_bytes": F.col("events") * 8,
            "logtype_bytes_2": F.col("events") * 2,
            "logtype_bytes_4": F.col("events") * 4,
            "logtype_bytes_8": F.col("events") * 8,
            "var_bytes": F.col("variables_total") * 8,
        }
    )
    fixed = F.col("logtype_dict_bytes") + F.col("variable_dict_bytes") + F.col("ts_bytes") + F.col("var_bytes")
    totals = sized.withColumns(
        {"min_bytes": fixed + F.col("logtype_bytes_2"), "max_bytes": fixed + F.col("logtype_bytes_8")}
    )

    def share(part: str, whole: str) -> Column:
        return F.floor(F.col(part) * 100 / F.col(whole)).cast("bigint")

    return totals.withColumns(
        {
            "logtype_dict_pct": share("logtype_dict_bytes", "min_bytes"),
            "variable_dict_pct": share("variable_dict_bytes", "min_bytes"),
            "ts_pct": share("ts_bytes", "min_bytes"),
            "logtype_2_pct": share("logtype_bytes_2", "min_bytes"),
            "logtype_8_pct": share("logtype_bytes_8", "max_bytes"),
            "var_pct": share("var_bytes", "min_bytes"),
            "ratio_max": F.round(F.col("original_bytes") / F.col("min_bytes"), 4),
            "ratio_min": F.round(F.col("original_bytes") / F.col("max_bytes"), 4),
        }
    )


def logtype_stats(encoded: DataFrame) -> DataFrame:
    """Per template: events, variables per event, first and last time."""
    return encoded.groupBy("logtype").agg(
        F.count("*").alias("events"),
        F.max(F.size("vars")).cast("bigint").alias("variables"),
        F.min(F.unix_millis("ts")).alias("first_ms"),
        F.max(F.unix_millis("ts")).alias("last_ms"),
    )


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the data files below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first().bytes


def ir_compressed_report(archive, original_bytes: int, codec: str = "zstd", level: int = 3) -> DataFrame:
    """Rows and compressed size of each part of an archive and of the whole bundle, with shares and the total ratio.

    The events are sorted and written once, as the bundle; each column is then
    copied from there, in that order. ``pct`` is the share of the sum of the parts.
    """
    from ..plans.archive import codec_options

    spark, options, order = archive.events.sparkSession, codec_options(codec, level), ["source", "seq"]
    root = scratch_path(spark, "compressed")
    events = archive.events.repartitionByRange(*order).sortWithinPartitions(*order)
    bundle = {
        "events": events.select("ts", "logtype_id", "vars"),
        "logtypes": archive.logtypes.select("value"),
        "variables": archive.variables.select("value"),
    }
    for name, table in bundle.items():
        table.write.options(**options).parquet(f"{root}/whole/{name}")
    columns = {"timestamps": "ts", "logtype_ids": "logtype_id", "variables": "vars"}
    for name, column in columns.items():
        spark.read.parquet(f"{root}/whole/events").select(column).write.options(**options).parquet(f"{root}/{name}")
    places = {
        "logtype_dictionary": f"{root}/whole/logtypes",
        "variable_dictionary": f"{root}/whole/variables",
        **{name: f"{root}/{name}" for name in columns},
    }
    sizes = [(name, spark.read.parquet(path).count(), stored_bytes(spark, path)) for name, path in places.items()]
    total = sum(size for _, _, size in sizes)
    whole = ("whole", spark.read.parquet(f"{root}/whole/events").count(), stored_bytes(spark, f"{root}/whole"))
    report = spark.createDataFrame([*sizes, whole], "part string, n_rows bigint, bytes bigint")
    return report.withColumns(
        {
            "pct": F.when(F.col("part") != "whole", F.floor(F.col("bytes") * 100 / F.lit(max(total, 1))).cast("bigint")),
            "ratio": F.when(F.col("part") == "whole", F.round(F.lit(original_bytes) / F.col("bytes"), 4)),
        }
    )


def compare_formats(
    spark: SparkSession, writers: dict[str, Callable[[str], None]], count: Callable[[SparkSession, str, str], int]
) -> DataFrame:
    """Run each writer into its own folder: events found in it, bytes and seconds per format."""
    root = scratch_path(spark, "formats")
    rows = []
    for name, write in writers.items():
        begin = time.monotonic()
        write(f"{root}/{name}")
        seconds = time.monotonic() - begin
        path = f"{root}/{name}"
        rows.append((name, count(spark, name, path), stored_bytes(spark, path), seconds))
    return spark.createDataFrame(rows, "format string, n_events bigint, bytes bigint, seconds double")


def throughput(df: DataFrame, events: int) -> dict[str, float]:
    """Seconds and events per second of computing every column of a DataFrame."""
    begin = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    seconds = time.monotonic() - begin
    return {"seconds": seconds, "events_per_second": events / seconds}
