"""Times the headline jobs; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logarc.operators.decode import decode_encoded
from logarc.operators.encode import encode
from logarc.plans.archive import read_archive, write_archive, write_inline
from logarc.plans.formats import compare_all_formats
from logarc.plans.queries import QUERIES
from logarc.plans.tables import messages
from logarc.session import configure, scratch_path
from logarc.sources.synthetic import synthetic_logs

HEADLINE = [
    "template_counts",
    "tokenize_documents",
    "encode_documents",
    "encode_events",
    "logtype_pages",
    "stitch_events",
    "parse_logs",
    "logtype_dictionary",
    "variable_dictionary",
    "lookup_ids",
    "upsert_dictionary",
    "archive_columns",
    "archive_columns_documents",
    "decode_roundtrip_documents",
    "decode_roundtrip_events",
    "inline_roundtrip",
    "row_major_payload",
    "records_separate",
    "records_to_archive",
    "record_bytes_separate",
    "ir_size_report",
    "logtype_stats",
    "rolling_files",
    "decode_decimals64",
    "stream_encode",
    "stream_dictionary",
]
SYNTHETIC_MESSAGES = 10_000_000


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(job) -> float:
    begin = time.monotonic()
    job()
    return time.monotonic() - begin


def rates(spark: SparkSession, folder: str) -> dict[str, float]:
    """Events per second of the main steps, on the events table and on synthetic messages."""
    rows = messages(spark, folder, "events")
    n = rows.count()
    path = scratch_path(spark, "bench")
    out = {"encode_events": n / seconds(lambda: run(encode(rows)))}
    out["write_archive_events"] = n / seconds(lambda: write_archive(encode(rows), f"{path}/columnar"))
    out["decode_archive_events"] = n / seconds(lambda: run(read_archive(spark, f"{path}/columnar").decode()))
    made = synthetic_logs(spark, SYNTHETIC_MESSAGES)
    coded = encode(made)
    out["encode_synthetic"] = SYNTHETIC_MESSAGES / seconds(lambda: run(coded))
    out["write_inline_synthetic"] = SYNTHETIC_MESSAGES / seconds(lambda: write_inline(coded, f"{path}/inline"))
    stored = spark.read.parquet(f"{path}/inline")
    out["decode_inline_synthetic"] = SYNTHETIC_MESSAGES / seconds(lambda: run(decode_encoded(stored)))
    return {name: round(rate) for name, rate in out.items()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logarc-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    names = sys.argv[1:] or HEADLINE
    run(QUERIES["template_counts"](spark, folder))
    times = {}
    for name in names:
        times[name] = round(seconds(lambda name=name: run(QUERIES[name](spark, folder))), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
    }
    if not sys.argv[1:]:
        result["events_per_second"] = rates(spark, folder)
        sizes = compare_all_formats(messages(spark, folder, "events")).orderBy(F.desc("bytes")).collect()
        result["bytes_per_format"] = {row.format: row.bytes for row in sizes}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
