from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logarc.operators.ordering import dense_ids, running_total
from logarc.sources.logs import parse_lines_fixed, parse_logs, read_log_lines
from logarc.sources.synthetic import synthetic_columns, synthetic_logs
from logarc.sources.text_sinks import (
    read_text,
    read_zstd_column,
    rolling_files,
    write_gzip_text,
    write_plain_text,
    write_rolling_text,
    write_zstd_column,
)

MULTI_LINE = "21/10/11 06:15:00 INFO X: line 0\n\tat foo.Bar\n\tat baz.Q\n21/10/11 16:15:01 INFO X: line 1  \n"


def test_multi_line_events(spark, tmp_path):
    (tmp_path / "a.log").write_text(MULTI_LINE)
    rows = parse_logs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.msg) for r in rows] == [
        (0, " INFO X: line 0\n\tat foo.Bar\n\tat baz.Q"),
        (1, " INFO X: line 1"),
    ]
    assert rows[1].ts == datetime(2021, 10, 11, 16, 15, 1)
    assert parse_logs(spark, str(tmp_path), strip=False).where("seq = 1").first().msg == " INFO X: line 1  "
    fixed = parse_lines_fixed(spark, str(tmp_path)).collect()
    assert len(fixed) == 4 and sum(r.ts is None for r in fixed) == 2


def test_events_across_many_splits(spark, tmp_path):
    lines = ["lost line", "another"]
    expected = []
    for i in range(300):
        lines.append(f"21/10/11 06:{i // 60:02d}:{i % 60:02d} INFO N: event {i}")
        extra = [f"\tat frame {i}.{j} " + "x" * 30 for j in range(40 if i % 50 == 7 else i % 3)]
        lines += extra
        expected.append("\n".join([f" INFO N: event {i}", *extra]))
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("no event at all\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert read_log_lines(spark, str(tmp_path)).select("block").distinct().count() > 20
        got = parse_logs(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    events, leading = [r for r in got if r.seq >= 0], [r for r in got if r.seq < 0]
    assert [r.seq for r in events] == list(range(300))
    assert [r.msg for r in events] == expected
    assert sorted((r.source[-5:], r.msg, r.ts) for r in leading) == [
        ("a.log", "another", None), ("a.log", "lost line", None), ("b.log", "no event at all", None)
    ]
    assert [r.msg for r in leading if r.source.endswith("a.log")] == ["lost line", "another"]
    whole = parse_logs(spark, str(tmp_path), whole_files=True).orderBy("seq").collect()
    assert sorted((r.source, r.seq, str(r.ts), r.msg) for r in whole) == sorted((r.source, r.seq, str(r.ts), r.msg) for r in got)


def test_dense_ids_and_running_total(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("hot").alias("source"))
    rows = dense_ids(df, ["k"], start=3).collect()
    assert all(r.id == r.k + 3 for r in rows) and len(rows) == 5000
    wide = spark.range(3000).select(F.lit("hot").alias("source"), (F.col("id") * 40_000_000).alias("seq"))
    sums = running_total(wide, ["source"], "seq", F.lit(2), "total").collect()
    assert all(r.total == 2 * (r.seq // 40_000_000 + 1) for r in sums)


def test_text_sinks(spark, tmp_path):
    lines = spark.range(200).select(F.lit("s").alias("source"), F.col("id").alias("seq"), F.concat(F.lit("line "), "id").alias("line"))
    for name, write in (("none", write_plain_text), ("gzip", write_gzip_text)):
        write(lines, str(tmp_path / name))
        assert read_text(spark, str(tmp_path / name)).count() == 200
    write_zstd_column(lines, str(tmp_path / "zstd"))
    assert read_zstd_column(spark, str(tmp_path / "zstd")).count() == 200
    expected, written, number = {}, 0, 0
    for i in range(200):
        expected[i] = written // 500
        written += len(f"line {i}") + 1
    assert {r.seq: r.file_no for r in rolling_files(lines, 500).collect()} == expected
    write_rolling_text(lines, str(tmp_path / "roll"), 500, max_files=2)
    kept = spark.read.text(str(tmp_path / "roll"))
    assert kept.select("file_no").distinct().count() == 2
    newest = max(expected.values())
    assert kept.count() == sum(n > newest - 2 for n in expected.values())


@pytest.mark.parametrize("n", [1, 1500])
def test_synthetic(spark, n):
    last = synthetic_logs(spark, n).orderBy(F.desc("id")).first()
    i = n - 1
    assert last.msg.endswith(f"per line: app-20201119{i % 1000}-{i % 20000} from spark-node-{i % 1000}")
    row = synthetic_columns(spark, n, 3).orderBy(F.desc("ts")).first()
    assert (row.ts, row.logtype, row.vars) == (i, i, [3 * i, 3 * i + 1, 3 * i + 2])
