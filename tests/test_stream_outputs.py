"""Streams that expire, roll and are observed, against plain walks over the same events."""

import random

import pytest
from pyspark.sql import functions as F

from logarc.operators.report import compare_formats, ir_compressed_report, stored_bytes
from logarc.operators.encode import encode
from logarc.plans.archive import build_archive
from logarc.plans.formats import compare_all_formats
from logarc.sources.text_sinks import rolling_files
from logarc.streaming.records import read_expiring_literals, send_expiring_batch
from logarc.streaming.rolling import read_rolled, roll_batch

USES = "source string, op tinyint, digest binary, literal string, ts timestamp"


def uses(spark, rows):
    made = spark.createDataFrame(rows, "source string, op int, literal string, seconds bigint")
    timed = made.withColumns({"digest": F.unhex(F.sha2("literal", 256)), "ts": F.timestamp_seconds("seconds")})
    return timed.select("source", F.col("op").cast("tinyint").alias("op"), "digest", "literal", "ts")


def walked(batches, expiry):
    last, sent = {}, []
    for rows in batches:
        for source, op, literal, seconds in sorted(rows, key=lambda r: r[3] or 0):
            key, now = (source, op, literal), seconds or 0
            if key not in last or now - last[key] > expiry:
                sent.append((*key, now))
            last[key] = max(last.get(key, now), now)
    return sorted(sent)


def test_a_literal_is_sent_again_after_a_gap(spark, tmp_path):
    draw, out = random.Random(5), str(tmp_path / "out")
    batches = [[("s", 48, "hot", 10 * i) for i in range(300)], [("s", 48, "hot", 3600 * 24)]]
    batches[0] += [(draw.choice("st"), draw.choice([32, 48]), draw.choice("abc"), draw.randint(0, 20_000)) for _ in range(60)]
    batches[1] += [(draw.choice("st"), 48, draw.choice("abc"), draw.randint(0, 60_000)) for _ in range(40)]
    batches.append([("s", 48, "hot", 3600 * 24 + 60), ("s", 48, "a", None), ("s", 48, "new", None), ("t", 48, "a", 500_000)])
    for k, rows in enumerate(batches):
        send_expiring_batch(uses(spark, rows), k, out, 60_000 * 10)
    send_expiring_batch(uses(spark, batches[2]), 2, out, 60_000 * 10)  # a replay
    found = sorted((r.source, r.op, r.literal, int(r.ts.timestamp())) for r in read_expiring_literals(spark, out).collect())
    assert found == walked(batches, 600)
    assert [f for f in found if f[2] == "hot"] == [("s", 48, "hot", 0), ("s", 48, "hot", 86400)]


@pytest.mark.parametrize("max_files", [None, 3])
def test_three_batches_roll_as_one(spark, tmp_path, max_files):
    rows = [(f"s/{i % 3} é", i, "x" * (i % 37) + str(i)) for i in range(240)] + [("once", 1, "a line")]
    lines = spark.createDataFrame(rows, "source string, seq bigint, line string")
    out = str(tmp_path / "out")
    for k in range(3):
        part = lines.where(f"seq >= {80 * k} AND seq < {80 * k + 80}")
        roll_batch(part, k, out, max_bytes=200, max_files=max_files)
        if k == 1:
            roll_batch(part, k, out, max_bytes=200, max_files=max_files)
    wanted = {(r.source, r.file_no, r.line) for r in rolling_files(lines, 200, max_files).collect()}
    found = read_rolled(spark, out).collect()
    assert len(found) == len(wanted) and {(r.source, r.file_no, r.value) for r in found} == wanted
    if max_files:
        kept = {}
        for folder in (tmp_path / "out" / "files").glob("batch=*/source=*/file_no=*"):
            kept.setdefault(folder.parent.name, set()).add(folder.name)
        assert max(map(len, kept.values())) == max_files


def test_reports_give_the_bytes_that_are_stored(spark, tmp_path):
    rows = [("s", i, f"job=run{i % 9} took {i} ms") for i in range(200)]
    plain = spark.createDataFrame(rows, "source string, seq bigint, msg string").withColumn("ts", F.timestamp_seconds("seq"))
    report = {r.part: r for r in ir_compressed_report(build_archive(encode(plain)), 10_000).collect()}
    parts = [r for name, r in report.items() if name != "whole"]
    assert all(r.bytes > 0 and r.pct == r.bytes * 100 // sum(p.bytes for p in parts) for r in parts)
    assert report["whole"].ratio == round(10_000 / report["whole"].bytes, 4)
    assert report["whole"].bytes > report["logtype_dictionary"].bytes + report["variable_dictionary"].bytes
    written = {}

    def write(path):
        plain.write.parquet(path)
        written["bytes"] = sum(f.stat().st_size for f in __import__("pathlib").Path(path).glob("*.parquet"))

    sizes = compare_formats(spark, {"one": write}, lambda spark, name, path: spark.read.parquet(path).count()).first()
    assert (sizes.n_events, sizes.bytes) == (200, written["bytes"])
    formats = {r.format: r for r in compare_all_formats(plain).collect()}
    assert all(r.n_events == 200 and r.ratio == round(formats["plain"].bytes / r.bytes, 4) for r in formats.values())
    assert formats["plain"].bytes == plain.agg(F.sum(F.octet_length("msg") + 18)).first()[0]


def test_stored_bytes_are_those_of_the_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.bin").write_bytes(b"12345")
    assert stored_bytes(spark, str(tmp_path / "x")) == 5


def test_a_table_of_many_files_comes_in_three_batches_in_the_order_of_its_ids(spark, tmp_path, monkeypatch):
    """Four files, whose parts would be batches of their own: ids are those of one dictionary of all events."""
    from logarc.operators.dictionary import variable_dictionary
    from logarc.operators.encode import encode
    from logarc.plans import queries
    from logarc.plans.tables import messages

    made = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "pmod(id * 37, 400) AS user_id", "'view' AS event_type", "0.5D AS value", "'{}' AS props"
    )
    folder = str(tmp_path)
    made.repartition(4).write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(queries, "scratch_path", lambda spark, label: f"{folder}/{label}")
    found = {r.value: r.id for r in queries.streamed_dictionary(spark, folder).collect()}
    wanted = variable_dictionary(encode(messages(spark, folder, "events")))
    assert found == {r.value: r.id for r in wanted.collect()}
    queries.streamed_new_literals(spark, folder)
    assert sorted(p.name for p in (tmp_path / "stream-new").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]
