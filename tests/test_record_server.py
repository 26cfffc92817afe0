"""Records taken in batch by batch: whole events only, literals before or after their references."""

import random

import pytest
from pyspark.sql import functions as F

from logarc.constants import DEDUP_MODES
from logarc.functions.digests import digest
from logarc.operators.encode import encode
from logarc.operators.records import RECORD_SCHEMA, dedup_records, ordered_records, to_records
from logarc.plans.archive import build_archive
from logarc.sources.records import read_records, stream_records, write_records
from logarc.streaming.archive import (
    append_archive,
    append_batch,
    open_records,
    read_stream_archive,
    serve_batch,
    stream_records_archive,
)
from logarc.streaming.dictionary import read_stream_dictionary, upsert_batch
from logarc.streaming.grown import GrownTable, prefixes


def events(spark, n=60, sources=("a", "b")):
    rows = []
    for i in range(n):
        source = sources[i % len(sources)]
        message = f"job=run{i % 7} on host{i % 5}x took {i}.5 s" if i % 9 else "" if i % 2 else "host1x"
        rows.append((source, i, message))
    made = spark.createDataFrame(rows, "source string, seq bigint, msg string")
    return made.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))


def text(rows):
    return sorted((r.source, r.seq, r.ts, r.msg) for r in rows)


@pytest.mark.parametrize("mode", ["separate"])  # the registered queries take all modes
def test_written_files_one_a_batch_give_the_plain_input(spark, tmp_path, mode):
    plain = events(spark)
    path, out = str(tmp_path / "records"), str(tmp_path / "out")
    write_records(to_records(encode(plain)), path, mode, files=3)
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
    whole = stored.groupBy("source", "seq").agg(F.count_distinct("file").alias("n"))
    assert whole.where("n > 1").count() == 0
    stream_records_archive(stream_records(spark, path, files_per_batch=1), out, str(tmp_path / "progress")).awaitTermination()
    archive = read_stream_archive(spark, out)
    assert archive.events.inputFiles() and len({f.split("batch=")[1][0] for f in archive.events.inputFiles()}) == 3
    assert text(archive.decode().collect()) == text(plain.collect())
    assert open_records(spark, out).count() == 0
    wanted = build_archive(encode(plain))
    for name in ("logtypes", "variables"):
        counts = {r.value: r.n for r in getattr(archive, name).collect()}
        assert counts == {r.value: r.n for r in getattr(wanted, name).collect()}


@pytest.mark.parametrize("mode", DEDUP_MODES)
def test_events_cut_at_every_record(spark, tmp_path, mode):
    plain = events(spark, 24)
    records = dedup_records(to_records(encode(plain)), mode).collect()
    random.Random(3).shuffle(records)  # references before their literals, timestamps before the rest
    out, seen = str(tmp_path / "out"), set()
    size = -(-len(records) // 3)
    for batch_id in range(3):
        part = spark.createDataFrame(records[batch_id * size : (batch_id + 1) * size], RECORD_SCHEMA)
        serve_batch(part, batch_id, out)
        if batch_id == 1 and mode == "separate":  # a replay changes nothing
            serve_batch(part, batch_id, out)
        now = {(r.source, r.seq) for r in read_stream_archive(spark, out).events.collect()}
        assert seen <= now
        seen = now
        waiting = {(r.source, r.seq) for r in open_records(spark, out).collect()}
        assert not waiting & now
    assert text(read_stream_archive(spark, out).decode().collect()) == text(plain.collect())
    assert open_records(spark, out).count() == 0


def test_what_never_becomes_whole_stays_open(spark, tmp_path):
    plain, out = events(spark, 10), str(tmp_path / "out")
    records = dedup_records(to_records(encode(plain)), "separate")
    lost = records.where("literal IS NOT NULL AND op = 32").orderBy("seq").first()
    without = records.where(~((F.col("seq") == lost.seq) & (F.col("pos") == lost.pos)))
    serve_batch(without.where("NOT (seq = 9 AND op = 16)"), 0, out)
    waiting = {r.seq for r in open_records(spark, out).collect()}
    assert {lost.seq, 9} <= waiting
    assert not waiting & {r.seq for r in read_stream_archive(spark, out).events.collect()}
    rest = records.where(((F.col("seq") == lost.seq) & (F.col("pos") == lost.pos)) | F.expr("seq = 9 AND op = 16"))
    serve_batch(rest, 1, out)
    assert open_records(spark, out).count() == 0
    assert text(read_stream_archive(spark, out).decode().collect()) == text(plain.collect())


def test_more_records_than_places_raise(spark, tmp_path):
    records = to_records(encode(events(spark, 4)))
    with pytest.raises(Exception, match="more records than places"):
        serve_batch(records.unionByName(records.where("seq = 2 AND pos = 0")), 0, str(tmp_path / "out"))


def test_clashing_places_leave_the_archive_readable(spark, tmp_path):
    out, plain = str(tmp_path / "out"), events(spark, 40)
    append_archive(encode(plain.where("seq < 20")), out)
    append_archive(encode(plain.where("seq >= 30")), out)
    before = text(read_stream_archive(spark, out).decode().collect())
    with pytest.raises(ValueError, match="already has an event at"):
        append_archive(encode(plain.where("seq BETWEEN 19 AND 25")), out)
    twice = plain.where("seq BETWEEN 20 AND 22")
    with pytest.raises(Exception, match="two events of the batch"):
        append_archive(encode(twice.unionByName(twice)), out)
    archive = read_stream_archive(spark, out)
    assert text(archive.decode().collect()) == before
    assert append_archive(encode(plain.where("seq BETWEEN 20 AND 29")), out) == 2  # between the ranges of both
    assert text(read_stream_archive(spark, out).decode().collect()) == text(plain.collect())
    append_batch(encode(plain.where("seq BETWEEN 20 AND 29")), 2, out)
    assert text(read_stream_archive(spark, out).decode().collect()) == text(plain.collect())


def values(spark, names):
    rows = [(name, i) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "value string, first bigint").withColumn("first", F.col("first").cast("decimal(38,0)"))


def test_a_batch_reads_what_follows_from_its_own_values(spark, tmp_path, monkeypatch):
    """Twenty batches of eight values each after a large first one: files read don't grow with the history."""
    monkeypatch.setattr("logarc.streaming.grown.BUCKET_ROWS", 64)
    monkeypatch.setattr(GrownTable.__init__, "__defaults__", (None, 64))
    path, rows_read = str(tmp_path / "dict"), []
    original = GrownTable.read

    def counting(self, version, wanted=None):
        found = original(self, version, wanted)
        if wanted is not None:
            rows_read.append(found.count())
        return found

    monkeypatch.setattr(GrownTable, "read", counting)
    upsert_batch(values(spark, [f"first{i}" for i in range(20_000)]), 0, path)
    for batch in range(1, 21):
        upsert_batch(values(spark, [f"new{batch}-{i}" for i in range(6)] + ["first7", f"new{batch - 1}-0"]), batch, path)
    assert rows_read[0] == 0
    # at most a bucket of the large part for each value, and the small parts
    assert max(rows_read[1:]) <= 8 * 2 * 64 + 8 * 8 * 3
    monkeypatch.setattr(GrownTable, "read", original)
    known = read_stream_dictionary(spark, path).collect()
    ids = {r.value: r.id for r in known}
    assert len(known) == 20_000 + 120 + 1 and sorted(ids.values()) == list(range(len(ids)))
    assert ids["first7"] == 7 and ids["new1-0"] == 20_000
    counts = {r.value: r.n for r in known}
    assert counts["first7"] == 21 and counts["new3-0"] == 2 and counts["new3-1"] == 1
    table = GrownTable(spark, f"{path}/entries", known and spark.createDataFrame([], "id bigint, value string").schema, digest(F.col("value")))
    assert len(table.version().parts) < 10 and len(table.batches()) == 3
    folders = {f.split("/parts/")[1].split("/")[0] for f in table.read(table.version()).inputFiles()}
    assert folders == {p["name"] for p in table.version().parts}


def test_a_replay_after_a_merge_gives_the_same_table(spark, tmp_path):
    path = str(tmp_path / "dict")
    for batch in range(9):
        upsert_batch(values(spark, [f"v{batch}", "same"]), batch, path)
    before = sorted(map(str, read_stream_dictionary(spark, path).collect()))
    upsert_batch(values(spark, ["v8", "same"]), 8, path)
    upsert_batch(values(spark, ["v7", "same"]), 7, path)
    upsert_batch(values(spark, ["v8", "same"]), 8, path)
    assert sorted(map(str, read_stream_dictionary(spark, path).collect())) == before


def test_prefixes_are_few(spark):
    rows = values(spark, [f"x{i}" for i in range(9000)]).withColumn("digest", digest(F.col("value")))
    found = prefixes(rows)
    assert len(found) == len(set(found)) <= 4096 and min(found) >= 0 and max(found) < 4096


def test_records_read_back(spark, tmp_path):
    path = str(tmp_path / "records")
    write_records(to_records(encode(events(spark, 5))), path, "none")
    assert read_records(spark, path).schema == RECORD_SCHEMA


@pytest.mark.parametrize("mode", ["shared", "separate", "marked"])
def test_written_records_are_shuffled_once(spark, mode):
    records = to_records(encode(events(spark, 40))).localCheckpoint()
    ordered = ordered_records(records, mode)
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, ordered.collect())) == sorted(map(str, dedup_records(records, mode).collect()))
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
