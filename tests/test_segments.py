"""Dictionaries of bounded segments, against a plain walk over the events."""

import random

import pytest
from pyspark.sql import functions as F

from logarc.constants import DICT_KIND
from logarc.operators.encode import encode
from logarc.operators.segments import segment_logtypes, segment_variables, with_segments
from logarc.plans import archive as archives
from logarc.plans.archive import build_archive, inline_form, read_archive, read_row_major, row_major, write_archive, write_row_major


def events(spark, n=400):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        words = [f"job={draw.choice('abcdefgh')}{draw.randint(0, 50)}x" for _ in range(draw.randint(0, 6))]
        rows.append((f"s{i % 3}", i, " ".join(["run", *words])))
    made = spark.createDataFrame(rows, "source string, seq bigint, msg string").repartition(5)
    return made.withColumn("ts", F.timestamp_seconds("seq"))


def walked(rows, variables):
    """Segment of each event, and the ids of each segment's values."""
    total, segment, first = 0, {}, {}
    for r in sorted(rows, key=lambda r: (r.source, r.seq)):
        own = [(pos, v.text) for pos, v in enumerate(r.vars) if v.kind == DICT_KIND]
        total += max(1, len(own))
        segment[r.source, r.seq] = (total - 1) // variables
        for pos, text in own:
            seen = first.setdefault((total - 1) // variables, {})
            seen[text] = min(seen.get(text, (r.seq, pos)), (r.seq, pos))
    ids = {s: {t: i for i, t in enumerate(sorted(seen, key=lambda t: (seen[t], t)))} for s, seen in first.items()}
    return segment, ids


@pytest.mark.parametrize("variables", [1, 7, 60, 10_000])
def test_segments_are_those_of_a_walk(spark, variables):
    coded = inline_form(encode(events(spark)))
    segment, ids = walked(coded.collect(), variables)
    found = with_segments(coded, variables)
    assert {(r.source, r.seq): r.segment for r in found.collect()} == segment
    entries = {}
    for r in segment_variables(found).collect():
        entries.setdefault(r.segment, {})[r.value] = r.id
    assert entries == ids
    assert {r.segment for r in segment_logtypes(found).collect()} == set(segment.values())


def test_segments_without_broadcast(spark):
    coded = inline_form(encode(events(spark)))
    rows = [{(r.source, r.seq, r.segment) for r in with_segments(coded, 9, b).collect()} for b in (0, 1 << 20)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("variables", [5, 200])
def test_compact_archives_come_back(spark, tmp_path, monkeypatch, variables):
    monkeypatch.setattr(archives, "with_segments", lambda e, broadcast_bytes: with_segments(e, variables, broadcast_bytes))
    plain = events(spark)
    wanted = sorted((r.source, r.seq, r.ts, r.msg) for r in plain.collect())

    def text(df):
        return sorted((r.source, r.seq, r.ts, r.msg) for r in df.collect())

    coded = encode(plain, mode="compact")
    for broadcast_bytes in (0, 1 << 26):
        path = str(tmp_path / f"a{broadcast_bytes}")
        written = write_archive(coded, path, compact=True, broadcast_bytes=broadcast_bytes)
        assert text(written.decode(broadcast_bytes)) == text(read_archive(spark, path).decode()) == wanted
    assert written.variables.agg(F.max("id")).first()[0] < max(variables + 6, 12)
    built = build_archive(coded, compact=True)
    payload = row_major(built, 2).select(F.max(F.octet_length("payload"))).first()[0]
    assert payload <= 8 + 2 + 4 * 6
    write_row_major(built, str(tmp_path / "rows"), id_bytes=2)
    assert text(read_row_major(spark, str(tmp_path / "rows")).decode()) == wanted


def test_ten_times_the_ids_of_one_segment(spark):
    rows = spark.range(160_000).select(F.lit("s").alias("source"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"))
    messages = rows.withColumn("msg", F.concat(F.lit("a1"), "seq", F.lit("x b1"), "seq", F.lit("y c1"), "seq", F.lit("z d1"), "seq", F.lit("w")))
    built = build_archive(encode(messages, mode="compact"), compact=True)
    top = built.variables.agg(F.count("*").alias("n"), F.max("id").alias("last"), F.max("segment").alias("s")).first()
    assert (top.n, top.s) == (640_000, 640_000 // 32768) and top.last <= 65_535
    back = built.decode()
    assert back.join(messages, ["source", "seq", "msg"]).count() == 160_000


def test_an_event_too_wide_for_any_segment_raises(spark):
    text = " ".join(f"v{i}x" for i in range(65_537))
    one = spark.createDataFrame([("s", 0, text)], "source string, seq bigint, msg string").withColumn("ts", F.timestamp_seconds("seq"))
    found = with_segments(inline_form(encode(one, mode="compact")))
    with pytest.raises(Exception, match="more than 65536 entries in one segment"):
        segment_variables(found).collect()
    with pytest.raises(Exception, match="an entry is over 65535 bytes"):
        build_archive(encode(one, mode="compact"), compact=True)


def test_long_entries_come_back_where_they_are_allowed(spark, tmp_path):
    rows = [("s", 0, "<p>" * 30_000 + " id=7x"), ("s", 1, "job=" + "w" * 70_000), ("s", 2, "job=w 3")]
    plain = spark.createDataFrame(rows, "source string, seq bigint, msg string").withColumn("ts", F.timestamp_seconds("seq"))
    coded, path = encode(plain, mode="compact"), str(tmp_path / "long")
    written = write_archive(coded, path, compact=True, long_entries=True)
    write_row_major(build_archive(coded, compact=True, long_entries=True), f"{path}-rows", id_bytes=2)
    for archive in (written, read_row_major(spark, f"{path}-rows")):
        assert sorted((r.source, r.seq, r.msg) for r in archive.decode().collect()) == rows


def test_no_events(spark):
    none = events(spark).limit(0)
    assert build_archive(encode(none, mode="compact"), compact=True).decode().collect() == []
