import pytest
from pyspark.sql import functions as F

from logarc.operators.dictionary import check_compact, export_dictionary, logtype_dictionary, lookup_ids, upsert_dictionary, variable_dictionary
from logarc.operators.encode import encode
from logarc.operators.lookup import lookup
from logarc.operators.records import dedup_records, merge_sources, record_bytes, record_marker, records_to_archive, to_records
from logarc.operators.report import ir_size_report, throughput
from logarc.operators.decode import decode_encoded
from logarc.plans.archive import build_archive, codec_options, read_archive, row_major, write_archive
from logarc.session import materialize


@pytest.fixture(scope="module")
def events(spark):
    """Mostly one template and one value, from one source; messages of all kinds in between."""
    i = F.col("id")
    message = (
        F.when(i % 3 != 0, F.lit("job=main took 12 ms"))
        .when(i % 5 == 0, F.concat(F.lit("node-"), i.cast("string"), F.lit(" at 0.5 up")))
        .otherwise(F.concat(F.lit("start user=u"), (i % 50).cast("string"), F.lit(" x "), i.cast("string")))
    )
    rows = spark.range(3000).select(
        F.when(i % 10 == 0, "rare").otherwise("hot").alias("source"), i.alias("seq"), F.timestamp_millis(i * 1000 + 7).alias("ts"), message.alias("msg")
    )
    return materialize(rows, "events")


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 26])
@pytest.mark.parametrize("compact", [False, True])
def test_round_trip(spark, events, tmp_path, compact, broadcast_bytes):
    coded = encode(events, mode="compact" if compact else "standard")
    archive = write_archive(coded, str(tmp_path / "a"), compact, level=0, by_date=True, broadcast_bytes=broadcast_bytes)
    assert dict(archive.events.dtypes)["vars"] == ("array<int>" if compact else "array<bigint>")
    back = archive.decode(broadcast_bytes).select(*events.columns)
    assert back.exceptAll(events).count() == 0 and back.count() == 3000
    ids = [r.id for r in archive.variables.orderBy("id").collect()]
    assert ids == list(range(len(ids)))
    assert archive.logtypes.where("id = 0").first().value == "\x12 at \x13 up"


def test_lookup_paths_agree(spark):
    values = [("hot", 4000), ("long" * 50_000, 4000), *[(f"v{i}", 1) for i in range(500)]]
    dictionary = materialize(
        spark.createDataFrame([(i, v, n) for i, (v, n) in enumerate(values)], "id bigint, value string, n bigint"), "d"
    )
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") < 4000, 0).when(F.col("id") < 8000, 1).when(F.col("id") < 8500, F.col("id") - 7998).cast("bigint").alias("ref")
    )
    spread = F.xxhash64("id")
    expected = {r.id: r.ref for r in rows.collect()}
    for limit in (0, 100_000, 1 << 26):
        got = lookup(rows, dictionary, "ref", "id", {"value": "text", "n": "uses"}, spread, limit)
        found = {r.id: r.text for r in got.collect()}
        assert len(found) == 9000
        assert all(found[k] == (None if ref is None else values[ref][0]) for k, ref in expected.items()), limit
        assert got.columns == ["id", "ref", "text", "uses"]


def test_dictionary_upsert_keeps_ids(spark, events):
    known = materialize(variable_dictionary(encode(events.where("seq < 300"))), "known")
    batch = spark.createDataFrame([("main", 1, 5), ("zeta1", 9, 2), ("alpha2", 9, 1)], "value string, first bigint, n bigint")
    merged = {r.value: (r.id, r.n) for r in upsert_dictionary(batch, known).collect()}
    old = {r.value: (r.id, r.n) for r in known.collect()}
    assert merged["main"] == (old["main"][0], old["main"][1] + 5)
    assert merged["alpha2"] == (len(old), 1) and merged["zeta1"] == (len(old) + 1, 2)
    ids = lookup_ids(batch.select("value"), known, "value", "id", F.lit(1).cast("bigint")).collect()
    assert sorted(str(r.id) for r in ids) == sorted(["None", "None", str(old["main"][0])])


def test_limits(spark):
    big = spark.createDataFrame([(65536, "x")], "id bigint, value string")
    with pytest.raises(ValueError, match="65536"):
        check_compact(big)
    long = spark.createDataFrame([(0, "x" * 65536)], "id bigint, value string")
    with pytest.raises(ValueError, match="65536 bytes"):
        check_compact(long)
    with pytest.raises(Exception, match="over 65535 bytes"):
        export_dictionary(long).collect()


def test_row_major_id_limit(spark, events):
    archive = build_archive(encode(events))
    archive.events = archive.events.withColumn("logtype_id", F.col("logtype_id") + 65536)
    with pytest.raises(Exception, match="logtype id over 65535"):
        row_major(archive, id_bytes=2).collect()


def test_archive_reads_only_what_is_asked(spark, events, tmp_path):
    write_archive(encode(events), str(tmp_path / "a"))
    table = read_archive(spark, str(tmp_path / "a")).events
    plan = table.where("source = 'rare'").select("ts")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,rare)" in plan and "ReadSchema: struct<source:string,ts:timestamp>" in plan


@pytest.mark.parametrize("mode", ["none", "shared", "separate", "marked"])
def test_every_dedup_mode_rebuilds_the_archive(spark, events, mode):
    coded = materialize(encode(events), "coded")
    direct = build_archive(coded)
    stream = materialize(dedup_records(to_records(coded), mode), "stream")
    rebuilt, logtypes, variables = records_to_archive(stream, broadcast_bytes=0)
    assert rebuilt.select(direct.events.columns).exceptAll(direct.events).count() == 0
    assert rebuilt.count() == 3000
    for ours, theirs in ((logtypes, direct.logtypes), (variables, direct.variables)):
        assert ours.exceptAll(theirs).count() == 0 and ours.count() == theirs.count()
    literals = stream.where("literal is not null")
    if mode in ("shared", "separate"):
        assert literals.groupBy("source", "op", "digest").count().where("count > 1").count() == 0
    else:
        assert literals.where("op in (32, 48)").count() == stream.where("op in (32, 48)").count()


def test_shared_set_resolves_across_kinds(spark):
    rows = spark.createDataFrame([("s", 0, "xyz"), ("s", 1, "k=xyz")], "source string, seq bigint, msg string")
    coded = encode(rows.withColumn("ts", F.timestamp_millis("seq")))
    stream = dedup_records(to_records(coded), "shared")
    assert stream.where("op = 48").first().literal is None
    _, _, variables = records_to_archive(stream)
    assert [r.value for r in variables.collect()] == ["xyz"]


def test_record_sizes(spark):
    rows = spark.createDataFrame([("s", 0, "k=xyz " + "w" * 200 + " 7 1.5"), ("s", 1, "k=xyz")], "source string, seq bigint, msg string")
    records = materialize(to_records(encode(rows.withColumn("ts", F.timestamp_millis("seq")))), "records")
    logtype = len("k=\x12 ") + 200 + len(" \x11 \x13")
    fixed = 2 * 9 + 2 * 9
    expected = {
        "none": fixed + 2 * (1 + 1 + 3) + (1 + 2 + logtype) + (1 + 1 + 3),
        "separate": fixed + (33 + 1 + 3) + 33 + (33 + 2 + logtype) + (33 + 1 + 3),
    }
    for mode, size in expected.items():
        assert record_bytes(dedup_records(records, mode), mode).first().bytes == size
    marked = dedup_records(records, "marked").withColumn("m", record_marker("marked"))
    assert sorted(r.m for r in marked.collect()) == [0x10, 0x10, 0x24, 0x25, 0x31, 0x34, 0x40, 0x40]
    assert merge_sources(records, records).count() == 2 * records.count()


def test_no_group_gathers_a_hot_value(spark, events):
    plan = dedup_records(to_records(encode(events)), "separate")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    dictionary = logtype_dictionary(encode(events))._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in dictionary


def test_size_report_and_throughput(spark):
    rows = spark.createDataFrame([("s", 0, " a 1 b2"), ("s", 1, " a 2 b2")], "source string, seq bigint, msg string")
    coded = encode(rows.withColumn("ts", F.timestamp_millis("seq")), mode="int_only")
    report = ir_size_report(coded, 100).first()
    assert (report.logtype_dict_bytes, report.variable_dict_bytes) == (7, 3)
    assert report.min_bytes == 7 + 3 + 16 + 4 + 32 and report.max_bytes == report.min_bytes + 12
    assert throughput(coded, 2)["events_per_second"] > 0


def small(spark, *rows):
    made = spark.createDataFrame([(s, i, m) for s, i, m in rows], "source string, seq bigint, msg string")
    return encode(made.withColumn("ts", F.timestamp_seconds("seq")).select("source", "seq", "ts", "msg"))


def test_two_events_of_one_place_raise(spark, tmp_path):
    coded = small(spark, ("a", 1, "job=abc 1"), ("a", 1, "job=xyz 2"), ("a", 2, "plain"))
    with pytest.raises(Exception, match="two events have one"):
        write_archive(coded, str(tmp_path / "a"))


def test_missing_entries_raise(spark, tmp_path):
    archive = write_archive(small(spark, ("a", 1, "job=abc 1"), ("a", 2, "job=xyz 2"), ("a", 3, "plain")), str(tmp_path / "a"))
    assert archive.decode().count() == 3
    archive.variables = archive.variables.where("value != 'xyz'")
    with pytest.raises(Exception, match="dictionary entry is missing"):
        archive.decode().collect()
    archive = read_archive(spark, str(tmp_path / "a"))
    archive.logtypes = archive.logtypes.where("value != 'plain'")
    with pytest.raises(Exception, match="no template"):
        archive.decode().collect()


def test_row_major_needs_a_time(spark):
    archive = build_archive(small(spark, ("a", 1, "x")).withColumn("ts", F.lit(None).cast("timestamp")))
    with pytest.raises(Exception, match="need a time"):
        row_major(archive).collect()


@pytest.mark.parametrize("level, codec", [(0, "uncompressed"), (3, "zstd"), (19, "zstd")])
def test_codec_and_level(level, codec):
    options = codec_options("zstd", level)
    assert options["compression"] == codec
    assert options.get("parquet.compression.codec.zstd.level") == (str(level) if level else None)


def test_bytes_that_are_not_text_come_back(spark):
    messages = [b"user\xc3( job=abc 12 \xff", b"\x10\x18 plain 7", b"\xe9", b"", "é 1.5 ñ".encode()]
    made = spark.createDataFrame([("a", i, m) for i, m in enumerate(messages)], "source string, seq bigint, msg binary")
    coded = encode(made.withColumn("ts", F.timestamp_seconds("seq")))
    back = decode_encoded(materialize(coded, "odd")).select("seq", F.col("msg").cast("binary").alias("msg"))
    assert {r.seq: bytes(r.msg) for r in back.collect()} == dict(enumerate(messages))
    again = build_archive(coded).decode().select("seq", F.col("msg").cast("binary").alias("msg"))
    assert {r.seq: bytes(r.msg) for r in again.collect()} == dict(enumerate(messages))
