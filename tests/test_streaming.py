from pyspark.sql import functions as F

from logarc.operators.dictionary import variable_occurrences
from logarc.operators.encode import encode
from logarc.operators.records import to_records
from logarc.plans.archive import inline_form
from logarc.sources.logs import parse_logs
from logarc.streaming.dictionary import read_stream_dictionary, stream_dictionary, upsert_batch
from logarc.streaming.ingest import stream_console, stream_encode, stream_logs
from logarc.streaming.records import read_sent_literals, stream_literals, stream_new_literals, stream_references, write_stream

FIRST = "21/10/11 06:15:00 INFO X: user=ann 1\n\tat frame 7\n21/10/11 06:15:01 WARN X: user=bob 0.5\n"
SECOND = "21/10/11 06:16:00 INFO X: user=bob 2\n21/10/11 06:16:01 INFO X: user=cy 3"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    logs, out, progress = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "progress")
    logs.mkdir()
    for name, text in (("a.log", FIRST), ("b.log", SECOND)):
        (logs / name).write_text(text)
        stream_encode(stream_logs(spark, str(logs)), out, progress).awaitTermination()
    batch = inline_form(encode(parse_logs(spark, str(logs)))).select("source", "seq", "ts", "logtype", "vars")
    streamed = spark.read.parquet(out).select(batch.columns)
    assert streamed.count() == 4
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    shown = []
    one_file = stream_logs(spark, str(logs)).select("source", "seq", "msg")
    stream_console(one_file, str(tmp_path / "console"), shown.append).awaitTermination()
    assert len(shown) == 4
    (logs / "c.log").write_text("".join(f"21/10/11 07:00:00 INFO X: line {i}\n" for i in range(500)))
    stream_console(one_file, str(tmp_path / "console"), shown.append).awaitTermination()
    assert len(shown) == 504


def test_stream_dictionary_keeps_ids_and_replays(spark, tmp_path):
    logs, out, progress = tmp_path / "logs", str(tmp_path / "dict"), str(tmp_path / "progress")
    logs.mkdir()
    seen = []
    for name, text in (("a.log", FIRST), ("b.log", SECOND)):
        (logs / name).write_text(text)
        uses = variable_occurrences(encode(stream_logs(spark, str(logs))))
        stream_dictionary(uses, out, progress).awaitTermination()
        seen.append({r.value: r.id for r in read_stream_dictionary(spark, out).collect()})
    assert seen[0] == {"ann": 0, "bob": 1}
    assert seen[1] == {"ann": 0, "bob": 1, "cy": 2}
    again = spark.createDataFrame([("cy", 1), ("bob", 0)], "value string, first bigint").withColumn("first", F.col("first").cast("decimal(38,0)"))
    upsert_batch(again, 1, out)
    assert {r.value: r.id for r in read_stream_dictionary(spark, out).collect()} == seen[1]


def test_stream_literals(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text(FIRST + SECOND)
    records = to_records(encode(stream_logs(spark, str(logs))))
    path = str(tmp_path / "literals")
    write_stream(stream_literals(records), path, str(tmp_path / "p1")).awaitTermination()
    found = sorted(r.literal for r in spark.read.parquet(path).where("op = 48").collect())
    assert found == ["ann", "bob", "cy"]
    refs = str(tmp_path / "references")
    write_stream(stream_references(records), refs, str(tmp_path / "p2")).awaitTermination()
    assert spark.read.parquet(refs).where("literal is not null").count() == 0

    sent, progress = str(tmp_path / "sent"), str(tmp_path / "p4")
    stream_new_literals(records, sent, progress).awaitTermination()
    (logs / "b.log").write_text(SECOND + "\n21/10/11 06:17:00 INFO X: user=ann 9")
    stream_new_literals(records, sent, progress).awaitTermination()
    by_source = [(r.source[-5:], r.literal) for r in read_sent_literals(spark, sent).where("op = 48").collect()]
    assert sorted(by_source) == [("a.log", n) for n in ("ann", "bob", "cy")] + [("b.log", n) for n in ("ann", "bob", "cy")]
    (logs / "b.log").unlink()

    timed = encode(stream_logs(spark, str(logs)))
    timed = to_records(timed).withColumn("ts", F.current_timestamp())
    bounded = str(tmp_path / "bounded")
    write_stream(stream_literals(timed, expiry="1 hour"), bounded, str(tmp_path / "p3")).awaitTermination()
    assert spark.read.parquet(bounded).where("op = 48").count() == 3


def test_growing_archive_appends_and_replays(spark, tmp_path):
    from logarc.streaming.archive import append_archive, append_batch, read_stream_archive

    def coded(*messages, start):
        rows = [("a", start + i, m) for i, m in enumerate(messages)]
        made = spark.createDataFrame(rows, "source string, seq bigint, msg string")
        return encode(made.withColumn("ts", F.timestamp_seconds("seq")))

    path = str(tmp_path / "growing")
    first, second = ("job=abc 1", "job=xyz 2"), ("job=xyz 0.5", "job=new 7", "plain")
    assert append_archive(coded(*first, start=0), path) == 0
    assert append_archive(coded(*second, start=10), path) == 1

    def state():
        archive = read_stream_archive(spark, path)
        entries = {r.value: (r.id, r.n) for r in archive.variables.collect()}
        return entries, sorted((r.seq, r.msg) for r in archive.decode().collect())

    entries, events = state()
    assert entries == {"abc": (0, 1), "xyz": (1, 2), "new": (2, 1)}
    assert events == [(0, "job=abc 1"), (1, "job=xyz 2"), (10, "job=xyz 0.5"), (11, "job=new 7"), (12, "plain")]
    append_batch(coded(*second, start=10), 1, path)
    assert state() == (entries, events)


def test_values_of_a_first_batch_are_stored_once(spark, tmp_path, monkeypatch):
    from logarc.streaming import dictionary

    labels, store = [], dictionary.materialize
    monkeypatch.setattr(dictionary, "materialize", lambda df, label: labels.append(label) or store(df, label))
    rows = spark.createDataFrame([("cy", 1), ("bob", 0)], "value string, first bigint").withColumn("first", F.col("first").cast("decimal(38,0)"))
    for batch_id in (0, 1):
        upsert_batch(rows, batch_id, str(tmp_path / "dict"))
    assert labels == ["batch-values", "batch-values", "batch-known"]
    assert {r.value: (r.id, r.n) for r in read_stream_dictionary(spark, str(tmp_path / "dict")).collect()} == {"bob": (0, 2), "cy": (1, 2)}
