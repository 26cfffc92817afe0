"""Logs that arrive in pieces, against the whole log parsed at once."""

import pytest

from logarc.sources.logs import parse_logs
from logarc.sources.text_sinks import read_text, write_text
from logarc.streaming.stitch import read_stitched, stream_lines, stream_stitch


def log(n, lead=()):
    lines = list(lead)
    for i in range(n):
        lines.append(f"21/10/11 06:{i // 60:02d}:{i % 60:02d} INFO X: event {i}")
        lines += [f"\tat frame {k} of {i}" for k in range(i % 4)]
        if i % 5 == 0:
            lines.append("")
    return lines


def parsed(df, name):
    return sorted((r.seq, r.ts, r.msg) for r in df.collect() if name in r.source)


def stream(spark, folder, out):
    stream_stitch(stream_lines(spark, str(folder)), f"{out}/events", f"{out}/progress").awaitTermination()
    return read_stitched(spark, f"{out}/events")


@pytest.mark.parametrize("cuts", [(5, 11), (1, 2), (9, 9)])
def test_one_log_in_three_pieces_equals_the_whole(spark, tmp_path, cuts):
    logs, whole = tmp_path / "logs", tmp_path / "whole"
    logs.mkdir(), whole.mkdir()
    both = {"a.log": log(9), "b.log": log(6, lead=["tail of an event", "\tand more", "third"])}
    for name, lines in both.items():
        (whole / name).write_text("\n".join(lines) + "\n")
    wanted = parse_logs(spark, str(whole))
    for k in range(3):
        for name, lines in both.items():
            part = lines[(0, *cuts)[k] : (*cuts, None)[k]]
            if part:
                (logs / f"{name}.{k}").write_text("\n".join(part) + "\n")
        finished, opened = stream(spark, logs, tmp_path)
        assert opened.count() <= 2
    for name in both:
        assert parsed(finished.unionByName(opened), name) == parsed(wanted, name)
    assert {r.seq for r in opened.collect()} == {8, 5}


def test_pieces_of_one_batch_and_a_late_one(spark, tmp_path):
    logs, whole = tmp_path / "logs", tmp_path / "whole"
    logs.mkdir(), whole.mkdir()
    lines = log(8)
    (whole / "a.log").write_text("\n".join(lines))
    for k in (2, 10, 1):
        begin, end = {1: (0, 4), 2: (4, 6), 10: (6, None)}[k]
        (logs / f"a.log.{k}").write_text("\n".join(lines[begin:end]) + "\n")
    finished, opened = stream(spark, logs, tmp_path)
    assert parsed(finished.unionByName(opened), "a.log") == parsed(parse_logs(spark, str(whole)), "a.log")
    (logs / "a.log.3").write_text("21/10/11 07:00:00 INFO X: late\n")
    with pytest.raises(Exception, match="a later piece was read"):
        stream(spark, logs, tmp_path)


def test_zstd_text_is_plain_zstd(spark, tmp_path):
    import zstandard

    lines = [f"line {i} é" for i in range(2000)] + [""]
    path = str(tmp_path / "text")
    write_text(spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1), path, "zstd", level=9)
    assert sorted(r.value for r in read_text(spark, path).collect()) == sorted(lines)
    (file,) = (tmp_path / "text").glob("*.zstd")
    assert zstandard.ZstdDecompressor().stream_reader(file.open("rb")).read().decode().split("\n")[:-1] == lines
