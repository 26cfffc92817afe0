from logarc.operators.encode import encode
from logarc.plans import archive as archives

from .events import ROWS, messages


def test_archive_joins_ids_once(spark, tmp_path, monkeypatch):
    labels, plain = [], archives.materialize
    monkeypatch.setattr(archives, "materialize", lambda df, label: labels.append(label) or plain(df, label))
    archive = archives.write_archive(encode(messages(spark)), str(tmp_path / "archive"))
    assert archive.events.count() == ROWS
    assert labels[-1] == "events"  # stored before they are range partitioned
