from logarc.operators.encode import encode
from logarc.operators.records import to_records
from logarc.streaming import records as sent_records

from .events import messages


def test_spans_combine_without_a_sort(spark, tmp_path, monkeypatch):
    plans, plain = [], sent_records.materialize

    def stored(df, label):
        plans.append((label, df._jdf.queryExecution().sparkPlan().toString()))
        return plain(df, label)

    monkeypatch.setattr(sent_records, "materialize", stored)
    sent_records.send_expiring_batch(to_records(encode(messages(spark))), 0, str(tmp_path / "sent"), 1000)
    assert "HashAggregate" in dict(plans)["spans"] and "SortAggregate" not in dict(plans)["spans"]
