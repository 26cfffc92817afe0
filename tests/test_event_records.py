import pytest

from logarc.operators.encode import encode
from logarc.operators.records import ordered_event_records, ordered_records, to_records

from .events import messages


@pytest.mark.parametrize("mode", ["none", "shared", "separate", "marked"])
def test_event_records_are_the_records_in_stream_order(spark, mode):
    encoded = encode(messages(spark)).cache()
    made = ordered_event_records(encoded, mode)
    expected = ordered_records(to_records(encoded), mode)
    assert made.schema.names == expected.schema.names

    def rows(df):
        return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in row) for row in df.collect()]

    assert rows(made) == sorted(rows(expected), key=lambda row: row[:3])
    # What is shuffled is events: records are taken apart above the exchange.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    with pytest.raises(ValueError):
        ordered_event_records(encoded, "other")
