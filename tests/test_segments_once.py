from pyspark.sql import functions as F

from logarc.operators.encode import encode
from logarc.operators.segments import with_segments

from .events import ROWS, messages


def test_segments_encode_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(text: str) -> str:
        seen.add(1)
        return text

    counted = messages(spark).withColumn("msg", F.udf(count, "string").asNondeterministic()("msg"))
    assert with_segments(encode(counted)).count() == ROWS
    assert seen.value == ROWS
