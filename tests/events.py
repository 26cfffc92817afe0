"""Events for the tests that nothing costly runs twice."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 200


def messages(spark: SparkSession) -> DataFrame:
    return spark.range(0, ROWS, 1, 4).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
        F.col("id").alias("seq"),
        F.timestamp_seconds("id").alias("ts"),
        F.concat(F.lit("user=u"), (F.col("id") % 7).cast("string"), F.lit(" took "), F.col("id").cast("string"), F.lit(" a1 a1")).alias("msg"),
    )
