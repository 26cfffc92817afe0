"""Tables that grow by one folder per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_scope


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that the optimizer knows to be empty."""
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).limit(0)


def read_batches(
    spark: SparkSession,
    schema: T.StructType,
    path: str,
    before_batch: int | None = None,
    keep_batch: bool = False,
    only_batch: int | None = None,
) -> DataFrame:
    """Rows of all batches, of those before a given one, or of a single one; none if nothing was written yet."""
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        if only_batch is not None:
            return spark.read.schema(schema).parquet(f"{path}/batch={only_batch}")
        rows = spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, stored if keep_batch else schema)
    kept = rows if before_batch is None else rows.where(F.col("batch") < before_batch)
    return kept if keep_batch else kept.drop("batch")


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch into a folder of its own; a replay overwrites it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_batches(rows: DataFrame, checkpoint: str, add: Callable[[DataFrame, int], object]) -> StreamingQuery:
    """Call ``add`` with each batch and its number until present input is read; its intermediate tables go after each."""

    def once(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            add(batch, batch_id)

    return rows.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
