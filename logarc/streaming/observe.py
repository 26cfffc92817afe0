"""Counts and rates of a running stream, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "logarc"


def observed(df: DataFrame, *more: Column, name: str = NAME) -> DataFrame:
    """The stream, counting its rows as they pass: no job of its own, no row is copied."""
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"), *more)


class BatchRates(StreamingQueryListener):
    """Collects a row per batch: its number, the observed values and rows per second."""

    def __init__(self, name: str = NAME):
        self.name = name
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        found = progress.observedMetrics.get(self.name)
        if found is not None and progress.numInputRows:
            self.batches.append({"batch": progress.batchId, "rows_per_second": progress.processedRowsPerSecond, **found.asDict()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


@contextmanager
def batch_rates(spark: SparkSession, name: str = NAME) -> Iterator[list[dict]]:
    """Listens to the streams that run inside; their batches are all there when it ends."""
    listener = BatchRates(name)
    spark.streams.addListener(listener)
    try:
        yield listener.batches
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)
