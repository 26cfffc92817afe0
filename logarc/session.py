"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest table a join may broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Settings results depend on: one time zone for every reader and writer."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    java_context = spark.sparkContext._jsc.sc()
    known = java_context.getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logarc-"))
    return java_context.getCheckpointDir().get()


_scope = threading.local()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one intermediate table."""
    path = f"{shared_folder(spark)}/logarc-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    paths = getattr(_scope, "paths", None)
    if paths is not None:
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside when it ends; no DataFrame made from them may be used after that."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        for path in paths:
            _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(path))


def _delete(spark: SparkSession, place) -> None:
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table once in the shared folder and read it back.

    Cuts the lineage: later jobs survive lost executors without computing the
    table again, and values such as range-partition row numbers stay fixed.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when no DataFrame made from them is used any more."""
    _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent())
