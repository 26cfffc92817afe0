"""Tables that grow by a part per batch and are read by key.

Rows are found by the leading bits of a digest. A batch adds one part; eight parts of a
level are merged into one of the next, so a table of ``b`` batches has a few times
``log(b)`` parts. A part is cut into buckets of about ``BUCKET_ROWS`` rows by those bits,
and a reader that names the bits it looks for reads their buckets alone. What a
batch reads therefore follows its own keys and not the history.

The parts that count are listed in a small log file per batch, which is put in place
last: a batch that fails leaves the table as it was, and a replay writes the same again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import no_rows

# Leading bits of a digest that a reader may name, so at most 4,096 values come to the driver.
PREFIX_BITS = 12
BUCKET_ROWS = 4096
# Parts of one level that are merged into one of the next.
FAN = 8
# Logs whose parts are kept, so that the last batches can be replayed.
KEPT_LOGS = 3


@dataclass
class Version:
    """Parts that hold the table after a batch, and the next free id."""

    parts: list[dict] = field(default_factory=list)
    next_id: int = 0


def prefix(digest: Column) -> Column:
    """The leading bits of a binary digest."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int"), 16 - PREFIX_BITS)


def prefixes(rows: DataFrame, digest: str = "digest") -> dict[int, int]:
    """The prefixes that occur, with their rows."""
    return {r.p: r.n for r in rows.groupBy(prefix(F.col(digest)).alias("p")).agg(F.count("*").alias("n")).collect()}


class GrownTable:
    """``schema`` columns; ``key`` gives the digest by which rows are found (None: the table is only read whole)."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: Column | None,
        merge: Callable[[DataFrame], DataFrame] | None = None,
        bucket_rows: int = BUCKET_ROWS,
    ):
        self.spark, self.path, self.schema, self.key, self.merge, self.bucket_rows = spark, path, schema, key, merge, bucket_rows
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """Batches with a log, in their order."""
        folder = self._place("log")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, before_batch: int | None = None) -> Version:
        """The table as the last batch, or the last one before ``before_batch``, has left it."""
        known = [b for b in self.batches() if before_batch is None or b < before_batch]
        if not known:
            return Version()
        stream = self._files.open(self._place(f"log/{known[-1]}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def read(self, version: Version, wanted: Iterable[int] | None = None) -> DataFrame:
        """All rows, or at least those whose digest begins with a wanted prefix."""
        parts = [self._read_part(part, wanted) for part in version.parts if part["rows"]]
        return reduce(DataFrame.unionByName, parts) if parts else no_rows(self.spark, self.schema)

    def _read_part(self, part: dict, wanted: Iterable[int] | None) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(stored).parquet(f"{self.path}/parts/{part['name']}")
        if wanted is not None and part["bits"]:
            buckets = sorted({p >> (PREFIX_BITS - part["bits"]) for p in wanted})
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.drop("bucket")

    def append(self, rows: DataFrame, count: int, batch_id: int, before: Version, next_id: int = 0) -> Version:
        """Add a batch of so many rows to the version it was made from."""
        parts = [*before.parts, self._write(rows, f"b{batch_id}", 0, count)]
        level = 0
        while len(full := [p for p in parts if p["level"] == level]) >= FAN:
            held = self.read(Version(full))
            merged = self._write(held if self.merge is None else self.merge(held), f"m{batch_id}-{level}", level + 1, sum(p["rows"] for p in full))
            parts = [p for p in parts if p["level"] != level] + [merged]
            level += 1
        after = Version(parts, next_id)
        self._put_log(batch_id, after)
        self._retire(batch_id)
        return after

    def _write(self, rows: DataFrame, name: str, level: int, count: int) -> dict:
        bits = 0
        while self.key is not None and bits < PREFIX_BITS and count >> bits > self.bucket_rows:
            bits += 1
        if bits:
            rows = rows.withColumn("bucket", F.shiftright(prefix(self.key), PREFIX_BITS - bits)).repartition("bucket")
        else:
            rows = rows.withColumn("bucket", F.lit(0))
        if count:
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/parts/{name}")
        return {"name": name, "level": level, "rows": count, "bits": bits}

    def _put_log(self, batch_id: int, version: Version) -> None:
        draft, final = self._place(f"log/.{batch_id}.draft"), self._place(f"log/{batch_id}.json")
        stream = self._files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"parts": version.parts, "next_id": version.next_id}).encode()))
        finally:
            stream.close()
        self._files.delete(final, False)
        if not self._files.rename(draft, final):
            raise OSError(f"the log of batch {batch_id} could not be put in place")

    def _retire(self, batch_id: int) -> None:
        """Delete parts and logs that no batch from the last ones on needs."""
        known = [b for b in self.batches() if b <= batch_id]
        for old in known[:-KEPT_LOGS]:
            self._files.delete(self._place(f"log/{old}.json"), False)
        kept = {p["name"] for b in known[-KEPT_LOGS:] for p in self.version(b + 1).parts}
        parts = self._place("parts")
        for status in self._files.listStatus(parts) if self._files.exists(parts) else []:
            if status.getPath().getName() not in kept:
                self._files.delete(status.getPath(), True)
