"""Helpers shared by the corpus operators: tables, sizes, and words as arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Bytes of text worked on at a time inside a task; bounds the arrays made from them.
CHUNK_BYTES = 2 * 1024 * 1024
CHUNK_ROWS = 4096
# A side of a join is broadcast only if its measured rows times their width stay below this.
BROADCAST_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table once in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """The table, marked for broadcast only if its counted rows are few enough; otherwise the join shuffles."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_key(text: str = "text") -> tuple[Column, Column]:
    """128 bits that stand for a text (null like no other)."""
    return F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(7919), F.col(text)).alias("h2")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, -(-rows // per_partition))


# --- arrays of texts inside a task -------------------------------------------


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text and ``rows`` rows, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = text_bytes(batch.column(text))[1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), begin + rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and the place where each begins. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    place = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[place[0] : place[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, place - (place[0] if len(place) else 0)


BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit integer spread over all its bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Spans over this many bytes are hashed one by one, so that one long span doesn't cost a step per block for all.
_LONG_SPAN = 128
_LANES = ((0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D), (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.

    Blocks of 8 bytes pass through two lanes of 64 bits, each mixed after every block; spans
    longer than ``_LONG_SPAN`` bytes take BLAKE2. No linear form of the bytes is left that
    two different spans could share by their structure.
    """
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    blocks = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = (end - start).astype(np.int64)
    lanes = [mix(size.astype(np.uint64) + np.uint64(seed)) for _, seed in _LANES]
    left = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    at = 0
    while len(left):
        rest = size[left] - at
        block = blocks[start[left] + at]
        short = rest < 8
        block[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        for k, (factor, _) in enumerate(_LANES):
            lanes[k][left] = mix((lanes[k][left] ^ block) * np.uint64(factor))
        at += 8
        left = left[rest > 8]
    out = mix(lanes[0] ^ (lanes[1] * np.uint64(_LANES[0][0])))
    for i in np.flatnonzero(size > _LONG_SPAN).tolist():
        digest = hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


@dataclass
class Words:
    """Words of several texts: byte spans, hashes, and where each text's words begin."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text, and one past the last

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row; ``lower`` maps A-Z to a-z first."""
    raw, place = text_bytes(column)
    if lower:
        raw = LOWER[raw]
    inside = ~BLANK[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    opens = inside.copy()
    opens &= ~before[:-1]
    edges = place[(place < len(raw)) & (place >= 0)]
    opens[edges] = inside[edges]
    start = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = place[1:-1][place[1:-1] > 0] - 1
    closes[last] = inside[last]
    end = np.flatnonzero(closes) + 1
    return Words(raw, start, end, np.searchsorted(start, place))


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Indices of words at which a window of ``size`` words fits in its text."""
    count = np.diff(first)
    fits = np.maximum(count - size + 1, 0)
    return np.repeat(first[:-1], fits) + ranges(fits)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def window_hashes(hashes: np.ndarray, at: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at these offsets from each window's start, in their order."""
    out = np.full(len(at), 0x2545F4914F6CDD1D + len(offsets), np.uint64)
    for k in offsets:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[at + k])
    return out


def sum_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(value))
