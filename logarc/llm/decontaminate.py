"""Benchmark decontamination with spaced seeds: hashed word patterns joined, hits verified along their diagonal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hinted, stored, text_key, window_hashes, windows, words_of

# Word offsets that count; the others of a seed may be anything.
SEEDS = [(0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 2, 5, 7), (0, 3, 5, 6, 8)]
# Items of fewer words can't be told from common phrases: they are out of scope and match nothing.
MIN_ITEM_WORDS = 5
# Shorter items than this are found with any one of their words replaced, which is all that MIN_EQUAL allows them.
ONE_REPLACED = 8
# An overlap holds if this many words (or the whole item) lie in one stretch with this share of them equal.
MIN_OVERLAP = 13
MIN_EQUAL = 0.8
# Bits of the filter that training hashes pass before the join; its size doesn't depend on the data.
FILTER_BITS = 24


Seed = tuple[tuple[int, ...], int | None]


def _seed_rows(words, seeds: list[Seed]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each seed: hashes of all its windows and the word they begin at."""
    hashes = words.hashes
    for offsets, _ in seeds:
        at = windows(words.first, offsets[-1] + 1)
        yield window_hashes(hashes, at, offsets), at


def seeds_for(lengths: list[int]) -> list[Seed]:
    """The spaced seeds, and masks of the whole item for the lengths too short for the longest of them.

    Each comes with the number of words of the items it is for (None: all). Items under
    ``ONE_REPLACED`` words have a mask without each of their words, besides the full one.
    """
    longest = max(s[-1] + 1 for s in SEEDS)
    seeds: list[Seed] = [(offsets, None) for offsets in SEEDS]
    for n in sorted(set(lengths)):
        if MIN_ITEM_WORDS <= n < longest:
            whole = tuple(range(n))
            seeds.append((whole, n))
            seeds += [(whole[:k] + whole[k + 1 :], n) for k in range(n) if n < ONE_REPLACED]
    return seeds


def item_seeds(benchmark: DataFrame, seeds: list[Seed], item_id: str, text: str) -> DataFrame:
    """``hash, item_id, at``: all seed hashes of all items."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), lower=True)
            size, row = np.diff(words.first), words.row
            for (_, n), (key, at) in zip(seeds, _seed_rows(words, seeds), strict=True):
                own = size[row[at]]
                fits = own >= MIN_ITEM_WORDS if n is None else own == n
                key, at = key[fits], at[fits]
                items = batch.column("item_id").take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), items, pa.array(at - words.first[row[at]])], ["hash", "item_id", "at"])

    rows = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"hash long, item_id {kind}, at long")


def _filter_bits(seeds: DataFrame) -> np.ndarray:
    """Which slots hold an item hash: 2**FILTER_BITS bits, gathered as at most an eighth as many rows."""
    slots = seeds.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("slot"))
    rows = slots.groupBy(F.expr("shiftright(slot, 3)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, int(slot & 7)))").alias("bits"))
    found = rows.select("byte", F.col("bits").cast("smallint").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    bits[found.column("byte").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return bits


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``h1, h2, doc_id, item_id, n_equal, n_overlap, first_word``: verified overlaps, one row per document row and item.

    Words are compared in lower case (A-Z). Seed hashes of all items and of all
    documents are joined; each hit gives a diagonal, and on it the longest stretch
    around the hits with a share ``MIN_EQUAL`` of equal words is taken. It counts if it
    has ``MIN_OVERLAP`` words, or all of a shorter item. Of stretches of one length the first
    on the smallest diagonal counts, and of overlaps with most equal words the longest. Texts are
    compared whole, however long. Null and empty texts match nothing; rows that repeat give
    rows that repeat no pair; other columns are ignored. Empty tables give no rows.

    Before the join training hashes pass a bit filter of fixed size, so only those
    near an item hash are shuffled. Hits of one hash in very many documents stay rows
    of the larger side, which the join may split.
    """
    lengths = benchmark.select(F.size(F.array_remove(F.split(F.col(item_text), r"[ \t\n\x0B\f\r]+"), "")).alias("n")).filter("n < 16").distinct()
    seeds = seeds_for([row.n for row in lengths.collect() if row.n])
    items = stored(item_seeds(benchmark, seeds, item_id, item_text), "item-seeds")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(items))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), lower=True)
            row = words.row
            for key, at in _seed_rows(words, seeds):
                slot = key >> np.uint64(64 - FILTER_BITS)
                pass_ = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                key, at = key[pass_], at[pass_]
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h1").take(of), batch.column("h2").take(of), pa.array(key.view(np.int64)), pa.array(at - words.first[row[at]])],
                    ["h1", "h2", "hash", "pos"],
                )

    keyed = docs.select(*text_key(text), docs[text].alias("text")).filter("text IS NOT NULL")
    passed = keyed.mapInArrow(hashed, "h1 long, h2 long, hash long, pos long")
    joined = passed.join(hinted(items, 32), "hash")
    hits = joined.groupBy("h1", "h2", "item_id", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.lit(1).alias("one"))
    # Diagonals of one text and item: no more than the words of both.
    pairs = stored(hits.groupBy("h1", "h2", "item_id").agg(F.collect_list("diagonal").alias("diagonals")), "seed-pairs")
    wording = benchmark.select(benchmark[item_id].alias("of_item"), benchmark[item_text].alias("item_text"))
    with_items = pairs.join(wording, F.col("item_id").eqNullSafe(F.col("of_item"))).drop("of_item")
    held = F.octet_length("item_text") + F.size("diagonals") * 8 + 96
    size = with_items.agg(F.coalesce(F.sum(held.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    texts = docs.select(*[k.alias(f"k{i}") for i, k in enumerate(text_key(text))], docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    same = (F.col("h1") == F.col("k0")) & (F.col("h2") == F.col("k1"))
    candidates = texts.join(hinted(with_items, 1, size), same).select("h1", "h2", "doc_id", "item_id", "diagonals", "text", "item_text")
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.mapInArrow(
        _verify, f"h1 long, h2 long, doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_equal long, n_overlap long, first_word long"
    )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        text = words_of(batch.column("text"), lower=True)
        item = words_of(batch.column("item_text"), lower=True)
        text_hashes, item_hashes = text.hashes, item.hashes
        keep, found = [], []
        for i, diagonals in enumerate(batch.column("diagonals").to_pylist()):
            a = text_hashes[text.first[i] : text.first[i + 1]]
            b = item_hashes[item.first[i] : item.first[i + 1]]
            best = max((_overlap(a, b, d) for d in sorted(diagonals)), default=(0, 0, 0))
            if best[1] and best[1] >= min(MIN_OVERLAP, len(b)):
                keep.append(i)
                found.append(best)
        names = ["h1", "h2", "doc_id", "item_id"]
        taken = batch.select(names).take(pa.array(keep, pa.int64()))
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*taken.columns, *columns], [*names, "n_equal", "n_overlap", "first_word"])


def _overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Equal words, length and first word (in the text) of the longest stretch on a diagonal that is equal enough."""
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if high <= low:
        return 0, 0, 0
    equal = text[low + diagonal : high + diagonal] == item[low:high]
    # A stretch is equal enough if the sum of (equal - MIN_EQUAL) over it is not negative.
    total = np.concatenate([[0.0], np.cumsum(equal - MIN_EQUAL)]) + 1e-9 * np.arange(len(equal) + 1)
    lowest = np.minimum.accumulate(total)
    highest = np.maximum.accumulate(total[::-1])[::-1]
    # For each start that is a new low, the last end at which the sum is as high again.
    starts = np.flatnonzero(total == lowest)
    ends = len(total) - 1 - np.searchsorted(highest[::-1], total[starts], side="left")
    length = ends - starts
    k = int(length.argmax())
    if length[k] <= 0:
        return 0, 0, 0
    return int(equal[starts[k] : ends[k]].sum()), int(length[k]), int(starts[k] + low + diagonal)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **names: str) -> DataFrame:
    """The rows without a verified overlap with any item, all columns kept.

    Copies of a contaminated text go with it, whatever their id; null and empty texts stay.
    """
    pairs = stored(contaminated_pairs(docs, benchmark, text, doc_id, **names).select("h1", "h2").distinct(), "contaminated")
    keys = pairs.withColumnsRenamed({"h1": "_leak_h1", "h2": "_leak_h2"})
    h1, h2 = text_key(text)
    keyed = docs.withColumns({"_leak_k1": h1, "_leak_k2": h2})
    same = (F.col("_leak_k1") == F.col("_leak_h1")) & (F.col("_leak_k2") == F.col("_leak_h2"))
    return keyed.join(hinted(keys, 16), same, "left_anti").select(*docs.columns)
