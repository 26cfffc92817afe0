import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from logarc.llm.sharding import cut_groups, shard_documents

from .fixtures import awkward, doc, empty, frame, prose


def place(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def needs(sizes, capacity):
    shards, room = 0, 0
    for size in sizes:
        if size > capacity:
            return float("inf")
        if size > room:
            shards, room = shards + 1, capacity
        room -= size
    return shards


def smallest(sizes, shards):
    """Capacity found by trying, from below."""
    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needs(sizes, middle) <= shards else (middle + 1, high)
    return low


def grouped(rows):
    size = defaultdict(int)
    for r in rows:
        size[place(r[1])] += len((r[1] or "").encode()) + 16
    return size


def check(found, rows, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in found) == sorted(
        (r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    total, size = 0, grouped(rows)
    left, sizes, alone = sum(size.values()), dict(size), 0
    for p, s in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        if shards - alone == 1 or s * (shards - alone) < left:
            break
        left, alone = left - sizes.pop(p), alone + 1
    best = smallest([sizes[p] for p in sorted(sizes)], shards - alone)
    held = defaultdict(int)
    for r in found:
        held[r.shard] += r.size
    assert all(held[s] <= best for s in held if s >= alone)
    assert [held[s] for s in range(alone)] == sorted((s for p, s in size.items() if p not in sizes), reverse=True)[:alone]
    return held, best, alone


@pytest.mark.parametrize("cell_bits", [1, 3, 16])
@pytest.mark.parametrize("seed", range(4))
def test_shards_keep_to_the_smallest_capacity(spark, seed, cell_bits):
    draw = random.Random(seed)
    rows = [doc(i, prose(i, draw.randint(0, 60))) for i in range(300)]
    rows += [doc(1000 + i, rows[i % 7][1]) for i in range(60)]
    shards = (2, 5, 11, 40)[seed]
    found = shard_documents(frame(spark, rows), shards, cell_bits=cell_bits).collect()
    held, _, _ = check(found, rows, shards)
    shard_of = defaultdict(set)
    text_of = {r[0]: r[1] for r in rows}
    for r in found:
        shard_of[text_of[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    assert len(held) == shards


def test_one_group_with_most_rows(spark):
    rows = [doc(i, "the same text again and again") for i in range(400)] + [doc(400 + i, prose(i, 12)) for i in range(300)]
    held, best, alone = check(shard_documents(frame(spark, rows), 10).collect(), rows, 10)
    assert alone == 1 and len(held) == 10
    assert min(held[s] for s in range(1, 10)) > 0.7 * best


def test_equal_sizes_leave_no_shard_empty(spark):
    rows = [doc(i, f"{i:04d}") for i in range(1001)]
    held, _, _ = check(shard_documents(frame(spark, rows), 40).collect(), rows, 40)
    assert sorted(set(held.values())) == [25 * 20, 26 * 20]


def test_same_cuts_however_little_the_driver_sees(spark):
    groups = spark.createDataFrame([(place(prose(i, 3)), 17 + i % 91) for i in range(2000)], "place long, bytes long")
    wanted = cut_groups(groups, 13, 16)

    def shards(cuts):
        return [sum(p >= c for c in cuts) for p in sorted(r.place for r in groups.collect())]

    for bits in (2, 6, 9):
        alone, cuts = cut_groups(groups, 13, bits)
        assert alone == wanted[0] and shards(cuts) == shards(wanted[1])


def test_awkward_rows_and_more_shards_than_groups(spark):
    rows = awkward()
    found = shard_documents(frame(spark, rows), 40).collect()
    check(found, rows, 40)
    text_of = {(r[0], len((r[1] or "").encode()) + 16) for r in rows if not r[1]}
    assert len({r.shard for r in found if (r.doc_id, r.size) in text_of}) == 1


def test_partitioning_changes_nothing(spark):
    rows = [doc(i % 150, prose(i % 90, 8)) for i in range(400)]
    first, second = (sorted(map(str, shard_documents(frame(spark, rows, n), 6).collect())) for n in (1, 6))
    assert first == second


def test_empty_table(spark):
    assert shard_documents(empty(spark)).collect() == []
