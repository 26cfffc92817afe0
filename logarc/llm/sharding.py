"""Sharding by bytes: groups of equal texts in a fixed order, cut into contiguous shards of the smallest feasible capacity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .numbering import places_in_groups

# Bytes that a row takes besides its text.
ROW_BYTES = 16
# A group's place in the order: this many leading bits of its text's MD5, an even spread whatever the texts are.
PLACE_BITS = 60
# Runs of groups known to the driver at once, and so the most rows one refinement returns.
CELL_BITS = 16


def group_place(text: Column) -> Column:
    """Where a text's group stands in the order: equal texts have one place. Null counts as empty."""
    digest = F.md5(F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def shard_documents(
    docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", row_bytes: int = ROW_BYTES, cell_bits: int = CELL_BITS
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row: shards of nearly equal bytes, equal texts together.

    Groups of equal texts are atomic and ordered by a hash of the text, so the result follows
    from the rows alone. A group of at least the mean share of what is left takes a shard for
    itself (largest first, from shard 0). The others are cut in their order into the remaining
    shards: a binary search with greedy filling finds the smallest capacity that suffices
    (``smallest_capacity``), and each cut is the group boundary nearest to the even share among
    those that this capacity allows, so small tables don't leave the last shards empty. Slots
    are numbered by group, then ``doc_id``.

    Main path: SQL functions only. The driver sees byte sums of at most ``2 ** cell_bits`` runs of
    groups at a time. No task holds a group: sums are combined before the shuffle, a row's
    shard follows from its own text by comparison with the cuts, and slots are numbered in range partitions.

    Size: UTF-8 bytes of the text plus ``row_bytes``. A null text counts as empty, is one group
    with the empty ones and has crc32 0. Null ids stand first in their group; rows that are
    equal keep a slot each. Fewer groups than shards leave shards without rows; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            docs[doc_id].alias("doc_id"),
            (F.octet_length(body) + row_bytes).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            group_place(docs[text]).alias("place"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sized",
    )
    groups = stored(rows.groupBy("place").agg(F.sum("size").alias("bytes")), "groups")
    alone, cuts = cut_groups(groups, shards, cell_bits)
    placed = rows.withColumn("shard", _shard_of(F.col("place"), alone, cuts))
    return places_in_groups(placed, "shard", ["place", "doc_id", "row"], pos="slot", size="shard_rows").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )


def cut_groups(groups: DataFrame, shards: int, cell_bits: int = CELL_BITS) -> tuple[list[int], list[int]]:
    """Places of the groups that get shards for themselves, and the first place of each shard after the first of the rest.

    ``groups`` has a row per ``place`` with its ``bytes``.
    """
    largest = groups.orderBy(F.desc("bytes"), "place").limit(shards).collect()
    total = groups.agg(F.sum("bytes").alias("bytes")).first().bytes or 0
    alone: list[int] = []
    for row in largest:
        left = shards - len(alone)
        if left == 1 or row.bytes * left < total:
            break
        alone.append(row.place)
        total -= row.bytes
    rest = groups.filter(~F.col("place").isin(alone)) if alone else groups
    shift = max(0, PLACE_BITS - cell_bits)
    cells = Cells(_sums(rest, [(0, 1 << PLACE_BITS, shift)]))
    search = Search(cells, shards - len(alone))
    while wanted := search.unknown():
        spans = [(cells.first(i), cells.first(j + 1)) for i, j in wanted]
        shift = _finer(spans, min(cells.shift_of(i, j) for i, j in wanted), 1 << cell_bits)
        cells.replace(spans, _sums(rest, [(a, b, shift) for a, b in spans]))
    return alone, [cells.first(i) for i in search.cuts]


def _sums(groups: DataFrame, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Place, width in bits, groups and bytes of each run of groups in the spans that holds any."""
    run = None
    for low, high, shift in spans:
        inside = F.col("place").between(F.lit(low), F.lit(high - 1))
        value = F.struct(F.shiftleft(F.shiftright("place", shift), shift).alias("first"), F.lit(shift).alias("shift"))
        run = F.when(inside, value) if run is None else run.when(inside, value)
    found = groups.select(run.alias("run"), "bytes").filter("run IS NOT NULL")
    summed = found.groupBy("run.first", "run.shift").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return sorted((r["first"], r["shift"], r["n"], r["bytes"]) for r in summed.collect())


def _finer(spans: list[tuple[int, int]], shift: int, most: int) -> int:
    """The smallest width at which the spans hold no more runs than ``most``; at least halves the runs."""
    width = sum(b - a for a, b in spans)
    finer = shift - 1
    while finer > 0 and width >> (finer - 1) <= most:
        finer -= 1
    return max(0, finer)


@dataclass
class Cells:
    """Runs of groups in their order: what the driver knows of their bytes. A run of one group has no boundary inside."""

    runs: list[tuple[int, int, int, int]]
    ends: list[int] = field(init=False)  # bytes of all groups before each run, and of all at last

    def __post_init__(self):
        self.ends = [0]
        for _, _, _, size in self.runs:
            self.ends.append(self.ends[-1] + size)

    @property
    def total(self) -> int:
        return self.ends[-1]

    def first(self, i: int) -> int:
        return self.runs[i][0] if i < len(self.runs) else 1 << PLACE_BITS

    def open(self, i: int) -> bool:
        return 0 <= i < len(self.runs) and self.runs[i][2] > 1

    def shift_of(self, i: int, j: int) -> int:
        return min(run[1] for run in self.runs[i : j + 1] if run[2] > 1)

    def replace(self, spans: list[tuple[int, int]], runs: list[tuple[int, int, int, int]]) -> None:
        starts = [a for a, _ in spans]

        def stays(place: int) -> bool:
            k = bisect_right(starts, place) - 1
            return k < 0 or place >= spans[k][1]

        self.runs = sorted([r for r in self.runs if stays(r[0])] + runs)
        self.__post_init__()

    def down(self, at: int, hopeful: bool) -> int:
        """The last boundary at or before ``at``, taken as early (or as late) as what is known allows."""
        if at >= self.total:
            return self.total
        i = bisect_right(self.ends, at) - 1
        return at if hopeful and self.open(i) else self.ends[i]

    def up(self, at: int, hopeful: bool) -> int:
        """The first boundary at or after ``at``, taken as late (or as early) as what is known allows."""
        if at <= 0:
            return 0
        i = bisect_left(self.ends, at)
        return at if hopeful and self.ends[i] != at and self.open(i - 1) else self.ends[i]

    def between(self, low: int, high: int) -> list[int]:
        """Runs of several groups that hold bytes strictly inside ``low..high`` or around it."""
        i = max(0, bisect_right(self.ends, low) - 1)
        j = max(i, bisect_left(self.ends, high) - 1)
        return [k for k in range(i, min(j, len(self.runs) - 1) + 1) if self.open(k)]


class Search:
    """The smallest capacity at which greedy filling needs no more than ``shards`` shards, and cuts that keep to it."""

    def __init__(self, cells: Cells, shards: int):
        self.cells, self.shards = cells, shards
        self.cuts: list[int] = []

    def filled(self, capacity: int, hopeful: bool) -> list[int]:
        """Ends of the shards filled greedily from the left."""
        at, ends = 0, []
        for _ in range(self.shards):
            at = self.cells.down(at + capacity, hopeful)
            ends.append(at)
        return ends

    def filled_back(self, capacity: int, hopeful: bool) -> list[int]:
        """The earliest end of each shard from which the ones after it can take the rest."""
        at, ends = self.cells.total, []
        for _ in range(self.shards):
            ends.append(at)
            at = self.cells.up(at - capacity, hopeful)
        return ends[::-1]

    def smallest_capacity(self, hopeful: bool) -> int:
        total = self.cells.total
        low, high = -(-total // self.shards), total
        while low < high:
            middle = (low + high) // 2
            if self.filled(middle, hopeful)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def unknown(self) -> list[tuple[int, int]]:
        """Stretches of runs that must be known more finely; none once ``cuts`` are settled."""
        cells = self.cells
        low, high = self.smallest_capacity(True), self.smallest_capacity(False)
        wanted: set[int] = set()
        if low < high:
            for a, b in zip(self.filled(low, False), self.filled(high, True), strict=True):
                wanted.update(cells.between(a, b))
        else:
            for a, b in zip(self.filled_back(low, True), self.filled_back(low, False), strict=True):
                wanted.update(cells.between(a, b) if a < b else ())
            for j in range(1, self.shards):
                even = cells.total * j // self.shards
                if cells.down(even, True) != cells.down(even, False):
                    wanted.update(cells.between(even, even + 1))
        if not wanted:
            wanted = self._settle(low)
        stretches: list[tuple[int, int]] = []
        for i in sorted(wanted):
            if stretches and stretches[-1][1] == i - 1:
                stretches[-1] = (stretches[-1][0], i)
            else:
                stretches.append((i, i))
        return stretches

    def _settle(self, capacity: int) -> set[int]:
        cells, at, cuts = self.cells, 0, []
        earliest = self.filled_back(capacity, False)
        for j in range(1, self.shards):
            even = cells.total * j // self.shards
            before, after = cells.down(even, False), cells.up(even, False)
            best = before if even - before <= after - even else after
            if best > at + capacity:
                i = bisect_right(cells.ends, at + capacity) - 1
                if cells.open(i):
                    return {i}
                best = cells.ends[i]
            at = max(best, earliest[j - 1], at)
            cuts.append(bisect_left(cells.ends, at))
        self.cuts = cuts
        return set()


def _shard_of(place: Column, alone: list[int], cuts: list[int]) -> Column:
    """Number of the shard: those of single groups first, then by the cuts at or before the place, halving them."""

    def halves(low: int, high: int) -> Column:
        if low == high:
            return F.lit(len(alone) + low)
        middle = (low + high) // 2
        return F.when(place < F.lit(cuts[middle]), halves(low, middle)).otherwise(halves(middle + 1, high))

    value = halves(0, len(cuts))
    for shard, single in enumerate(alone):
        value = F.when(place == F.lit(single), F.lit(shard)).otherwise(value)
    return value.cast("int")
