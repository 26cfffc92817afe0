"""Retrieval packing: related documents brought together, windows filled with a seed and its nearest unused neighbours by BM25."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_ids
from .common import hinted, partitions_for, ranges, stored
from .encoding import encoded, encoder

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
# Documents of one index shard, and tokens at which a shard is closed early.
SHARD_DOCS = 2048
SHARD_TOKENS = 1 << 22
# Bytes of ids in one partition of shards, roughly.
PARTITION_BYTES = 64 * 1024 * 1024
# Documents whose ids are marked at once when document frequencies are counted.
MARKED_DOCS = 128
# Sorted orders in which documents look for neighbours, min-hashed ids an order sorts by, and rows looked at on each side.
TREES, DEPTH, NEAR_ROWS = 8, 4, 8
# Lists of at least one in so many documents of a shard are kept as rows of weights, the longest first, up to so many weights.
DENSE_SHARE, DENSE_WEIGHTS = 8, 1 << 21
# Rounds of doubled steps along nearest neighbours.
FOLLOWED = 5


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    text: str = "text",
    doc_id: str = "doc_id",
    shard_docs: int = SHARD_DOCS,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """One row per piece of a document in a window of ``window`` ids.

    Full windows of a long document stand alone; what remains of each document is
    packed by retrieval. Related documents of the whole corpus are brought together
    first (``_placed``) and cut into shards of ``shard_docs`` rows of that order,
    whatever files they came from: the index of a shard is inverted lists of
    token ids with BM25 weights (document frequencies and mean length of the whole
    corpus). The next unused document seeds a window, its neighbours fill it best
    first where they fit whole, then one is cut at the end of the window and its rest
    stays unused. The last window of a shard is laid out in powers of two, so
    nothing is padded. Ids with a frequency above half of all documents weigh
    nothing (the classical idf is not positive) and are not indexed.

    Null text: empty, thus one end id. Repeated rows are packed each for itself; a
    null ``doc_id`` is kept. Texts of any length are packed whole. Equally good neighbours go by
    their order in the shard. An empty table gives no rows. Other columns are ignored.
    """
    coded = encoded(docs, tokenizer, text, doc_id).select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    coded = stored(coded, "tokens")
    coder = encoder(tokenizer)
    width = coder.dtype.itemsize
    idf, mean, n = _statistics(coded, width, coder.tokenizer.get_vocab_size())
    rates = coded.sparkSession.sparkContext.broadcast(idf)  # one number for each id of the vocabulary

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = -1, 0
        for shard, ids, docs_of_shard, counts in _shards(batches, width, shard_docs):
            last, number = shard, number if shard == last else shard << 32
            pieces, number = _pack_shard(ids, counts, window, rates.value, mean, k1, b, number)
            yield _rows(pieces, ids, docs_of_shard, counts)

    kind = coded.schema["doc_id"].dataType.simpleString()
    places = _placed(stored(_sketched(coded, width, window, rates, mean, k1, b), "sketches"))
    ordered = coded.join(hinted(places, 24, n), "row")
    # As many partitions as the session shuffles to, more only where they would hold too many ids; never one a shard.
    shards = partitions_for(n, shard_docs)
    wanted = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_for(int(mean * n * width), PARTITION_BYTES))
    in_each = -(-shards // min(shards, wanted))
    ordered = ordered.repartitionById(-(-shards // in_each), F.floor(F.col("pos") / (shard_docs * in_each)).cast("int"))
    return ordered.sortWithinPartitions("pos").select("doc_id", "ids", "pos").mapInArrow(pack, f"doc_id {kind}, {PIECES}")


def _ids(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("ids").cast(pa.large_binary())
    place = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], f"<u{width}")[place[0] // width : place[-1] // width], np.diff(place) // width


def _statistics(coded: DataFrame, width: int, vocabulary: int) -> tuple[np.ndarray, float, int]:
    """Inverse document frequency of every id, the mean length and the number of documents. At most one row per id comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, tokens = np.zeros(vocabulary, np.int64), 0, 0
        present = np.zeros((MARKED_DOCS, vocabulary), bool)
        marks = present.reshape(-1)
        for batch in batches:
            ids, counts = _ids(batch, width)
            stop = np.concatenate([[0], np.cumsum(counts)])
            for begin in range(0, len(counts), MARKED_DOCS):
                some = counts[begin : begin + MARKED_DOCS]
                own = ids[stop[begin] : stop[begin + len(some)]]
                at = np.repeat(np.arange(len(some)) * vocabulary, some) + own
                marks[at] = True
                seen += present[: len(some)].sum(axis=0)
                marks[at] = False
            n, tokens = n + len(counts), tokens + len(ids)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, [-1, -2])), pa.array(np.append(seen[at], [n, tokens]))], ["id", "n"]
        )

    rows = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    found = {row.id: row.n for row in rows}
    n, tokens = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(max(found, default=0) + 1, np.float32)
    for token, df in found.items():
        idf[token] = max(0.0, math.log((n - df + 0.5) / (df + 0.5)))
    return idf, tokens / max(n, 1), n


def _sketch(ids: np.ndarray, doc: np.ndarray, counts: np.ndarray, idf: np.ndarray, draws: np.ndarray, mean: float, k1: float, b: float):
    """``TREES`` sort keys of ``DEPTH`` ids for each document, and whether it has a weighted id at all.

    A register holds the id with the smallest draw over BM25 weight, so an id takes it
    with its share of the document's weight, and documents agree in a register the more
    likely the more weight they share. The first register is a key's highest part.
    """
    out = np.zeros((len(counts), TREES * DEPTH), np.uint16)
    keep = idf[ids] > 0
    pair, tf = np.unique(doc[keep] << 32 | ids[keep].astype(np.int64), return_counts=True)
    term, own = pair & 0xFFFFFFFF, pair >> 32
    norm = k1 * (1 - b + b * counts[own] / max(mean, 1e-9))
    weight = (idf[term] * tf * (k1 + 1) / (tf + norm)).astype(np.float32)
    some = np.zeros(len(counts), bool)
    if len(term):
        opens = np.flatnonzero(np.diff(own, prepend=-1))
        value = draws[term] / weight[:, None]
        least = np.minimum.reduceat(value, opens, axis=0)
        at, register = np.nonzero(value == np.repeat(least, np.diff(np.append(opens, len(own))), axis=0))
        # 16 bits of an id; ids beyond are folded in by their upper bits, so unequal ones agree by chance once in 65,536.
        out[own[at], register] = (term[at] ^ (term[at] >> 16) * 0x9E37).astype(np.uint16)
        some[own[opens]] = True
    keys = np.ascontiguousarray(out.reshape(-1, TREES, DEPTH)[:, :, ::-1]).view("<i8")
    return keys.reshape(-1, TREES), some


def _sketched(coded: DataFrame, width: int, window: int, rates, mean: float, k1: float, b: float) -> DataFrame:
    """``row, keys, some`` of every row: its sketch without the full windows at its beginning."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = rates.value
        draws = np.random.default_rng(11).standard_exponential((len(idf), TREES * DEPTH), np.float32)
        for batch in batches:
            for begin in range(0, batch.num_rows, MARKED_DOCS):
                part = batch.slice(begin, MARKED_DOCS)
                ids, counts = _ids(part, width)
                start = counts // window * window
                left = counts - start
                rest = ids[np.repeat(np.cumsum(counts) - counts + start, left) + ranges(left)]
                keys, some = _sketch(rest, np.repeat(np.arange(len(left)), left), left, idf, draws, mean, k1, b)
                offsets = pa.array(np.arange(len(left) + 1, dtype=np.int32) * TREES)
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("row"), lists, pa.array(some)], ["row", "keys", "some"])

    return coded.select("ids", "row").mapInArrow(sketch, "row long, keys array<long>, some boolean")


def _nearest(sketches: DataFrame) -> DataFrame:
    """``a, b``: each row with the neighbour that agrees with it in most registers, of the whole corpus.

    All rows are sorted by each of their keys in turn, so those that share the longest
    beginning of a key stand together however many rows there are, and each is compared
    with ``NEAR_ROWS`` rows before and after it. The order is by key and row: no key is hot.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, TREES * DEPTH), np.uint16))
        tree, row, sketch = none
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy(zero_copy_only=False)
            held = len(row)
            tree = np.concatenate([tree, batch.column("tree").to_numpy()])
            row = np.concatenate([row, batch.column("row").to_numpy()])
            sketch = np.concatenate([sketch, keys.view(np.uint16).reshape(-1, TREES * DEPTH)])
            best, other = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            for step in range(1, NEAR_ROWS + 1):
                i = np.arange(max(0, held - step), len(row) - step)
                i = i[tree[i] == tree[i + step]]
                agree = (sketch[i] == sketch[i + step]).sum(axis=1)
                for one, two in ((i, i + step), (i + step, i)):
                    better = agree > best[one]
                    best[one[better]], other[one[better]] = agree[better], row[two[better]]
            found = best > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (row, best, other)], ["a", "agree", "b"])
            tree, row, sketch = (x[-NEAR_ROWS:] for x in (tree, row, sketch))

    keyed = sketches.filter("some").select("row", "keys", F.posexplode("keys").alias("tree", "key"))
    order = [F.col("tree"), F.col("key"), F.col("row")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = ranged.select("row", "keys", F.col("tree").cast("long").alias("tree")).mapInArrow(compare, "a long, agree long, b long")
    nearest = pairs.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("best"))
    return nearest.select("a", F.col("best.b").alias("b"))


def _clusters(nearest: DataFrame) -> DataFrame:
    """``row, root``: rows that come to the same pair of mutual neighbours by following nearest neighbours.

    Steps double in each round, so a path of ``2 ** FOLLOWED`` neighbours is followed; what is
    further apart begins a cluster of its own, near by in the order of the keys. At most
    ``4 * TREES * NEAR_ROWS`` rows have one row as their nearest, so no row gathers more than its rounds allow.
    """
    first = stored(nearest, "nearest")
    reached = first
    for _ in range(FOLLOWED):
        reached = stored(reached.join(reached.select(F.col("a").alias("b"), F.col("b").alias("further")), "b").select("a", F.col("further").alias("b")), "followed")
    back = first.select(F.col("a").alias("b"), F.col("b").alias("mate"))
    return reached.join(back, "b").select(F.col("a").alias("row"), F.least("b", "mate").alias("root"))


def _placed(sketches: DataFrame) -> DataFrame:
    """``row, pos``: dense places of all rows, rows connected by nearest neighbours one after the other.

    Clusters follow each other by the key of their root, so related clusters are near by
    too; one larger than a shard is cut in the order of its rows' own keys.
    """
    roots = _clusters(_nearest(sketches))
    own = sketches.select("row", F.col("keys")[0].alias("key"))
    rooted = stored(own.join(roots, "row", "left").select("row", "key", F.coalesce("root", "row").alias("root")), "clusters")
    heads = own.select(F.col("row").alias("root"), F.col("key").alias("head"))
    return dense_ids(rooted.join(heads, "root"), ["head", "root", "key", "row"], "pos").select("row", "pos")


def _shards(batches: Iterator[pa.RecordBatch], width: int, docs: int) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Number, ids, document ids and lengths of one shard after the other; one with too many ids comes in parts.

    Rows come in the order of ``pos``, whole shards in one partition.
    """
    held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
    shard = tokens = 0

    def take():
        return shard, np.concatenate([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held])

    for batch in batches:
        begin = 0
        ids, counts = _ids(batch, width)
        stop = np.cumsum(counts)
        places = batch.column("pos").to_numpy()
        while begin < batch.num_rows:
            done = stop[begin - 1] if begin else 0
            shard, row = divmod(int(places[begin]), docs)
            end = min(begin + docs - row, int(np.searchsorted(stop, done + SHARD_TOKENS - tokens)) + 1, batch.num_rows)
            held.append((ids[done : stop[end - 1]], batch.column("doc_id").slice(begin, end - begin), counts[begin:end]))
            full = row + end - begin >= docs
            tokens, begin = tokens + int(stop[end - 1] - done), end
            if full or tokens >= SHARD_TOKENS:
                yield take()
                held, tokens = [], 0
    if held:
        yield take()


class _Index:
    """Inverted lists of one shard: for each id, the documents that hold it and their BM25 weights.

    A long list is a row with a weight for each document, zero where it lacks the id: adding
    rows costs a fraction of gathering lists, and equal documents still get equal sums.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float):
        self.n = len(counts)
        keep = idf[ids] > 0
        pair, tf = np.unique(ids[keep].astype(np.int64) << 32 | doc[keep], return_counts=True)
        term, self.doc = pair >> 32, pair & 0xFFFFFFFF
        norm = k1 * (1 - b + b * counts[self.doc] / max(mean, 1e-9))
        self.weight = idf[term] * tf * (k1 + 1) / (tf + norm)
        opens = np.flatnonzero(np.diff(term, prepend=-1))
        self.begin, self.size = opens, np.diff(np.append(opens, len(term)))
        posting = np.cumsum(np.diff(term, prepend=-1) > 0) - 1 if len(term) else term
        order = np.argsort(self.doc, kind="stable")
        self.terms = posting[order]  # of each document, one after the other
        self.first = np.searchsorted(self.doc[order], np.arange(self.n + 1))
        long = np.argsort(-self.size, kind="stable")[: DENSE_WEIGHTS // max(1, self.n)]
        long = long[self.size[long] * DENSE_SHARE >= self.n]
        self.row = np.full(len(opens), -1)
        self.row[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), self.n))
        own = self.row[posting]
        self.dense[own[own >= 0], self.doc[own >= 0]] = self.weight[own >= 0]

    def scores(self, seed: int) -> np.ndarray:
        lists = self.terms[self.first[seed] : self.first[seed + 1]]
        row = self.row[lists]
        lists = lists[row < 0]
        size = self.size[lists]
        at = np.repeat(self.begin[lists], size) + ranges(size)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n) + self.dense[row[row >= 0]].sum(axis=0)


def _pack_shard(ids, counts, window, idf, mean, k1, b, number) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one shard; the next free sequence number."""
    pieces: list[tuple[int, int, int, int, int]] = []
    start = counts // window * window  # of what remains once full windows are cut off
    for doc in np.flatnonzero(start):
        for begin in range(0, int(start[doc]), window):
            pieces.append((int(doc), begin, window, number, 0))
            number += 1
    left = counts - start
    doc = np.repeat(np.arange(len(counts)), left)
    first = np.cumsum(counts) - counts
    rest = ids[np.repeat(first + start, left) + ranges(left)]
    index = _Index(rest, doc, left.copy(), idf, mean, k1, b)
    for seed in range(len(counts)):
        if not left[seed]:
            continue
        placed, gap = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        if gap:
            score = index.scores(seed)
            open_docs = np.flatnonzero(left)
            near = open_docs[np.argsort(-score[open_docs], kind="stable")]
            while gap and len(near):
                fits = near[left[near] <= gap]
                whole = bool(len(fits)) and score[fits[0]] > 0
                take = int(fits[0]) if whole else int(near[0])
                length = min(int(left[take]), gap)
                placed.append((take, int(start[take]), length))
                start[take] += length
                left[take] -= length
                gap -= length
                near = fits[1:] if whole and len(fits) > 1 else near[near != take]
        number = _lay_out(placed, window, pieces, number)
    return pieces, number


def _lay_out(placed, window, pieces, number) -> int:
    """One window if it is full; else sequences of descending powers of two, none of them padded."""
    total = sum(length for _, _, length in placed)
    sizes = [window] if total == window else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    room, offset = sizes.pop(0), 0
    for doc, begin, length in placed:
        while length:
            if offset == room:
                room, offset, number = sizes.pop(0), 0, number + 1
            part = min(length, room - offset)
            pieces.append((doc, begin, part, number, offset))
            begin, length, offset = begin + part, length - part, offset + part
    return number + 1


def _rows(pieces, ids, doc_ids, counts) -> pa.RecordBatch:
    doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    begin = (np.cumsum(counts) - counts)[doc] + start
    data = ids.astype("<u4").tobytes()
    crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
    columns = [doc_ids.take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), counts[doc], sequence, offset))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
