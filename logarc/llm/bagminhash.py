"""Near duplicates by weighted Jaccard similarity: BagMinHash signatures, banding, exact check, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, hinted, mix, ranges, stored, text_key, window_hashes, windows, words_of

SHINGLE = 5
THRESHOLD = 0.8
# 20 bands of 5 registers: a pair at the threshold shares some band with probability 0.9996.
BANDS, ROWS = 20, 5
# Buckets of at most so many different texts are compared in full; larger ones with leaders, round by round.
SMALL_BUCKET = 32
# Texts that are near no leader are compared by sketches of so many registers, in groups of at most so many texts.
SKETCH, SKETCH_GROUP = 400, 1000
# Texts of each side, roughly, that are compared at once at the border of a leader.
BORDER_BLOCK = 1000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


# --- signatures --------------------------------------------------------------


def shingle_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct word shingle. A text of fewer words than a shingle is one shingle."""
    words = words_of(column, lower=True)
    hashes, size, row = words.hashes, np.diff(words.first), words.row
    at = windows(words.first, SHINGLE)
    rows, keys = [row[at]], [window_hashes(hashes, at, tuple(range(SHINGLE)))]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(size == n)
        rows.append(short)
        keys.append(window_hashes(hashes, words.first[short], tuple(range(n))))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    opens = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[opens], k[opens], np.diff(np.append(opens, len(r)))


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash registers of each row, as 64-bit names of points; 0 for a row without elements.

    Each element carries one Poisson process of unit rate over time and weight,
    split into the weight intervals [0, 1), [1, 2), [2, 4), [4, 8) and so on; an
    interval's points are drawn from the element and the interval alone. Of an
    interval that the weight cuts, points with a mark above the weight are thinned
    out. Each point falls into one register, and a register keeps its earliest point,
    so two bags agree in a register with probability sum(min) / sum(max).

    Points are drawn up to a time at which all registers are likely filled; rows with
    an empty one are drawn on to twice that time, so the result is exact.
    """
    out = np.zeros((rows, m), np.uint64)
    total = np.bincount(row, weight, minlength=rows)
    element, low, high = _intervals(weight)
    until = np.where(total > 0, m / np.maximum(total, 1) * (np.log(m) + 4), 0.0)
    best = np.full((rows, m), np.inf)
    open_rows = total > 0
    while open_rows.any():
        chosen = np.flatnonzero(open_rows[row[element]])
        e = element[chosen]
        r, span = row[e], (high - low)[chosen].astype(float)
        left, w = low[chosen].astype(float), weight[e].astype(float)
        state = mix(key[e] + (low[chosen].astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        best[open_rows] = np.inf
        time = np.zeros(len(e))
        parts = []
        while len(r):
            state = state + _GOLDEN
            first = mix(state)
            time = time - np.log(((first >> np.uint64(11)).astype(float) + 0.5) * _UNIT) / span
            alive = time <= until[r]
            if not alive.all():
                r, span, left, w, state, time, first = (x[alive] for x in (r, span, left, w, state, time, first))
            second = mix(first ^ np.uint64(0xD1B54A32D192ED03))
            mark = left + span * ((second >> np.uint64(32)).astype(float) * 2.0**-32)
            under = mark < w
            register = ((second & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            parts.append((r[under] * m + register[under], time[under], first[under]))
        place, at, name = (np.concatenate(x) for x in zip(*parts, strict=True))
        np.minimum.at(best.reshape(-1), place, at)
        earliest = best.reshape(-1)[place] == at
        out.reshape(-1)[place[earliest]] = name[earliest]
        open_rows &= np.isinf(best).any(axis=1)
        until = until * 2
    return out


def _intervals(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element its weight intervals: element number, lower and upper bound."""
    count = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(weight)), count)
    level = ranges(count)
    high = np.int64(1) << level
    return element, np.where(level == 0, 0, high >> 1), high


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signature), band + 1, np.uint64)
        for k in range(ROWS):
            key = mix(key * _GOLDEN + signature[:, band * ROWS + k])
        out[:, band] = key
    return out


def signed(texts: DataFrame) -> DataFrame:
    """``h1, h2, bands`` of rows ``h1, h2, text``; a text without words has no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            row, key, weight = shingle_bags(batch.column("text"))
            keys = band_keys(signatures(row, key, weight, batch.num_rows)).view(np.int64)
            some = np.bincount(row, minlength=batch.num_rows) > 0
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), bands], ["h1", "h2", "bands"])

    return texts.mapInArrow(sign, "h1 long, h2 long, bands array<long>")


# --- exact similarity --------------------------------------------------------


def weighted_jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle bags, row by row; 0 where both are empty."""
    rows = len(left)
    a, b = shingle_bags(left), shingle_bags(right)
    row, key, weight = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((key, row))
    r, k, w = row[order], key[order], weight[order]
    twin = np.flatnonzero((r[1:] == r[:-1]) & (k[1:] == k[:-1]))
    both = np.bincount(r[twin], np.minimum(w[twin], w[twin + 1]), minlength=rows)
    either = np.bincount(row, weight, minlength=rows) - both
    return both / np.maximum(either, 1)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs of nodes. The side with a hot node is the one the join may split."""
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right, "b").join(left, "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_b"):
            value = weighted_jaccard(batch.column("text_a"), batch.column("text_b"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value)], ["a", "b", "similarity"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


# --- links and classes -------------------------------------------------------


def near_links(rows: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified links ``a, b`` (a < b) between different texts that share a bucket, and ``leader, node, similarity``.

    ``rows`` are ``bucket, node, size, weight``: the bucket's size, and the sizes of all buckets of the node.
    Small buckets are compared in full. In a larger one every text is compared with a
    leader: those similar to it are linked through it and leave. The one to lead is the
    text that meets most others, over all its buckets: the one that near copies were
    made from meets them all, so a group of near copies costs a comparison per text,
    not per pair. Of those left, groups of at most ``SKETCH_GROUP`` are compared by long
    sketches inside a task, which lets through only pairs that may reach the
    threshold; larger ones go on with leaders, twice as many in each round.

    A text that left is not compared with those that stayed. The second table is for
    the links between them (``_border_links``): all texts compared with a leader, down to
    the similarity at which one may still be near a text that is near the leader.
    """
    links, checked, leads, leaders_each = None, None, None, 1
    while True:
        most = SKETCH_GROUP if checked is not None else SMALL_BUCKET
        small, large = rows.filter(F.col("size") <= most), rows.filter(F.col("size") > most)
        kind = F.pmod(F.xxhash64("node"), F.lit(leaders_each)).alias("kind")
        first = F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("first")
        leaders = large.groupBy("bucket", kind).agg(first).select("bucket", (-F.col("first.node")).alias("leader"))
        leaders = stored(leaders, "leaders")
        led = stored(large.join(leaders, "bucket").filter("node != leader").select("bucket", "node", "weight", "leader"), "led")
        other = small.select("bucket", F.col("node").alias("b"))
        inside = small.select("bucket", F.col("node").alias("a")).join(other, "bucket").filter("a < b").select("a", "b")
        inside = inside if checked is None else _sketched_pairs(small, texts, threshold)
        ends = [F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")]
        wanted = inside.unionByName(led.select(*ends)).distinct()
        if checked is not None:
            wanted = wanted.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        fresh = stored(_similar(wanted, texts), "similarities")
        checked = fresh if checked is None else checked.unionByName(fresh)
        links = checked.filter(F.col("similarity") >= threshold).select("a", "b")
        pairs = led.select("leader", "node").distinct()
        leads = pairs if leads is None else leads.unionByName(pairs)
        if not leaders.take(1):
            leads = leads.distinct().select("leader", "node", *ends).join(checked, ["a", "b"])
            return links, leads.filter(F.col("similarity") >= _border(threshold)).select("leader", "node", "similarity")
        rows = stored(_still_open(led, leaders, links), "buckets")
        leaders_each *= 2


def near_roots(nodes: DataFrame, texts_of, threshold: float = THRESHOLD) -> DataFrame:
    """``node, root`` of every node of ``nodes`` (``node, bands``) that is linked: the smallest node of its class.

    ``texts_of`` gives ``node, text`` of a table of nodes. Classes come from the links of
    ``near_links``; then the texts at the border of a leader that are in another class are
    compared with the texts near it, and classes that such a link connects are one.
    """
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    keyed = banded.select(F.xxhash64("band", "key").alias("bucket"), "node")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    met = stored(keyed.join(sizes, "bucket"), "met")
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    rows = stored(met.join(weights, "node"), "buckets")
    texts = stored(texts_of(weights.select("node")), "bucket-texts")
    links, leads = near_links(rows, texts, threshold)
    roots = stored(components(links), "roots")
    more = stored(_border_links(leads, roots, texts, threshold), "border-links")
    if not more.take(1):
        return roots
    joined = stored(components(more), "joined").select(F.col("node").alias("root"), F.col("root").alias("to"))
    alone = joined.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(alone).join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _border(threshold: float) -> float:
    """The least similarity with a leader at which a text may be near one that is near the leader (less a rounding)."""
    return 2 * threshold - 1 - 1e-9


def _border_links(leads: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: roots of classes that are linked by a text near a leader and one that is not.

    One less the weighted Jaccard similarity is a metric, so a text y near a text x that is
    near the leader L has a similarity of at least ``2 * threshold - 1`` with L, and those of
    x and y with L differ by at most ``1 - threshold``. What is in the class of L already
    needs no comparison, which leaves few texts y. They and the texts x near L are cut into blocks
    by hash; a task compares a pair of blocks exactly. The texts x are one class, so each
    y gives one row at most, whether it is near one of them or all.
    """
    rooted = leads.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = leads.select(F.col("leader").alias("node")).distinct().join(roots, "node", "left")
    heads = stored(heads.select(F.col("node").alias("leader"), F.coalesce("root", "node").alias("head")), "heads")
    rooted = stored(rooted.join(hinted(heads, 24), "leader"), "rooted-leads")
    outside = rooted.filter((F.col("similarity") < threshold) & (F.col("root") != F.col("head")))
    fringe = stored(outside.groupBy("leader").agg(F.max("similarity").alias("most")), "fringes")
    if not fringe.take(1):
        return fringe.select(F.col("leader").alias("a"), F.col("leader").alias("b"))
    near = rooted.filter(F.col("similarity") >= threshold).join(hinted(fringe, 24), "leader")
    near = near.filter(F.col("similarity") <= F.col("most") + 1 - threshold + 1e-9).select(*rooted.columns)
    members = stored(outside.unionByName(near).join(texts, "node"), "border")
    is_near = F.col("similarity") >= threshold

    def blocks(side: Column) -> Column:
        count, size = F.count(F.when(side, 1)), F.sum(F.when(side, F.octet_length("text")))
        return F.ceil(F.greatest(count / BORDER_BLOCK, size / CHUNK_BYTES)).cast("int")

    sizes = members.groupBy("leader").agg(blocks(is_near).alias("inners"), blocks(~is_near).alias("outers"))
    sizes = stored(sizes.filter("inners > 0 AND outers > 0"), "border-sizes")
    own = F.pmod(F.xxhash64("node"), F.when(is_near, F.col("inners")).otherwise(F.col("outers"))).cast("int").alias("own")
    others = F.explode(F.sequence(F.lit(0), F.when(is_near, F.col("outers")).otherwise(F.col("inners")) - 1)).alias("other")
    dealt = members.join(hinted(sizes, 16), "leader").select("leader", "similarity", "root", "head", "text", own, others)
    inner, outer = (F.when(is_near, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("own", "other", "inner"), ("other", "own", "outer")))

    def compare(group: pa.Table) -> pa.Table:
        similarity = group.column("similarity").to_numpy()
        row, key, weight = shingle_bags(group.column("text"))
        n = group.num_rows
        total, first = np.bincount(row, weight, minlength=n), np.searchsorted(row, np.arange(n + 1))
        at = np.flatnonzero(similarity[row] >= threshold)
        at = at[np.argsort(key[at], kind="stable")]
        keys, owner, counts = key[at], row[at], weight[at]
        found = []
        for i in np.flatnonzero(similarity < threshold):
            mine = slice(first[i], first[i + 1])
            begin = np.searchsorted(keys, key[mine])
            size = np.searchsorted(keys, key[mine], side="right") - begin
            met = np.repeat(begin, size) + ranges(size)
            both = np.bincount(owner[met], np.minimum(counts[met], np.repeat(weight[mine], size)), minlength=n)
            if (both / np.maximum(total + total[i] - both, 1) >= threshold).any():
                found.append(i)
        ends = group.select(["head", "root"]).take(pa.array(found, pa.int64()))
        return ends.rename_columns(["a", "b"])

    grouped = dealt.select("leader", inner, outer, "similarity", "root", "head", "text").groupBy("leader", "inner", "outer")
    return grouped.applyInArrow(compare, "a long, b long").distinct()


def _sketched_pairs(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a bucket whose sketches agree in all but five standard errors of the threshold, or more."""
    least = threshold - 5 * (threshold * (1 - threshold) / SKETCH) ** 0.5

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            row, key, weight = shingle_bags(batch.column("text"))
            made = signatures(row, key, weight, batch.num_rows, SKETCH).astype("<u4")
            parts = pa.array([x.tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), parts], ["node", "sketch"])

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        made = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u4").reshape(-1, SKETCH)
        a, b = [], []
        for i in range(len(node) - 1):
            near = i + 1 + np.flatnonzero((made[i + 1 :] == made[i]).mean(axis=1) >= least)
            a.append(np.minimum(node[i], node[near]))
            b.append(np.maximum(node[i], node[near]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    wanted = rows.select("node").distinct()
    sketches = stored(texts.join(wanted, "node").select("node", "text").mapInArrow(sketch, "node long, sketch binary"), "sketches")
    return rows.select("bucket", "node").join(sketches, "node").groupBy("bucket").applyInArrow(compare, "a long, b long")


def _still_open(led: DataFrame, leaders: DataFrame, links: DataFrame) -> DataFrame:
    """Texts of large buckets that lead none and are not linked to a leader of theirs."""
    ends = led.withColumns({"a": F.least("leader", "node"), "b": F.greatest("leader", "node")})
    linked = ends.join(links, ["a", "b"], "left_semi").select("bucket", "node")
    gone = linked.unionByName(leaders.select("bucket", F.col("leader").alias("node")))
    members = led.groupBy("bucket", "node").agg(F.first("weight").alias("weight"))
    kept = members.join(gone, ["bucket", "node"], "left_anti")
    sizes = kept.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return kept.join(sizes, "bucket").select("bucket", "node", "size", "weight")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` of every node that has a link: the smallest node connected with it.

    Large-star and small-star steps in turn: each node points all larger neighbours,
    then all smaller ones, to the smallest it knows. The steps are minima by key,
    combined before the shuffle, and joins whose large side may be split.
    """
    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        larger = stored(larger, "large-star")
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stored(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size``, one row out for each row in.

    ``class_id`` is the smallest ``doc_id`` among the texts connected by links of
    weighted Jaccard similarity ``threshold`` or more over word 5-shingles (words in
    lower case A-Z, a shingle counted as often as it stands). Equal texts are one node, so
    copies cost nothing. Null and empty texts, and those without words, are classes of
    their own, each row for itself. Repeated rows are copies; a null id counts as the
    largest, and a class of null ids alone has a null ``class_id``.
    """
    classes = _classes(docs, text, threshold)
    h1, h2 = text_key(text)
    rows = docs.select(docs[doc_id].alias("doc_id"), h1, h2)
    joined = rows.join(classes, ["h1", "h2"], "left")
    ids = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = joined.filter("root IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return joined.filter("root IS NOT NULL").join(ids, "root").select("doc_id", "class_id", "class_size").unionByName(alone)


def _classes(docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """``h1, h2, root`` of every text with words; texts are nodes, numbered once in a stored table."""
    texts = docs.select(*text_key(text), docs[text].alias("text"))
    sketch = stored(signed(texts), "signatures").filter("size(bands) > 0")
    nodes = stored(sketch.dropDuplicates(["h1", "h2"]).withColumn("node", F.monotonically_increasing_id()), "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        keys = nodes.select("node", "h1", "h2").join(wanted, "node")
        return texts.join(hinted(stored(keys, "wanted"), 24), ["h1", "h2"]).select("node", "text").dropDuplicates(["node"])

    roots = near_roots(nodes, texts_of, threshold)
    return stored(
        nodes.select("node", "h1", "h2").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root")), "classes"
    )


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the smallest ``doc_id``, with all its columns; texts without words all stay.

    Among rows of one id the smallest text key decides, and of equal rows one stays.
    """
    classes = _classes(docs, text, threshold)
    h1, h2 = text_key(text)
    place = F.struct(F.col(doc_id).isNull().alias("null_id"), F.col(doc_id).alias("id"), h1, h2)
    first = docs.select(h1, h2, place.alias("place")).join(classes, ["h1", "h2"]).groupBy("root").agg(F.min("place").alias("place"))
    chosen = stored(first.select(F.col("place.id").alias("_near_id"), F.col("place.h1").alias("_near_h1"), F.col("place.h2").alias("_near_h2")), "chosen")
    keyed = docs.withColumns({"_near_k1": h1, "_near_k2": h2})
    same = (F.col("_near_k1") == F.col("_near_h1")) & (F.col("_near_k2") == F.col("_near_h2")) & F.col(doc_id).eqNullSafe(F.col("_near_id"))
    with_words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    kept = keyed.filter(with_words).join(chosen, same, "left_semi").dropDuplicates(["_near_k1", "_near_k2", doc_id])
    return kept.select(*docs.columns).unionByName(docs.filter(~with_words))
