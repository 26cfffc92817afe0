import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logarc.llm.merkle import lowered_ids, manifest
from logarc.llm.numbering import places_in_groups

from .fixtures import awkward, doc, empty, frame, prose

UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    framed = ""
    for value in (row[0], row[3], row[2], row[4], text):
        framed += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(framed)


def climb(nodes, fanout):
    """The root, and for each node the (before, after) of its runs on the way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, slot = runs[i // fanout], i % fanout
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at = [i // fanout for i in at]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows, fanout=8, tamper=True):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        leaves = sorted(((leaf_of(r, r[1]), r) for r in rows if r[2] == lang), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append((leaves, *climb([h for h, _ in leaves], fanout)))
    root, tops = climb([t[1] for t in trees], fanout)
    out = Counter()
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for (leaf, row), path in zip(leaves, paths, strict=True):
            lowers = tamper and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            h = leaf_of(row, row[1].translate(UPPER)) if lowers else leaf
            for before, after in path + top:
                h = sha(before + h + after)
            proof = sha("".join(a + b for a, b in path + top))
            out[(row[0], leaf, subroot, root, proof, h, h == root)] += 1
    return out


def many(n, langs, seed=0):
    draw = random.Random(seed)
    return [doc(i, f"Word {prose(i, 5)} Ünï", draw.choice(langs), f"s{i % 3}") for i in range(n)]


@pytest.mark.parametrize(
    ("rows", "fanout"),
    [
        (awkward(), 8),
        (many(200, ["en"]), 8),
        (many(65, ["en", None, "de"]), 8),
        (many(150, [f"l{i}" for i in range(70)] + ["é", "z", ""]), 8),
        (many(40, ["en", "de"]), 3),
        (many(8, ["en"]) + many(1, ["de"]), 8),
        (many(1, ["en"]), 8),
        (many(30, ["en"]) * 4, 2),
    ],
)
def test_all_columns_follow_the_trees(spark, rows, fanout):
    found = manifest(frame(spark, rows), fanout=fanout)
    assert Counter(map(tuple, found.collect())) == brute(rows, fanout, tamper=False)


def test_tampering_is_found(spark):
    rows = awkward() + many(300, ["en", "fr", None], seed=3)
    found = manifest(frame(spark, rows), tampered=lowered_ids(F.col("doc_id"))).collect()
    assert Counter(map(tuple, found)) == brute(rows)
    assert 0 < sum(not r.verified for r in found) < len(rows)


def test_partitioning_changes_nothing(spark):
    rows = many(500, ["en"] * 9 + ["de", None], seed=5)
    results = [Counter(map(tuple, manifest(frame(spark, rows, parts)).collect())) for parts in (1, 7)]
    assert results[0] == results[1]


def test_empty_table(spark):
    found = manifest(empty(spark))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.collect() == []


def test_places_in_groups_with_one_hot_group(spark):
    rows = [(i, 0 if i % 3 else i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "v long, g int").repartition(5)
    found = places_in_groups(df, "g", ["v"]).collect()
    for group in {g for _, g in rows}:
        own = sorted(v for v, g in rows if g == group)
        assert sorted((r.pos, r.v) for r in found if r.g == group) == list(enumerate(own))
        assert {r.n for r in found if r.g == group} == {len(own)}
