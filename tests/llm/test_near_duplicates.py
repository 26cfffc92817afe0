from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logarc.llm import bagminhash
from logarc.llm.bagminhash import components, keep_one_of_each, near_duplicates, near_roots, shingle_bags, signatures, weighted_jaccard

from .fixtures import awkward, doc, empty, frame, words


def bag(text):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not tokens:
        return Counter()
    return Counter(tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4)))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    key = lambda x: (x is None, x or 0)
    return Counter((d, min(g, key=key), len(g)) for g in groups.values() for d in g)


def edited(tokens, *places):
    out = list(tokens)
    for k in places:
        out[k] = f"edit{k}"
    return " ".join(out)


def corpus():
    rows = awkward()
    for g in range(6):
        base = words(500 + g, 200)
        rows.append(doc(1000 + g * 100, " ".join(base)))
        rows += [doc(1000 + g * 100 + i, edited(base, 7 * i % 200, 100)) for i in range(1, 2 + g * 8)]
    long_chain = words(900, 300)
    for i in range(12):  # each near the next, the ends far apart
        rows.append(doc(5000 + i, edited(long_chain, *[24 * k for k in range(i)])))
    rows += [doc(6000 + i, " ".join(words(2000 + i, 50))) for i in range(60)]
    rows.append(doc(7000, "same words " * 40))
    rows.append(doc(7001, "same words " * 20))
    rows.append(doc(7002, "same words " * 37))
    return rows


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    got = Counter(tuple(r) for r in near_duplicates(frame(spark, rows)).select("doc_id", "class_id", "class_size").collect())
    assert got == brute_classes(rows)


def test_large_buckets_go_on_with_new_leaders(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "SMALL_BUCKET", 2)
    rows = corpus()
    got = Counter(tuple(r) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == brute_classes(rows)


def one_bucket(spark, texts):
    """Classes of texts that all lie in one bucket, led by the first of them."""
    nodes = spark.createDataFrame([(i, [7]) for i in range(len(texts))], "node long, bands array<long>")
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {r.node: r.root for r in near_roots(nodes, lambda wanted: table.join(wanted, "node")).collect()}
    return [found.get(i, i) for i in range(len(texts))]


def test_a_text_near_one_that_left_with_its_leader(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "SMALL_BUCKET", 2)
    base = words(77, 200)
    texts = [" ".join(base), edited(base, 20, 60, 100), edited(base, 20, 60, 100, 140, 180), " ".join(words(78, 200))]
    assert jaccard(texts[0], texts[2]) < 0.8 <= min(jaccard(texts[0], texts[1]), jaccard(texts[1], texts[2]))
    assert one_bucket(spark, texts) == [0, 0, 0, 3]


@pytest.mark.parametrize("block", [3, 1000])
def test_links_at_the_border_of_leaders(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(bagminhash, "BORDER_BLOCK", block)
    random = np.random.default_rng(3)
    base, texts = words(79, 120), []
    for _ in range(90):  # edits at 12 places, so that some sets of them are close and most are not
        texts.append(edited(base, *random.choice(12, random.integers(0, 6), replace=False) * 10))
    texts = list(dict.fromkeys(texts))
    wanted = {d: c for d, c, _ in brute_classes(list(enumerate(texts)))}
    assert len(set(wanted.values())) > 3
    assert one_bucket(spark, texts) == [wanted[i] for i in range(len(texts))]


def test_one_of_each_class_stays(spark):
    rows = corpus()
    wanted = {c for _, c, _ in brute_classes([r for r in rows if bag(r[1])])}
    kept = keep_one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = kept.collect()
    assert Counter(r.doc_id for r in got if bag(r.text)) == Counter(wanted)
    assert sum(not bag(r.text) for r in got) == sum(not bag(r[1]) for r in rows)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == []
    assert keep_one_of_each(empty(spark)).collect() == []


def test_signatures_estimate_weighted_jaccard():
    random = np.random.default_rng(5)
    keys = random.integers(1, 2**63, 300, dtype=np.uint64)
    a, b = random.integers(0, 20, 300), random.integers(0, 20, 300)
    row, key = np.repeat([0, 1], 300), np.tile(keys, 2)
    weight = np.concatenate([a, b])
    some = weight > 0
    found = signatures(row[some], key[some], weight[some], 2, m=4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)
    assert (found != 0).all()


def test_signature_does_not_depend_on_the_other_rows():
    row, key, weight = shingle_bags(pa.array(["a b c d e f g", None, "x y", "a b c d e f g h"]))
    all_of = signatures(row, key, weight, 4)
    for i in (0, 2, 3):
        own = row == i
        assert (signatures(np.zeros(own.sum(), int), key[own], weight[own], 1)[0] == all_of[i]).all()
    assert (all_of[1] == 0).all()


def test_exact_similarity():
    left = ["a b c d e f", "a a a a a a a a", None, "x"]
    right = ["a b c d e g", "a a a a a a", "", "X"]
    assert np.allclose(weighted_jaccard(pa.array(left), pa.array(right)), [jaccard(a, b) for a, b in zip(left, right, strict=True)])


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 2000), (2000, 1500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 2000: 1000, 1500: 1000}
