"""Diagonal votes against a plain walk over all k-gram places."""

import random

import pytest

from logarc.llm.license_scan import K, MIN_COVERAGE, SLACK, _grams, _votes, known_templates, license_scan, license_spans, template_positions

from .fixtures import awkward, doc, frame, words
from .test_text_ops import license_tokens


def brute_spans(text, templates):
    tokens, out = license_tokens(text), []
    for label, wording in templates:
        own = license_tokens(wording)
        grams = len(own) - K + 1
        places = {}
        for at in range(grams):
            places.setdefault(tuple(own[at : at + K]), []).append(at)
        votes = [(pos - at, at, pos) for pos in range(len(tokens) - K + 1) for at in places.get(tuple(tokens[pos : pos + K]), [])]
        groups, last = [], None
        for diagonal in sorted({v[0] for v in votes}):
            if last is None or diagonal - last > SLACK:
                groups.append(set())
            groups[-1].add(diagonal)
            last = diagonal
        for group in groups:
            mine = [v for v in votes if v[0] in group]
            first, final = min(v[2] for v in mine), max(v[2] for v in mine) + K - 1
            coverage = len({v[1] for v in mine}) / grams
            if coverage >= MIN_COVERAGE and final - first + 1 <= (grams + K - 1) * 1.5 + 1:
                out.append((label, first, final, round(coverage, 9)))
    return sorted(out)


def full_texts():
    made = [("long-a", " ".join(words(71, 400))), ("long-b", " ".join(words(72, 90))), ("short", "two words"), ("long-b", "Some OTHER, wording here!")]
    made.append(("repeats", " ".join(words(73, 6) * 5)))
    return made + made[:1]


def edited(wording, seed):
    draw, own = random.Random(seed), wording.split()
    for _ in range(max(1, len(own) // 25)):
        k = draw.randrange(len(own))
        own[k : k + draw.randint(0, 2)] = words(seed, draw.randint(0, 2))
    return " ".join(own)


@pytest.mark.parametrize("built_in", [False, True])
def test_spans_are_those_of_a_walk(spark, built_in):
    table = known_templates(spark) if built_in else spark.createDataFrame(full_texts(), "label string, wording string")
    templates = sorted({(r.label, r.wording) for r in table.collect()})
    rows = awkward()
    for i, (_, wording) in enumerate(templates * 3):
        rows.append(doc(200 + i, " ".join([*words(i, i % 9), edited(wording, i), *words(90 + i, 5), wording if i % 4 == 0 else ""])))
    docs = frame(spark, rows)
    found = license_spans(_votes(_grams(docs, "text"), template_positions(table)).distinct()).collect()
    spans = {}
    for r in found:
        spans.setdefault((r.h1, r.h2), []).append((r.label, r.first, r.last, round(r.coverage, 9)))
    wanted = sorted({tuple(brute_spans(r[1], templates)) for r in rows} - {()})
    assert sorted(tuple(sorted(s)) for s in spans.values()) == wanted
    labels = {r.doc_id: set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(","))) for r in license_scan(docs, templates=table).collect()}
    for r in rows:
        if r[0] is not None and r[0] >= 200:
            assert labels[r[0]] <= {s[0] for s in brute_spans(r[1], templates)}
    assert any(labels[r[0]] for r in rows if r[0] is not None and r[0] >= 200)


def test_no_templates(spark):
    none = spark.createDataFrame([], "label string, wording string")
    found = license_scan(frame(spark, [doc(1, "all rights reserved and licensed under cc by 4 0")]), templates=none).collect()
    assert found[0].labels == "cc-by,reserved" and found[0].score == 1.0
