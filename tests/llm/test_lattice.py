import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logarc.llm.lattice import PieceModel, by_length, learn_pieces, load_pieces, log_marginals, piece_keys, score_texts, vocabulary_path

from .fixtures import awkward, doc, empty, frame, prose


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def model_of(pieces: dict[bytes, float]) -> PieceModel:
    names = list(pieces)
    keys = piece_keys(names)
    order = np.argsort(keys)
    total = sum(pieces.values())
    return PieceModel(keys[order], np.log(np.array([pieces[names[i]] for i in order]) / total), max(map(len, names)), -1.0)


def segmentations(word: bytes, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


PIECES = {b" ": 1.0, b" a": 3.0, b"a": 2.0, b"b": 2.0, b"ab": 4.0, b"abb": 0.5, b" ab": 1.5, "é".encode(): 0.7, b"\xc3": 0.1, b"\xa9": 0.2}


def test_marginal_is_the_sum_over_all_segmentations():
    model, total = model_of(PIECES), sum(PIECES.values())
    column = ["abba", "é", "a", "bbab", "abé", "x"]
    for part, block in by_length(pa.array(column)):
        for i, value in zip(part, log_marginals(block, model), strict=True):
            word = b" " + column[i].encode()
            wanted = sum(math.prod(PIECES[p] / total for p in s) for s in segmentations(word, PIECES))
            assert math.isclose(math.exp(value), wanted, rel_tol=1e-9, abs_tol=1e-300)


def test_one_round_of_learning_by_hand(spark):
    model, total = model_of(PIECES), sum(PIECES.values())
    counts = {"abba": 3, "é": 2, "bbab": 1, "unseen": 0}
    learned = learn_pieces(spark.createDataFrame(list(counts.items()), "word string, c long"), 6, model, rounds=1)
    uses = dict.fromkeys(PIECES, 0.1)
    for word, c in counts.items():
        ways = [(s, math.prod(PIECES[p] / total for p in s)) for s in segmentations(b" " + word.encode(), PIECES)] if c else []
        for s, p in ways:
            for piece in s:
                uses[piece] += c * p / sum(x for _, x in ways)
    wanted = model_of(uses)
    assert np.allclose(np.exp(learned.log_p), np.exp(wanted.log_p) * sum(uses.values()) / (sum(uses.values()) + 7))


@pytest.mark.parametrize("block_bytes", [2000, 10**9])
def test_scores(spark, block_bytes):
    rows = awkward() + [doc(100 + i, f"{prose(i % 9, 30)} {prose(i, 5)}") for i in range(40)]
    got = score_texts(frame(spark, rows), vocabulary_path(), block_bytes=block_bytes).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(t for r in rows if not held(r[0]) for t in [*tokens(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: math.log10((counts[t] + 1) / (n + v + 1))
    wanted = Counter()
    for r in rows:
        own = [*tokens(r[1]), None]
        wanted[(r[0], held(r[0]), len(own), sum(counts[t] > 0 for t in own), n, round(sum(map(base, own)), 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == wanted
    assert all(-math.inf < r.score < 0 for r in got)
    shorter = {r.doc_id: r.score for r in got}
    assert shorter[8] < shorter[1] < shorter[11] < shorter[4]
    assert score_texts(empty(spark), vocabulary_path()).collect() == []


def test_learning_raises_the_likelihood(spark):
    rows = [(w, c) for w, c in Counter(tokens(prose(1, 400) + " the and of " * 50)).items()]
    start = load_pieces(vocabulary_path())
    words = spark.createDataFrame(rows, "word string, c long")
    before = None
    for rounds in (0, 1, 2, 3):
        model = learn_pieces(words, 0, start, rounds=rounds) if rounds else start
        total = sum(
            float(log_marginals(block, model) @ np.array([rows[i][1] for i in part]))
            for part, block in by_length(pa.array([w for w, _ in rows]))
        )
        assert before is None or total > before
        before = total
