import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logarc.llm.common import ranges
from logarc.llm.encoding import WordEncoder, tokenizer_path
from logarc.llm.packing import _clusters, _Index, _lay_out, pack_documents
from logarc.llm.token_counts import context_limits, length_histogram, totals_at

from .fixtures import awkward, doc, empty, frame, prose, words


@pytest.fixture(scope="module")
def whole():
    """Ids of a whole text, encoded in one piece."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_whole_texts(whole):
    texts = ["It's A.B,c!? x'S é. Straßeİ Σσ.", "<|endoftext|> a<|ENDOFTEXT|>b", None, "", "é÷.é", "a　b c 19.5|x"]
    ids, count = WordEncoder(tokenizer_path()).encode(pa.array(texts))
    stop = np.cumsum(count)
    assert [ids[b - n : b].tolist() for b, n in zip(stop, count, strict=True)] == [whole(t) for t in texts]


def test_letters_before_combining_marks_keep_their_case(whole):
    texts = ["H\u0331x T\u0308 J\u030c W\u030a Y\u030a", "h\u0331 H\u0323\u0331 \u00c9\u0331 K\u0323 E\u0301 \u00c9\u00c0h", "BH", "\u0331H"]
    ids, count = WordEncoder(tokenizer_path()).encode(pa.array(texts))
    stop = np.cumsum(count)
    assert [ids[b - n : b].tolist() for b, n in zip(stop, count, strict=True)] == [whole(t) for t in texts]


def test_words_are_known_without_their_case_and_signs(whole):
    texts = ["été Été ÉTÉ été%%% ÉTÉ*** (été) été-été d'été", "x's%'s %s's ''s a<|b _a_ <a>~b~ ×É÷ straSSe ß-ẞ `e ^e e^ e\u0302", "été"]
    coder = WordEncoder(tokenizer_path())
    asked = []
    plain = coder._encode_plain
    coder._encode_plain = lambda words: asked.extend(words) or plain(words)
    ids, count = coder.encode(pa.array([t.replace("<|", "<") for t in texts]))
    stop = np.cumsum(count)
    assert [ids[b - n : b].tolist() for b, n in zip(stop, count, strict=True)] == [whole(t.replace("<|", "<")) for t in texts]
    assert asked.count("été") == 1 and not any("É" in w or "%" in w for w in asked)
    ids, count = coder.encode(pa.array(texts))  # upper case stays where a special token could stand
    stop = np.cumsum(count)
    assert [ids[b - n : b].tolist() for b, n in zip(stop, count, strict=True)] == [whole(t) for t in texts]


def test_every_pair_of_signs_encodes_as_a_whole_text(whole):
    signs = [*map(chr, range(0x20, 0x7F)), *"ÀÉÞßàþÿ×÷ª\u0301\u0331\u0338ẞ٣"]
    texts = [f"{before}{a}{b}{after}" for a in signs for b in signs for before, after in (("", ""), ("a", "s"), ("É", "'s"))]
    coder = WordEncoder(tokenizer_path())
    ids, count = coder.encode(pa.array([t for t in texts if "<|" not in t]))
    stop = np.cumsum(count)
    assert coder.plain
    assert [ids[b - n : b].tolist() for b, n in zip(stop, count, strict=True)] == [whole(t) for t in texts if "<|" not in t]


@pytest.mark.parametrize("shard", [4, 1000])
def test_packing_places_each_id_once(spark, whole, shard):
    rows = awkward() + [doc(100 + i, prose(100 + i, 40 * (i % 60))) for i in range(90)]
    pieces = pack_documents(frame(spark, rows), tokenizer_path(), shard_docs=shard).collect()
    full = [np.array(whole(r[1]) + [1], "<u4") for r in rows]
    wanted, found = Counter(), Counter()
    for r, ids in zip(rows, full, strict=True):
        wanted[r[0]] += len(ids)
    by_id = {r[0]: ids for r, ids in zip(rows, full, strict=True) if sum(x[0] == r[0] for x in rows) == 1}
    windows = {}
    for p in pieces:
        found[p.doc_id] += p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        if p.doc_id in by_id:
            ids = by_id[p.doc_id]
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert found == wanted
    padding = 0
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding == 0


def test_neighbours_are_found_in_all_of_the_corpus(spark):
    topics, each = 40, 6
    rows = []
    for i in range(topics * each):  # those of one topic stand as far apart as they can
        own = words(7000 + i % topics, 60)
        rows.append(doc(i, " ".join(random.Random(i).sample(own, 50))))
    pieces = pack_documents(frame(spark, rows), tokenizer_path(), window=512, shard_docs=16).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, set()).add(p.doc_id)
    mates = {}
    for docs in windows.values():
        for d in docs:
            mates.setdefault(d, set()).update(docs - {d})
    lonely = [d for d in range(len(rows)) if not any(m % topics == d % topics for m in mates[d])]
    assert len(lonely) <= len(rows) // 10


def test_copies_of_one_text_fill_many_shards(spark):
    rows = [doc(i, prose(1, 60)) for i in range(50)] + [doc(100 + i, prose(200 + i, 60)) for i in range(10)]
    pieces = pack_documents(frame(spark, rows), tokenizer_path(), window=256, shard_docs=8).collect()
    found = Counter()
    for p in pieces:
        found[p.doc_id] += p.length
    assert found == {p.doc_id: p.doc_tokens for p in pieces} and len(found) == 60


def test_clusters_follow_neighbours_and_lose_no_row(spark):
    near = [(0, 1), (1, 0), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 6)]  # a pair with a tail, and a ring with one
    near += [(100 + i, 101 + i) for i in range(99)] + [(199, 198)]  # longer than what is followed
    found = {r.row: r.root for r in _clusters(spark.createDataFrame(near, "a long, b long")).collect()}
    assert set(found) == {a for a, _ in near}
    assert [found[i] for i in range(4)] == [0] * 4
    assert {found[i] for i in range(4, 8)} <= {4, 5, 6}
    assert len({found[100 + i] for i in range(68, 100)}) == 1 and all(found[100 + i] - 100 - i <= 32 for i in range(100))


def test_packing_an_empty_table(spark):
    assert pack_documents(empty(spark), tokenizer_path()).collect() == []


def test_bm25_scores_are_those_of_the_formula():
    docs = [[1, 2, 2, 3], [2, 3, 4], [5, 5, 1], [2]]
    ids, counts = np.concatenate([np.array(d) for d in docs]), np.array([len(d) for d in docs])
    idf = np.array([0, 0.7, 0.0, 1.1, 0.3, 0.9], np.float32)
    index = _Index(ids, np.repeat(np.arange(4), counts), counts, idf, 2.75, 1.2, 0.75)
    for seed, terms in enumerate(docs):
        for other, text in enumerate(docs):
            norm = 1.2 * (1 - 0.75 + 0.75 * len(text) / 2.75)
            wanted = sum(idf[t] * text.count(t) * 2.2 / (text.count(t) + norm) for t in set(terms))
            assert abs(index.scores(seed)[other] - wanted) < 1e-5


def test_long_lists_are_added_as_rows(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [np.concatenate([np.flatnonzero(rng.random(20) < 0.5), rng.integers(20, 2000, 3)]) for _ in range(200)]
    docs[150] = docs[50]
    ids, counts = np.concatenate(docs), np.array([len(d) for d in docs])
    doc = np.repeat(np.arange(200), counts)
    index = _Index(ids, doc, counts, np.ones(2000, np.float32), counts.mean(), 1.2, 0.75)
    gathered = []
    monkeypatch.setattr("logarc.llm.packing.ranges", lambda n: gathered.append(int(n.sum())) or ranges(n))
    for seed in range(200):
        wanted = np.zeros(200)
        for t in np.unique(docs[seed]):
            tf = np.array([(d == t).sum() for d in docs])
            wanted += tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * counts / counts.mean()))
        score = index.scores(seed)
        assert np.allclose(score, wanted) and score[50] == score[150]
    assert max(gathered) < 100  # the ids of half of all documents alone have about 1,000 places a seed


def test_last_window_is_cut_at_powers_of_two():
    pieces = []
    assert _lay_out([(0, 0, 5), (1, 3, 6)], 16, pieces, 7) == 10
    assert pieces == [(0, 0, 5, 7, 0), (1, 3, 3, 7, 5), (1, 6, 2, 8, 0), (1, 8, 1, 9, 0)]


def test_histogram_answers_every_limit(spark, whole):
    rows = awkward()
    sizes = [len(whole(r[1])) for r in rows]
    limits = context_limits(length_histogram(frame(spark, rows), tokenizer_path()))
    got = {r.n_tokens: r for r in limits.collect()}
    assert set(got) == set(sizes)
    for limit, r in got.items():
        assert r.n_docs == sizes.count(limit)
        assert r.docs_over == sum(n > limit for n in sizes)
        assert r.tokens_over == sum(n for n in sizes if n > limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in sizes)
        assert r.total_tokens == sum(sizes)
        assert abs(r.quantile - sum(n <= limit for n in sizes) / len(sizes)) < 1e-12
    for r in totals_at(limits, 0, 7, 10**9).collect():
        assert r.truncated_tokens == sum(min(n, r.context) for n in sizes)
        assert r.docs_over == sum(n > r.context for n in sizes)
    assert context_limits(length_histogram(empty(spark), tokenizer_path())).collect() == []
