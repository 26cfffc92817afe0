"""Byte-span hashes, and the exact results that rest on them, with texts that share every polynomial hash modulo 2 ** 64."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logarc.llm import encoding
from logarc.llm.bagminhash import weighted_jaccard
from logarc.llm.common import span_hashes, text_bytes, words_of
from logarc.llm.decontaminate import contaminated_pairs
from logarc.llm.encoding import WordEncoder, tokenizer_path
from logarc.llm.host_rules import quality_verdicts

from .fixtures import doc, frame, prose


def thue_morse(bits=11):
    """Two words of 2,048 letters whose difference is divisible by 2 ** 64 at every odd base."""
    signs = [bin(i).count("1") & 1 for i in range(1 << bits)]
    return "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)


def hashes(texts):
    raw, place = text_bytes(pa.array(texts))
    return span_hashes(raw, place[:-1], place[1:])


def test_structured_words_differ():
    one, two = thue_morse()
    assert len(set(hashes([one, two, one[:1024], two[:1024], one[:128], two[:128]]))) == 6


def test_hash_depends_on_the_span_alone():
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcé ") for _ in range(draw.randint(0, 300))) for _ in range(300)]
    texts += [t[:-1] for t in texts] + [t + "\0" for t in texts]
    alone = [int(hashes([t])[0]) for t in texts]
    assert hashes(texts).tolist() == alone
    assert len(set(alone)) == len(set(texts))


def test_the_last_bytes_count():
    for n in range(1, 40):
        made = {"a" * i + "b" + "a" * (n - i - 1) for i in range(n)} | {"a" * n, "a" * n + "\0"}
        assert len(set(hashes(sorted(made)))) == len(made)


def test_results_tell_structured_words_apart(spark):
    one, two = thue_morse()
    texts = [" ".join([w, *prose(3, 5).split(), w]) for w in (one, two)]
    assert weighted_jaccard(pa.array(texts[:1]), pa.array(texts[1:]))[0] < 0.5
    lines = quality_verdicts(frame(spark, [doc(1, f"{one}\n{two}"), doc(2, f"{one}\n{one}")])).collect()
    assert {r.doc_id: r.n_dup_lines for r in lines} == {1: 0, 2: 1}
    item = " ".join([one] * 6)
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    pairs = contaminated_pairs(frame(spark, [doc(1, item), doc(2, item.replace(one, two))]), benchmark)
    assert {r.doc_id for r in pairs.collect()} == {1}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids, count = WordEncoder(tokenizer_path()).encode(pa.array([one, two, one]))
    assert np.split(ids, np.cumsum(count))[1].tolist() == tokenizer.encode(two, add_special_tokens=False).ids


@pytest.mark.parametrize("room", [16, 1 << 20])
def test_ids_of_many_words_and_a_cache_that_starts_anew(monkeypatch, room):
    monkeypatch.setattr(encoding, "CACHE_WORDS", room)
    tokenizer, coder = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    texts = [prose(i, 40) for i in range(30)]
    texts += ["a ~ b~c ~~ ~", "~", "x~", "", None, "it's 12 34th é́ ﬁ ½ 好 \u0000 a", "<|endoftext|> ~ <|x", "don't~can't"]
    for _ in range(2):
        for part in (texts[:7], texts[7:30], texts[20:]):
            ids, count = coder.encode(pa.array(part, pa.string()))
            wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
            assert count.tolist() == list(map(len, wanted))
            assert ids.tolist() == [i for w in wanted for i in w]


def test_words_have_the_hash_of_their_bytes():
    words = words_of(pa.array(["one two", "two one"]))
    assert words.hashes[0] == words.hashes[3] and words.hashes[1] == words.hashes[2]
