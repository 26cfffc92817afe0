"""Token ids of whole texts from a public tokenizer file, each distinct word encoded once per task."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANK, LOWER, chunks, ranges, span_hashes, text_bytes

# Words kept encoded between batches; beyond it the cache starts anew.
CACHE_WORDS = 1 << 20
# New words are encoded this many at a time as one text, with this sign between them: a token of its own.
JOINED_WORDS = 256
SIGN = "~"

# Byte classes for cutting: 0 blank, 1 other, 2 Latin letter, 3 plain punctuation. This
# vocabulary's pattern always begins a new token between letters and punctuation, but for
# the apostrophe; <, | and > are part of special tokens.
_CLASS = np.ones(256, np.uint8)
_CLASS[BLANK] = 0
_CLASS[65:91] = _CLASS[97:123] = 2
_CLASS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}")] = 3
_SECOND = np.zeros(256, bool)  # second bytes of U+00C0-U+00FF, but for the two signs among them
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_LOWER_SECOND = np.arange(256, dtype=np.uint8)
_LOWER_SECOND[0x80:0x9F] += 0x20
_LOWER_SECOND[0x97] = 0x97

# Words that normalizing and splitting leave as they are, and the characters that stand for their bytes in a vocabulary of bytes.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SIGNS = np.arange(256, dtype="<u4")
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_SIGNS[_HIDDEN] = 256 + np.arange(len(_HIDDEN))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known:
    """Encoded words by hash: an open table of slots, and the ids of all words one after the other."""

    def __init__(self, room: int, dtype: np.dtype):
        self.room, self.n, self.used = room, 0, 0
        self.slots = np.full(1 << (2 * room - 1).bit_length(), -1, np.int32)
        self.keys = np.zeros(room, np.uint64)
        self.begin, self.size = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.ids = np.zeros(4 * room, dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for unknown ones."""
        mask = np.uint64(len(self.slots) - 1)
        found, left, step = np.full(len(keys), -1, np.int64), np.arange(len(keys)), np.uint64(0)
        while len(left):
            entry = self.slots[(keys[left] + step) & mask]
            same = (entry >= 0) & (self.keys[entry] == keys[left])
            found[left[same]] = entry[same]
            left, step = left[(entry >= 0) & ~same], step + np.uint64(1)
        return found

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Words that are all new and different, with the ids of each in their order."""
        entries = np.arange(self.n, self.n + len(keys))
        self.keys[entries], self.size[entries] = keys, size
        self.begin[entries] = self.used + np.cumsum(size) - size
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), self.ids.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(keys), self.used + len(ids)
        mask, left, step = np.uint64(len(self.slots) - 1), np.arange(len(keys)), np.uint64(0)
        while len(left):
            at = (keys[left] + step) & mask
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[left[free]]
            left, step = left[self.slots[at] != entries[left]], step + np.uint64(1)


class WordEncoder:
    """Encodes columns of text with a tokenizer that drops white space.

    Ids are those of encoding each whole text without special tokens added: such
    a tokenizer never joins characters across white space, nor letters with
    punctuation, so words can be cut there, encoded once and looked up.
    """

    def __init__(self, path: str):
        # Spark gives each task one core; more threads of the library would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known = _Known(CACHE_WORDS, self.dtype)
        sign = self._ids(SIGN)
        letters = [chr(x) for x in range(256) if _PLAIN.fullmatch(chr(x))]
        probe = [*letters, "".join(letters), "".join(letters[::-1])]
        self.plain = all(self._encode_plain([w])[1].tolist() == self._ids(w) for w in probe)
        self.sign = sign[0] if len(sign) == 1 and self._ids(f"a {SIGN} a") == [*self._ids("a"), *sign, *self._ids("a")] else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the number of ids of each row."""
        raw, place = text_bytes(column)
        if b"<|" not in raw.tobytes():  # else upper case tells a special token from plain text
            raw = _lowered(raw)
        start, end = _cut(raw, place)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(place) - 1, np.int64)
        codes, distinct = pd.factorize(span_hashes(raw, start, end))
        some = np.empty(len(distinct), np.int64)
        some[codes] = np.arange(len(codes))
        entry = self._look_up(distinct, raw, start[some], end[some])
        count = self.known.size[entry][codes]
        at = np.repeat(self.known.begin[entry][codes], count) + ranges(count)
        total = np.concatenate([[0], np.cumsum(count)])
        first = np.searchsorted(start, place)
        return self.known.ids[at], np.diff(total[first])

    def _look_up(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        entry = self.known.find(keys)
        new = np.flatnonzero(entry < 0)
        if self.known.n + len(new) > self.known.room:
            self.known = _Known(max(CACHE_WORDS, len(keys)), self.dtype)
            new = np.arange(len(keys))
        if len(new):
            data = raw.tobytes()
            words = [data[s:e].decode() for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, words)), bool, len(words)) & self.plain
            for some, encode in ((plain, self._encode_plain), (~plain, self._encode_words)):
                if some.any():
                    self.known.add(keys[new[some]], *encode([words[i] for i in np.flatnonzero(some).tolist()]))
            entry = self.known.find(keys)
        return entry

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of ``_PLAIN``, which go to the tokenizer's model without normalizing and splitting."""
        model = self.tokenizer.model
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        size, ids = [], []
        for word in _SIGNS[data].tobytes().decode("utf-32-le").split(chr(_SIGNS[0x0A])):
            pieces = model.tokenize(word)
            size.append(len(pieces))
            ids += [piece.id for piece in pieces]
        return np.array(size, np.int64), np.array(ids, self.dtype)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all.

        Many words go in as one text: the sign between them is a token that no word without
        that character has, so it tells where the next one begins.
        """
        if self.sign is None:
            parts = [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
        own = [w.replace(SIGN, "") if SIGN in w else w for w in words]
        texts = [f" {SIGN} ".join([*own[i : i + JOINED_WORDS], ""]) for i in range(0, len(own), JOINED_WORDS)]
        ids = np.concatenate([np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        signs = np.flatnonzero(ids == self.sign)
        size = np.diff(signs, prepend=-1) - 1
        ids = np.delete(ids, signs)
        other = [i for i, w in enumerate(words) if SIGN in w]
        if other:
            parts = np.split(ids, np.cumsum(size)[:-1])
            for i, coded in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
                parts[i] = np.array(coded.ids, self.dtype)
                size[i] = len(parts[i])
            ids = np.concatenate(parts)
        return size, ids


def _lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0-U+00DE lower-cased, but for a letter before a combining mark: what the two compose to can depend on its case."""
    low = LOWER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    low[second] = _LOWER_SECOND[raw[second]]
    marks = np.flatnonzero((raw[1:] == 0xCC) | (raw[1:] == 0xCD))
    low[marks] = raw[marks]
    return low


def _cut(raw: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of words, cut also between Latin letters and punctuation."""
    kind = _CLASS[raw]
    lead = np.flatnonzero((raw[:-1] == 0xC3) & _SECOND[raw[1:]]) if len(raw) else np.zeros(0, np.int64)
    kind[lead] = kind[lead + 1] = 2
    before = np.zeros(len(raw), np.uint8)
    before[1:] = kind[:-1]
    edge = np.zeros(len(raw), bool)
    edge[place[place < len(raw)]] = True
    opens = (kind > 0) & (edge | (before == 0) | (before + kind == 5))
    end = np.flatnonzero((before > 0) & (opens | (kind == 0)))
    if len(raw) and kind[-1]:
        end = np.append(end, len(raw))
    return np.flatnonzero(opens), end


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)


def encoded(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 1) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian) of each row, ``end_id`` after each text.

    A null text is empty. Rows keep their places, so no shuffle is needed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        tail = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        width = coder.dtype.itemsize
        for batch in chunks(batches, "text"):
            ids, count = coder.encode(batch.column("text"))
            data, stop = ids.tobytes(), (np.cumsum(count) * width).tolist()
            parts = [data[a:b] + tail for a, b in zip([0, *stop[:-1]], stop, strict=True)]
            total = pa.array(count + len(tail) // width, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), total, pa.array(parts, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def token_lengths(docs: DataFrame, path: str, text: str = "text", end_id: int | None = None) -> DataFrame:
    """Only the number of tokens of each row: ``n_tokens``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in chunks(batches, "text"):
            count = coder.encode(batch.column("text"))[1] + (end_id is not None)
            yield pa.RecordBatch.from_arrays([pa.array(count, pa.int64())], ["n_tokens"])

    return docs.select(docs[text].alias("text")).mapInArrow(measure, "n_tokens long")
