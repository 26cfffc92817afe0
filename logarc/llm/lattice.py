"""Subword lattice likelihood: each text's probability summed over all its segmentations into known pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, remainder, span_hashes, stored, text_bytes, text_key, words_of

# Bytes of text in one block; a block's words and their scores are held in one task.
BLOCK_BYTES = 6 * 1024 * 1024
EM_ROUNDS = 3
# Words given to one pass of the recursion.
WORD_BATCH = 60_000
# Added to each piece's expected count, so that nothing is impossible.
SMOOTHING = 0.1
# The vocabulary marks the start of a word with this character; inside, one byte that no word holds stands for it.
_MARK, _START = "▁", b"\x20"
_BLANKS = r"[ \t\n\x0B\f\r]+"


# Pieces are short, so their bytes can be the digits of a number modulo 2 ** 64.
_DIGIT_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 18
_SLOT_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * _SLOT_FACTOR >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def piece_keys(pieces: list[bytes]) -> np.ndarray:
    """One 64-bit key per piece: its bytes as the digits of a number."""
    keys = np.zeros(len(pieces), np.uint64)
    for i, piece in enumerate(pieces):
        total = 0
        for byte in reversed(piece):
            total = (total * int(_DIGIT_BASE) + byte + 1) % (1 << 64)
        keys[i] = total
    return keys


@dataclass
class PieceModel:
    """Pieces by their keys, in ascending order, with natural logarithms of their probabilities."""

    keys: np.ndarray
    log_p: np.ndarray
    longest: int
    log_end: float

    @cached_property
    def table(self) -> np.ndarray:
        """Piece number by slot; -1: none, -2: several, to be searched for."""
        slot = _slots(self.keys)
        out = np.full(1 << _SLOT_BITS, -1, np.int32)
        out[slot] = np.arange(len(slot))
        out[np.flatnonzero(np.bincount(slot, minlength=len(out)) > 1)] = -2
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pieces, and their numbers."""
        number = self.table[_slots(keys)]
        some = np.flatnonzero(number != -1)
        number = number[some].astype(np.int64)
        several = number == -2
        if several.any():
            number[several] = np.minimum(np.searchsorted(self.keys, keys[some[several]]), len(self.keys) - 1)
        true = self.keys[number] == keys[some]
        return some[true], number[true]


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_pieces(path: str) -> PieceModel:
    """Pieces of a public vocabulary and all single bytes.

    Such a file scores its pieces by rank alone, so the scores are taken as Zipf's law:
    a piece of score -r gets a probability in proportion to 1 / (r + 1).
    """
    from sentencepiece import SentencePieceProcessor

    source = SentencePieceProcessor(model_file=path)
    rank = {bytes([b]): float(source.get_piece_size()) for b in range(256)}
    for i in range(source.get_piece_size()):
        if source.is_control(i) or source.is_unknown(i) or source.is_byte(i) or source.is_unused(i):
            continue
        piece, score = source.id_to_piece(i), source.get_score(i)
        if piece.rfind(_MARK) <= 0:
            rank[piece.replace(_MARK, _START.decode()).encode()] = min(-score, float(source.get_piece_size()))
    names = list(rank)
    keys = piece_keys(names)
    order = np.argsort(keys)
    weight = 1 / (np.array([rank[x] for x in names])[order] + 1)
    return PieceModel(keys[order], np.log(weight / weight.sum()), max(map(len, names)), np.log(1e-3))


# --- the recursion, over many words of one length ----------------------------


def _edges(block: np.ndarray, model: PieceModel, backwards: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """From, to, the rows that have a piece there and its number, in the order of the ends; block: one word per row."""
    n, length = block.shape
    begins = np.arange(n) * length
    raw = block.reshape(-1)
    ends = range(length, 0, -1) if backwards else range(1, length + 1)
    for end in ends:
        total = np.zeros(n, np.uint64)
        for begin in range(end - 1, max(-1, end - 1 - model.longest), -1):
            total = total * _DIGIT_BASE + raw[begins + begin] + np.uint64(1)
            rows, number = model.find(total)
            if len(rows):
                yield begin, end, rows, number


def log_marginals(block: np.ndarray, model: PieceModel, weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """Log probability of each word over all segmentations.

    With ``weights``, also adds each piece's expected number of uses, times the
    word's weight, to ``counts`` (forward and backward recursion).
    """
    n, length = block.shape
    forward = np.full((length + 1, n), -np.inf)
    forward[0] = 0.0
    for begin, end, rows, number in _edges(block, model):
        forward[end, rows] = np.logaddexp(forward[end, rows], forward[begin, rows] + model.log_p[number])
    if weights is not None:
        backward = np.full((length + 1, n), -np.inf)
        backward[length] = 0.0
        for begin, end, rows, number in _edges(block, model, backwards=True):
            through = backward[end, rows] + model.log_p[number]
            share = np.exp(forward[begin, rows] + through - forward[length, rows]) * weights[rows]
            np.add.at(counts, number, share)
            backward[begin, rows] = np.logaddexp(backward[begin, rows], through)
    return forward[length]


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the words of each length, and their bytes after the start mark as a matrix."""
    raw, place = text_bytes(column)
    size = np.diff(place)
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(part):
            length = int(size[part[0]])
            block = np.full((len(part), length + 1), _START[0], np.uint8)
            block[:, 1:] = raw[place[part][:, None] + np.arange(length)]
            yield part, block


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger batches of words, so that few calls are made for each length."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= WORD_BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def learn_pieces(words: DataFrame, documents: int, start: PieceModel, rounds: int = EM_ROUNDS) -> PieceModel:
    """Re-estimate the piece probabilities from ``word, c`` (count in training) by expectation and maximisation.

    Each task sums expected uses over its words; a row per piece and task is shuffled
    and one per piece comes back (as many as the vocabulary has).
    """
    trained = words.filter("c > 0").select("word", "c")
    model = start
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            counts = np.zeros(len(own.keys))
            for batch in _gathered(batches):
                weights = batch.column("c").to_numpy(zero_copy_only=False).astype(float)
                for part, block in by_length(batch.column("word")):
                    log_marginals(block, own, weights[part], counts)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["piece", "uses"])

        summed = trained.mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(start.keys), SMOOTHING)
        for row in summed:
            uses[row.piece] += row.uses
        total = uses.sum() + documents + 1
        model = PieceModel(start.keys, np.log(uses / total), start.longest, float(np.log((documents + 1) / total)))
    return model


# --- scores of documents -----------------------------------------------------


def _word_column(text: str):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.split(F.translate(F.coalesce(F.col(text), F.lit("")), upper, lower), _BLANKS, -1)


def score_texts(
    docs: DataFrame,
    vocabulary: str,
    held_out_of: int = 7,
    held_out: int = 2,
    text: str = "text",
    doc_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Tokens are the words and one end per text. ``base_score`` sums the smoothed log10
    word frequencies; ``score`` is log10 of the probability of the text as words and
    an end, each word over all its segmentations. Both learn from the rows whose
    crc32(doc_id as text) modulo ``held_out_of`` is not ``held_out`` (a null id
    counts as empty text). Null text: empty, one end token. Repeated rows count each. A
    word is scored whole; one of n bytes takes n times the longest piece's length steps.
    An empty table gives no rows; other columns are ignored.

    Texts are dealt into blocks of bounded size; each block's distinct words are
    counted, joined with the corpus counts and sent back to the block, so no frequent
    word gathers rows and no task holds more than the words of its block.
    """
    held = (remainder(docs[doc_id], held_out_of) == held_out).alias("held_out")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text))).alias("bytes")).first()
    blocks = partitions_for(size["bytes"] or 0, block_bytes)
    h1, h2 = text_key(text)
    block = F.pmod(F.xxhash64(docs[doc_id], h1), F.lit(blocks)).cast("int").alias("block")
    rows = docs.select(block, docs[doc_id].alias("doc_id"), held, docs[text].alias("text"))
    counted = (
        rows.repartition("block")
        .select("block", (~F.col("held_out")).cast("long").alias("train"), F.explode_outer(_word_column("text")).alias("word"))
        .filter("word != ''")
        .groupBy("block", "word")
        .agg(F.sum("train").alias("c"))
    )
    pairs = stored(counted, "block-words")
    words = stored(pairs.groupBy("word").agg(F.sum("c").alias("c")), "words")
    facts = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    documents = rows.filter(~F.col("held_out")).count()
    n, v = (facts["n"] or 0) + documents, (facts["v"] or 0) + (documents > 0)
    model = learn_pieces(words, documents, load_pieces(vocabulary))
    scored = stored(_word_scores(words, model), "word-scores")
    sent = pairs.select("block", "word").join(scored, "word").select("block", "word", "c", "log_p")
    kind = rows.schema["doc_id"].dataType.simpleString()
    score = _block_scorer(n, v, documents, model.log_end)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(score, out)


def _word_scores(words: DataFrame, model: PieceModel) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            out = np.zeros(batch.num_rows)
            for part, block in by_length(batch.column("word")):
                out[part] = log_marginals(block, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(out)], ["word", "c", "log_p"])

    return words.mapInArrow(score, "word string, c long, log_p double")


def _block_scorer(n: int, v: int, documents: int, log_end: float):
    def base(c):
        return np.log10((c + 1) / (n + v + 1))

    def score(docs: pa.Table, words: pa.Table) -> pa.Table:
        known = words.column("word").combine_chunks() if words.num_rows else pa.array([], pa.string())
        raw, place = text_bytes(known)
        keys = span_hashes(raw, place[:-1], place[1:])
        order = np.argsort(keys)
        keys = keys[order]
        count = words.column("c").to_numpy()[order] if words.num_rows else np.zeros(0, np.int64)
        log_p = words.column("log_p").to_numpy()[order] if words.num_rows else np.zeros(0)
        parts = []
        for batch in docs.combine_chunks().to_batches():
            text = words_of(batch.column("text"), lower=True)
            at = np.searchsorted(keys, text.hashes)
            if len(at) and (at.max() >= len(keys) or (keys[at] != text.hashes).any()):
                raise ValueError("a block holds a word that was not counted for it")
            rows, row = batch.num_rows, text.row
            c = count[at]
            parts.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(np.diff(text.first) + 1),
                        pa.array(np.bincount(row, c > 0, minlength=rows).astype(np.int64) + (documents > 0)),
                        pa.array(np.full(rows, n, np.int64)),
                        pa.array(np.bincount(row, base(c), minlength=rows) + base(documents)),
                        pa.array((np.bincount(row, log_p[at], minlength=rows) + log_end) / np.log(10)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.Table.from_batches(parts) if parts else docs.select([]).slice(0, 0)

    return score
