"""Quality rules per host: failure rates shrunk towards an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hinted, span_hashes, stored, text_bytes, window_hashes, windows, words_of

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

# Rules on one document, by name; a host is judged on the share of its documents that fail each.
RULES = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "3 * n_dup_lines > n_lines",
    "length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def document_features(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts of each whole text, one row out for each row in. Null text: no words, no lines."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            columns = [pa.array(x.astype(np.int64)) for x in _features(batch.column("text"))]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], ["doc_id", "host", *names])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[host].alias("host"), docs[text].alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(measure, f"doc_id {kinds['doc_id']}, host {kinds['host']}, {FEATURES}, n_lines long")


def _features(column: pa.Array) -> list[np.ndarray]:
    words = words_of(column)
    raw, rows = words.raw, len(words.first) - 1
    n_words = np.diff(words.first)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    row = words.row
    chars = np.bincount(row, begins[words.end] - begins[words.start], minlength=rows)
    place = text_bytes(column)[1]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    n_symbols = symbols[place[1:]] - symbols[place[:-1]]
    n_lines, n_dup = _duplicate_lines(raw, place, words.start)
    return [n_words, chars, n_symbols, n_dup, _repeated(words, row, rows), n_lines]


def _duplicate_lines(raw: np.ndarray, place: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word, and those equal to an earlier one."""
    rows = len(place) - 1
    ends = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([place[:-1], ends + 1]))
    start = start[start < len(raw)]
    newline = np.append(ends, len(raw))[np.searchsorted(ends, start)]
    end = np.minimum(newline, place[np.searchsorted(place, start, side="right")])
    has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end = start[has_word], end[has_word]
    row = np.searchsorted(place, start, side="right") - 1
    first = _first_of_pairs(row, span_hashes(raw, start, end))
    return np.bincount(row, minlength=rows), np.bincount(row[~first], minlength=rows)


def _first_of_pairs(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where a pair of row and key stands for the first time."""
    order = np.lexsort((np.arange(len(row)), key, row))
    r, k = row[order], key[order]
    first = np.ones(len(row), bool)
    first[order[1:]] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return first


def _repeated(words, row: np.ndarray, rows: int) -> np.ndarray:
    """Words of each text that stand in a window of five found at least twice in it."""
    at = windows(words.first, WINDOW)
    if not len(at):
        return np.zeros(rows, np.int64)
    key = window_hashes(words.hashes, at, tuple(range(WINDOW)))
    # The row goes into the key so that one sort finds the windows of one text that are equal.
    key ^= (row[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return np.bincount(row, np.cumsum(edge[:-1]) > 0, minlength=rows)


def host_rates(features: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``host, n_docs`` and per rule ``rate_<rule>``: the share of failures after shrinking.

    The prior of each rule is the beta distribution with the mean and variance of the
    hosts' rates (method of moments, hosts weighted by their documents), so a host of
    few documents is judged by what is usual and one of many by its own. Sums per host
    combine before the shuffle. Null hosts are one host.
    """
    fails = [F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")).alias(f"fail_{name}") for name, rule in rules.items()]
    hosts = stored(features.groupBy("host").agg(F.count("*").alias("n_docs"), *fails), "hosts")
    sums = []
    for name in rules:
        rate = F.col(f"fail_{name}") / F.col("n_docs")
        sums += [F.sum(f"fail_{name}").alias(f"f_{name}"), F.sum(F.col("n_docs") * rate * rate).alias(f"q_{name}")]
    total = hosts.agg(F.sum("n_docs").alias("docs"), F.count("*").alias("hosts"), *sums).first()
    out = [F.col("host"), F.col("n_docs")]
    for name in rules:
        alpha, beta = _prior(total["docs"] or 0, total["hosts"], total[f"f_{name}"] or 0, total[f"q_{name}"] or 0.0)
        out.append(((F.col(f"fail_{name}") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))).alias(f"rate_{name}"))
    return hosts.select(*out)


def _prior(docs: int, hosts: int, fails: int, squares: float) -> tuple[float, float]:
    """Beta parameters with the mean and the spread between hosts; its strength lies between 1 and 1000 documents.

    Hosts that differ no more than counting spreads them have no finite strength: the upper
    bound stands for it. Below 1 the prior would have its mass at the ends instead of its mean.
    """
    mean = min(max((fails + 0.5) / (docs + 1), 1e-6), 1 - 1e-6)
    spread = squares / docs - (fails / docs) ** 2 if docs else 0.0
    within = mean * (1 - mean) * hosts / docs if docs else 0.0  # what counting alone spreads
    between = max(spread - within, 1e-12)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def quality_verdicts(
    docs: DataFrame,
    max_rate: float = 0.6,
    host: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    rules: dict[str, str] = RULES,
) -> DataFrame:
    """The counts of each row with ``base_failed``, ``host_failed``, ``host_rate`` and ``kept``.

    A host fails if, for some rule, its shrunk rate is above ``max_rate``; all its
    documents go then. ``host_rate`` is the largest of its rates. Empty and null texts
    have no words and fail the base rule. Repeated rows count each; an empty table gives no rows.
    Null ids are kept, whole texts are read however long, and other columns are ignored.
    """
    features = stored(document_features(docs, host, text, doc_id), "features")
    rates = stored(host_rates(features, rules), "host-rates")
    worst = F.greatest(*[F.col(f"rate_{name}") for name in rules]) if len(rules) > 1 else F.col(f"rate_{next(iter(rules))}")
    verdicts = rates.select(F.col("host").alias("verdict_host"), worst.alias("host_rate"))
    joined = features.join(hinted(verdicts, 128), F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    failed = F.expr(RULES["base"])
    bad_host = F.col("host_rate") > max_rate
    return joined.select(
        "doc_id",
        "host",
        *[part.split()[0] for part in FEATURES.split(", ")],
        "n_lines",
        failed.alias("base_failed"),
        bad_host.alias("host_failed"),
        "host_rate",
        (~failed & ~bad_host).alias("kept"),
    )
