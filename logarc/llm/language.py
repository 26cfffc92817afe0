"""Language of a text: nearest of several centroids per language over TF-IDF byte n-grams, by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, text_bytes

# Hashed features; n-grams of two and three bytes of letters.
DIMENSIONS = 4096
# Texts that are turned into rows of that many features at once.
FEATURE_ROWS = 512
# Labelled rows per language that the centroids are clustered from; document frequencies come from all of them.
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
# A text farther from its nearest centroid than all but this share of the sample is rejected, with this factor to spare.
REJECT_QUANTILE = 0.002
REJECT_FACTOR = 0.5
# Of fewer n-grams than this even a true language's cosine is small, so distance tells nothing.
REJECT_GRAMS = 60
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)  # all but letters is a blank
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """Inverse document frequencies, and unit centroids with their language and the least cosine they accept."""

    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    least: np.ndarray
    languages: list[str]


def _counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, one row per text."""
    raw, place = text_bytes(column)
    rows = len(place) - 1
    out = np.zeros((rows, DIMENSIONS), np.float32)
    if len(raw) < 2:
        return out
    folded = _FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(place))
    pairs = folded[:-1] << 8 | folded[1:]
    same = row[:-1] == row[1:]
    keep = same & (pairs != 0x2020)
    bins = [row[:-1][keep] * DIMENSIONS + (pairs[keep] * np.uint32(0x9E3779B1) >> np.uint32(20))]
    if len(raw) > 2:
        triples = pairs[:-1] << 8 | folded[2:]
        keep = same[:-1] & same[1:] & ((triples & 0xFFFF) != 0x2020) & ((triples >> 8) != 0x2020)
        bins.append(row[:-2][keep] * DIMENSIONS + (triples[keep] * np.uint32(0x85EBCA6B) >> np.uint32(20)))
    for part in bins:
        out += np.bincount(part, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a text without n-grams stays zero."""
    weighted = np.log1p(counts) * idf
    norm = np.sqrt((weighted * weighted).sum(axis=1, keepdims=True))
    return weighted / np.maximum(norm, 1e-12)


def _has_letter(column: pa.Array) -> np.ndarray:
    raw, place = text_bytes(column)
    total = np.concatenate([[0], np.cumsum((raw | 32) - np.uint8(97) < 26)])
    found = total[place[1:]] > total[place[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in raw[place[i] : place[i + 1]].tobytes().decode())
    return found


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Over all labelled rows: documents per feature, and per language. At most a row per feature and language comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, languages = np.zeros(DIMENSIONS, np.int64), {}
        for batch in chunks(batches, "text", rows=FEATURE_ROWS):
            seen += (_counts(batch.column("text")) > 0).sum(axis=0)
            for entry in batch.column("lang").value_counts().to_pylist():
                languages[entry["values"]] = languages.get(entry["values"], 0) + entry["counts"]
        names = [*map(str, range(DIMENSIONS)), *(f"lang {x}" for x in languages)]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([*seen.tolist(), *languages.values()], pa.int64())], ["name", "n"])

    found = rows.mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()
    seen, languages = np.zeros(DIMENSIONS, np.int64), {}
    for row in found:
        if row["name"].startswith("lang "):
            languages[row["name"][5:]] = row["n"]
        else:
            seen[int(row["name"])] = row["n"]
    return seen, languages


def fit_languages(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    centroids: int = CENTROIDS,
    seed: int = 7,
) -> LanguageModel:
    """Learn from rows with a language; rows without one are left out.

    Document frequencies cover all rows. The centroids come from at most
    ``per_language`` distinct texts of each language that have n-grams, those of smallest
    hash, clustered by cosine on the driver (the bound is that parameter times the number of languages).
    No rows with a language give a model that answers ``und`` to everything. A text that repeats
    is sampled once per language; of equal hashes the smaller text comes first. Whole
    texts are counted, however long. Other columns are ignored.
    """
    rows = labelled.select(labelled[text].alias("text"), labelled[lang].alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    seen, languages = _document_frequencies(rows)
    total = sum(languages.values())
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    names = sorted(languages)
    usable = rows.filter(_usable())
    distinct = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    found, owner, least = [], [], []
    sampled = _samples(usable, distinct, per_language)
    for number, name in enumerate(names):
        texts = sampled.get(name, [])
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        parts = [_vectors(_counts(part.column("text")), idf) for part in chunks([batch], "text", rows=FEATURE_ROWS)]
        vectors = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), np.float32)
        vectors = vectors[vectors.sum(axis=1) > 0]
        if not len(vectors):
            continue
        means = _cluster(vectors, min(centroids, len(vectors)), np.random.default_rng(seed + number))
        reach = np.quantile((vectors @ means.T).max(axis=1), REJECT_QUANTILE) * REJECT_FACTOR
        found.append(means)
        owner += [number] * len(means)
        least += [reach] * len(means)
    stacked = np.concatenate(found) if found else np.zeros((0, DIMENSIONS), np.float32)
    return LanguageModel(idf, stacked, np.array(owner, np.int64), np.array(least), names)


def _usable(text: str = "text") -> Column:
    """Whether a text has any n-gram: two bytes, one of them of a letter."""
    return (F.octet_length(text) >= 2) & F.col(text).rlike(r"[A-Za-z]|[^\x00-\x7F]")


def _samples(rows: DataFrame, distinct: dict[str, int], limit: int) -> dict[str, list[str]]:
    """Of each language at most ``limit`` distinct texts, those of smallest hash, in one pass over all languages.

    ``distinct`` is about how many each has: a cut on the hash lets about twice the limit
    through, so the texts that are ranked are few however many a language has. A language
    of which the cut leaves too few is read again, without it.
    """
    key = F.xxhash64("text", F.lit(31))
    share = {name: 2 * limit / n if n > 2 * limit else 1.0 for name, n in distinct.items()}
    cuts = [(name, (1 << 63) - 1 if part == 1.0 else int(-(2**63) + part * 2**64 * 0.999)) for name, part in share.items()]
    if not cuts:
        return {}
    limits = F.broadcast(rows.sparkSession.createDataFrame(cuts, "lang string, cut long"))  # a row per language
    few = rows.join(limits, "lang").filter(key <= F.col("cut")).select("lang", "text").distinct().withColumn("key", key)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text")).alias("place")
    out: dict[str, list[str]] = {}
    for row in few.select("lang", "text", place).filter(F.col("place") <= limit).orderBy("lang", "place").collect():
        out.setdefault(row["lang"], []).append(row["text"])
    for name, part in share.items():
        if part < 1.0 and len(out.get(name, [])) < limit:
            own = rows.filter(F.col("lang") == name).select("text").distinct().orderBy(key, "text").limit(limit)
            out[name] = [row["text"] for row in own.collect()]
    return out


def _cluster(vectors: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; an emptied cluster keeps its centre."""
    means = vectors[random.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = (vectors @ means.T).argmax(axis=1)
        for c in range(k):
            if (nearest == c).any():
                mean = vectors[nearest == c].mean(axis=0)
                means[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return means.astype(np.float32)


def classify(column: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine with the nearest centroid, and whether it is too far from all of them, for each text."""
    known = _has_letter(column)
    if not len(model.centroids):
        return [UNKNOWN] * len(known), np.zeros(len(known)), np.ones(len(known), bool)
    counts = _counts(column)
    cosine = _vectors(counts, model.idf) @ model.centroids.T
    best = cosine.argmax(axis=1)
    score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
    rejected = ~known | ((score < model.least[best]) & (counts.sum(axis=1) >= REJECT_GRAMS))
    names = [model.languages[model.language[b]] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    return names, score, rejected


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score, rejected``, one row out for each row in.

    ``und`` with score 0 if the text is null or has no letter. ``rejected``: that, or
    too far from every centroid to be any of the languages; ``lang_pred`` is the nearest
    still. A text of fewer than ``REJECT_GRAMS`` n-grams is too short to be far. Of centroids
    equally near the first one wins, in the order of the languages' names. Repeated rows are
    answered each, null ids kept, whole texts read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", rows=FEATURE_ROWS):
            names, score, rejected = classify(batch.column("text"), shared.value)
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score.astype(np.float64)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns; rows pass in place, without a shuffle.

    Null texts and texts without a letter are rejected and go; null ids and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, rows=FEATURE_ROWS):
            yield batch.filter(pa.array(~classify(batch.column(text), shared.value)[2]))

    return docs.mapInArrow(keep, docs.schema)
