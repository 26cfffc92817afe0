"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    bagminhash,
    decontaminate,
    encoding,
    host_rules,
    language,
    lattice,
    license_scan,
    line_spread,
    merkle,
    packing,
    sharding,
    token_counts,
    warc,
    whitening,
)
from .common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds; documents not named are clean."""
    pairs = decontaminate.contaminated_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"), F.max("n_overlap").alias("n_overlap"), F.min("first_word").alias("first_word"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), encoding.tokenizer_path())


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every encoded length that occurs, taken as a context limit."""
    return token_counts.context_limits(token_counts.length_histogram(table(spark, folder, "documents"), encoding.tokenizer_path()))


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, folder, "documents"))


def op5_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.score_texts(table(spark, folder, "documents"), lattice.vocabulary_path())


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit_languages(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    predicted = language.predict_languages(docs, model)
    return predicted.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = host_rules.quality_verdicts(table(spark, folder, "documents"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed", "host_rate"]
    return verdicts.select(*names)


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents"))


def op9_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's lines, those removed, and a digest of the text that is left."""
    cleaned = line_spread.remove_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_left"), F.md5("text").alias("text_md5"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the records read back, with the size and SHA-256 of each record rebuilt from header and payload."""
    path = scratch_path(spark, "llm-warc")
    warc.write_archive(table(spark, folder, "pages"), path)
    records = warc.read_archive(spark, path)
    whole = records.withColumn("record", warc.record_bytes())
    return warc.record_fields(whole, "record")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return merkle.manifest(docs, tampered=merkle.lowered_ids(F.col("doc_id")))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shards by bytes; ``grown_shard`` belongs to another law."""
    shards = sharding.shard_documents(table(spark, folder, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_packing,
        op3_token_counts,
        op4_near_duplicates,
        op5_lattice_scores,
        op6_language_id,
        op7_host_rules,
        op8_license_scan,
        op9_line_spread,
        op10_warc,
        op11_merkle_manifest,
        op12_whitening,
        op13_sharding,
    )
}
