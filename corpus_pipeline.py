"""Corpus pipeline: language, boilerplate lines, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logarc.llm.bagminhash import keep_one_of_each
from logarc.llm.common import stored, table
from logarc.llm.decontaminate import decontaminate
from logarc.llm.encoding import tokenizer_path
from logarc.llm.language import fit_languages, keep_known_languages
from logarc.llm.line_spread import remove_boilerplate
from logarc.llm.packing import pack_documents


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own labels; those too far from every language go.

    Null texts and texts without a letter go too. Null ids, repeated rows and all columns are
    kept; an empty table stays empty.
    """
    return keep_known_languages(docs, fit_languages(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go, their documents stay, even if nothing else is left of them.

    Null and empty texts, null ids and repeated rows stay as they are; a null site counts as none.
    """
    return remove_boilerplate(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the smallest id, null ids last.

    Null and empty texts and those without words stay, each row; of equal rows one stays.
    """
    return keep_one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go, with all copies of their text.

    Null and empty texts match nothing and stay; items of fewer than five words match nothing.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens; every row is packed, null texts as one end token."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]
# Clustering, sketches and tokens have no counterpart in SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
