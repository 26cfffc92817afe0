"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Columns that have the names the operators use inside or return.
CLASHES = "h1 long, h2 long, text_b string, node long, score double, n_tokens long, words string, pos int, host string, lines int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
_CLASH_VALUES = (1, 2, "x", 3, 0.5, 4, "y", 5, "z", 6)


def words(seed: int, n: int) -> list[str]:
    made = random.Random(seed)
    return ["".join(made.choice("abdeilnorstu") for _ in range(made.randint(2, 6))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def doc(doc_id: int | None, text: str | None, lang: str | None = "en", source: str | None = "s0") -> tuple:
    return (doc_id, text, lang, source, None if text is None else len(text), *_CLASH_VALUES)


def frame(spark: SparkSession, rows: list[tuple], parts: int = 3) -> DataFrame:
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def awkward() -> list[tuple]:
    base = prose(1, 60)
    return [
        doc(1, base),
        doc(2, base),
        doc(2, base),
        doc(3, base.replace(" ", "\n", 5)),
        doc(4, None),
        doc(5, ""),
        doc(5, ""),
        doc(6, " \n\t "),
        doc(None, prose(2, 40), None, None),
        doc(None, None, None, None),
        doc(7, "Zwölf Größen ñ é x", "de", "s1"),
        doc(8, prose(3, 30_000), "en", "s1"),
        doc(9, "x" * 5000, "en", "s2"),
        doc(10, "12 34 !! \u0000 ퟿", "en", "s2"),
        doc(11, "one two", "en", "s2"),
    ]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
