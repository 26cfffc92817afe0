"""Exact length histogram: what any context limit costs and keeps, from suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .encoding import token_lengths

# Lengths summed together at the first level, so that no window sees more than this many rows at once.
CHUNK = 4096


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int | None = None) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each encoded length. Null text: empty, 0 tokens.

    Repeated rows count each, whole texts are encoded however long, other columns are
    ignored, and an empty table gives no rows.
    Written once, because the sums over it read it more than once.
    """
    lengths = token_lengths(docs, tokenizer, text, end_id)
    return stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit:

    ``n_docs`` of that length, ``docs_over`` longer ones, ``tokens_over`` in those,
    ``total_tokens`` of all documents, ``truncated_tokens`` kept if every document is
    cut at L, ``quantile``: share of documents of at most L tokens. The suffix sums
    also answer any limit between two lengths (``totals_at``). An empty histogram
    gives no rows.

    Sums run in two levels: lengths by chunks of ``CHUNK``, then the chunks, of which
    there are as many as the longest document has thousands of tokens.
    """
    part = F.floor(F.col("n_tokens") / CHUNK).alias("part")
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), part)
    sums = rows.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    above = sums.select(
        "part",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(above, "part").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("tokens_above") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_over"),
        "all_docs",
        "total_tokens",
    )
    return joined.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def totals_at(limits: DataFrame, *contexts: int) -> DataFrame:
    """``context, total_tokens, truncated_tokens, docs_over`` for any limits, also between lengths."""
    rows = [
        limits.agg(
            F.lit(k).cast("long").alias("context"),
            F.max("total_tokens").alias("total_tokens"),
            F.sum(F.least("n_tokens", F.lit(k)) * F.col("n_docs")).alias("truncated_tokens"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > k, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        )
        for k in contexts
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
