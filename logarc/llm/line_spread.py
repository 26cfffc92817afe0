"""Cross-site boilerplate: lines that many distinct sites share, found with mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.explode import explode_each
from .common import hinted, stored, text_key

# Relative error of the sketches: 32 registers, 32 bytes a line. Lines within NEAR errors of the limit are counted exactly.
SKETCH_ERROR = 0.2
NEAR = 4


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("l1"), F.xxhash64(F.lit(104729), line).alias("l2")]


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """One row per line that holds a character besides blanks."""
    split = docs.select(*text_key(text), docs[site].alias("site"), F.split(F.col(text), "\n", -1).alias("lines"))
    rows = explode_each(split, F.col("lines"), "h1", "h2", "site", item="line")
    return rows.select("h1", "h2", "site", "pos", F.trim("line").alias("line")).filter("line != ''").select(
        "h1", "h2", "site", "pos", *_line_key(F.col("line"))
    )


def spread_lines(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source") -> DataFrame:
    """``l1, l2``: keys of the lines found on at least ``min_sites`` distinct sites, in as many distinct texts.

    A text that stands on many sites is one text, so its lines don't spread by its copies alone.
    Every line gets a HyperLogLog sketch of its sites and one of its texts, merged by
    aggregation, also before the shuffle. Sketches far above the limit decide; near it
    the distinct sites or texts are counted exactly, of those lines alone. Lines are
    compared without blanks at their ends. Null sites count as none.
    """
    lines = _lines(docs, text, site).filter("site IS NOT NULL")
    counts = {"site": F.approx_count_distinct("site", SKETCH_ERROR), "h1": F.approx_count_distinct("h1", SKETCH_ERROR)}
    sketches = lines.groupBy("l1", "l2").agg(*[n.alias(f"n_{c}") for c, n in counts.items()])
    low, high = min_sites * (1 - SKETCH_ERROR * NEAR), min_sites * (1 + SKETCH_ERROR * NEAR)
    found = stored(sketches.filter((F.col("n_site") >= low) & (F.col("n_h1") >= low)), "spread")
    for column in counts:
        near = found.filter(F.col(f"n_{column}") <= high).select("l1", "l2")
        pairs = lines.join(hinted(near, 16), ["l1", "l2"], "left_semi").groupBy("l1", "l2", column).agg(F.lit(1).alias("one"))
        few = pairs.groupBy("l1", "l2").agg(F.count("*").alias("n")).filter(F.col("n") < min_sites)
        found = found.join(few, ["l1", "l2"], "left_anti")
    return found.select("l1", "l2")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source") -> DataFrame:
    """The rows with their spread lines taken out of every text; one row out for each row in.

    A text of nothing else becomes empty; whole copies keep theirs, as a text counts
    once (``spread_lines``). Adds ``n_lines`` (lines of the text) and ``n_removed``; an existing ``n_chars`` is set anew where lines were taken out. A column that already
    has one of the added names is replaced. Null and empty texts stay as they are
    (0 lines and 1 line); repeated rows stay.
    """
    found = stored(spread_lines(docs, min_sites, text, site), "boilerplate")
    hits = _lines(docs, text, site).select("h1", "h2", "pos", "l1", "l2").join(hinted(found, 16), ["l1", "l2"])
    places = hits.groupBy("h1", "h2").agg(F.collect_set("pos").alias("places"))
    places = stored(places, "boilerplate-places").withColumnsRenamed({"h1": "_spread_h1", "h2": "_spread_h2", "places": "_spread_places"})
    h1, h2 = text_key(text)
    keyed = docs.withColumns({"_spread_k1": h1, "_spread_k2": h2})
    same = (F.col("_spread_k1") == F.col("_spread_h1")) & (F.col("_spread_k2") == F.col("_spread_h2"))
    joined = keyed.join(places, same, "left")
    kept = F.array_join(
        F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(F.col("_spread_places"), i)), "\n"
    )
    joined = joined.withColumn("_spread_kept", F.when(F.col("_spread_places").isNotNull(), kept))
    cut = F.col("_spread_places").isNotNull()
    total = F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0))
    added = {
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(total).cast("long"),
        "n_removed": F.when(cut, F.size("_spread_places")).otherwise(0).cast("long"),
        text: F.when(cut, F.col("_spread_kept")).otherwise(F.col(text)),
    }
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        added["n_chars"] = F.when(cut, F.length("_spread_kept").cast(kind)).otherwise(docs["n_chars"])
    return joined.withColumns(added).select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
