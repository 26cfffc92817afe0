"""Merkle manifest of a table: a hash tree per language, one over their roots, and a proof of every row.

A level is one aggregation: conditional aggregates spread the children of each parent into
``fanout`` columns. Concatenating the columns gives the parent's hash, and leaving out a
child's own column gives its siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.explode import explode_each
from .common import hinted, remainder, stored
from .numbering import places_in_groups

FANOUT = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASH = 256
_HEX = 64


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)), _HASH)


def lower_letters(text: Column) -> Column:
    """A-Z as a-z, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def lowered_ids(doc_id: Column) -> Column:
    """Rows whose text the audit lower-cases: 3 divides the crc32 of the decimal id. A row without id is left alone."""
    return F.coalesce((remainder(doc_id, 3) == 0) & doc_id.isNotNull(), F.lit(False))


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    A leaf is the hash of ``doc_id, source, lang, n_chars, text``. Per ``lang`` the leaves
    ascend by ``doc_id``; while several nodes are left, each run of ``fanout`` (the last may
    be shorter) becomes one. The nodes left, ordered by language, give the root the same way.
    ``proof_sha256`` is the hash of all siblings from the leaf up to the root.
    ``tampered`` marks rows that are read again with A-Z of their text in lower case: their
    ``folded_root`` starts from that leaf, all others from their own, over the original siblings.

    Null ids come first in their language and null languages before all others; rows of one
    id are ordered by leaf, and rows equal in everything keep a place and a proof each. A null
    text is framed as ``-``, so it differs from an empty one, and is never changed by
    tampering. Texts are hashed whole. Other columns are ignored, whatever their names. An
    empty table gives no rows.
    """
    base = [docs[c] for c in (doc_id, "source", group, "n_chars")]
    leaf = leaf_hash(*base, docs["text"])
    marked = F.lit(False) if tampered is None else tampered
    other = F.when(marked, leaf_hash(*base, lower_letters(docs["text"])))
    named = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))  # null before all others, else bytewise
    leaves = docs.select(
        docs[doc_id].alias("doc_id"), named.alias("tree"), leaf.alias("h"), other.alias("changed"), F.monotonically_increasing_id().alias("row")
    )
    placed = places_in_groups(stored(leaves, "leaves"), "tree", ["doc_id", "h", "row"])
    levels = _levels(placed, ["h", "doc_id", "changed"], fanout)
    single = [placed.filter("n = 1").select("tree", "h", F.lit(0).alias("height"))]
    done = [x.filter("n = 1").select("tree", "h", F.lit(i + 1).alias("height")) for i, x in enumerate(levels)]
    subroots = single[0]
    for more in done:
        subroots = subroots.unionByName(more)
    subroots = stored(subroots.withColumnsRenamed({"tree": "name"}).withColumn("tree", F.lit("")), "subroots")

    tops = places_in_groups(subroots, "tree", ["name"])
    upper = _levels(tops, ["h", "name", "height"], fanout)
    top = upper[-1] if upper else tops
    first = top.select("h").first()
    root = F.lit(None if first is None else first.h).cast("string")
    start = top.select("tree", "pos", _no_path(), F.lit("").alias("subroot"))
    whole = start.join(tops.select("tree", "pos", "h", "name", "height"), ["tree", "pos"]) if not upper else _descend(start, upper, fanout)
    tops = stored(whole.select(F.col("name").alias("tree"), "height", "path", F.col("h").alias("subroot")), "tops")

    alone = placed.filter("n = 1").join(tops.filter("height = 0").drop("height"), "tree")
    rows = alone.select("doc_id", "h", "changed", "path", "subroot")
    if levels:
        paths = tops.limit(0).select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot")
        rows = rows.unionByName(_descend(paths, levels, fanout, tops).select("doc_id", "h", "changed", "path", "subroot"))
    siblings = F.concat_ws("", F.transform("path", lambda run: F.concat(run["before"], run["after"])))
    fold = F.aggregate("path", F.coalesce("changed", "h"), lambda h, run: F.sha2(F.concat(run["before"], h, run["after"]), _HASH))
    proved = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, _HASH).alias("proof_sha256"), fold.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _no_path() -> Column:
    return F.array().cast("array<struct<before:string,after:string>>").alias("path")


def _child(k: int, field: str = "h") -> Column:
    return F.col(f"c{k}")[field]


def _levels(nodes: DataFrame, fields: list[str], fanout: int) -> list[DataFrame]:
    """Level by level, a row per parent: its children in columns ``c0, c1, ...``, its hash, its place and its level's size.

    ``nodes`` has ``tree, pos, n`` and ``fields``, of which the lowest level's children keep all
    and those above the hash. There are as many levels as the largest tree has: log of its leaves.
    """
    left = nodes.agg(F.max("n").alias("n")).first().n or 0
    levels: list[DataFrame] = []
    while left > 1:
        child = F.struct(*(fields if not levels else ["h"]))
        slot = F.pmod("pos", F.lit(fanout))
        spread = [F.max(F.when(slot == k, child)).alias(f"c{k}") for k in range(fanout)]
        above = [F.expr(f"pos DIV {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) DIV {fanout}").alias("n")]
        parents = nodes.filter("n > 1").groupBy("tree", *above).agg(*spread)
        hashed = F.sha2(F.concat_ws("", *[_child(k) for k in range(fanout)]), _HASH)
        nodes = stored(parents.withColumn("h", hashed), f"level-{len(levels) + 1}")
        levels.append(nodes)
        left = -(-left // fanout)
    return levels


def _descend(paths: DataFrame, levels: list[DataFrame], fanout: int, tops: DataFrame | None = None) -> DataFrame:
    """The lowest children with ``path``: what stands before and after them in each run, from their own run upwards.

    ``paths`` are those of the highest nodes; ``tops`` adds those of trees of less height at their level.
    """
    for i in range(len(levels), 0, -1):
        if tops is not None:
            own = tops.filter(F.col("height") == i).select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot")
            paths = paths.unionByName(own)
        parents = levels[i - 1]
        rows = parents.count()
        width = 2 * _HEX * fanout * (len(levels) - i + 2) + 256
        joined = parents.drop("n", "h").join(hinted(paths, width, rows), ["tree", "pos"])
        fields = [f.name for f in parents.schema["c0"].dataType.fields]

        def run(k: int) -> Column:
            sides = [F.concat_ws("", *[_child(j) for j in part]) if part else F.lit("") for part in (range(k), range(k + 1, fanout))]
            return F.struct(sides[0].alias("before"), sides[1].alias("after"))

        slots = F.array(*[F.when(_child(k).isNotNull(), F.struct(run(k).alias("run"), *[_child(k, f).alias(f) for f in fields])) for k in range(fanout)])
        below = explode_each(joined, slots, "tree", "path", "subroot", F.col("pos").alias("parent"), pos="slot").filter("v IS NOT NULL")
        paths = below.select(
            "tree",
            (F.col("parent") * fanout + F.col("slot")).alias("pos"),
            F.concat(F.array("v.run"), F.col("path")).alias("path"),
            "subroot",
            *[F.col(f"v.{f}").alias(f) for f in fields],
        )
        if i > 1:
            paths = paths.drop("h")
    return paths
