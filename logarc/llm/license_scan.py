"""License scan by diagonal voting: word k-grams joined to template positions, summed along offset diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.explode import explode_each
from .common import hinted, text_key

# Labels and the wording they are known by, as lower-case words.
TEMPLATES = [
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("reserved", "all rights reserved"),
]
# The base phrases.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
K = 3
# Diagonals this close to each other are one alignment with words put in or left out.
SLACK = 3
MIN_COVERAGE = 0.6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. Null: none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def known_templates(spark: SparkSession) -> DataFrame:
    """``label, wording`` of the built-in list."""
    return spark.createDataFrame(TEMPLATES, "label string, wording string")


def template_positions(templates: DataFrame) -> DataFrame:
    """``gram, template, label, at, grams, t0, t1, ...``: each word k-gram of each template by its place.

    ``templates`` is any table of ``label, wording``, with one-line notices or full licence
    texts. Repeated rows are one template; those of fewer than ``K`` words have no k-gram.
    """
    number = F.shiftrightunsigned(F.xxhash64("label", "wording"), 1).alias("template")
    worded = templates.select("label", "wording").distinct().select(number, "label", license_words(F.col("wording")).alias("words"))
    worded = worded.filter(F.size("words") >= K).withColumn("grams", F.size("words") - (K - 1))
    shifted = F.arrays_zip(*[F.slice("words", i + 1, F.col("grams")).alias(f"t{i}") for i in range(K)])
    rows = explode_each(worded, shifted, "template", "label", "grams", pos="at", item="gram_words")
    parts = [F.col(f"gram_words.t{i}").alias(f"t{i}") for i in range(K)]
    return rows.select("template", "label", "grams", "at", *parts).withColumn("gram", F.xxhash64(*[f"t{i}" for i in range(K)]))


def _grams(docs: DataFrame, text: str) -> DataFrame:
    """One row per word of each text: its place and the words that begin there (null beyond the end)."""
    words = docs.select(*text_key(text), license_words(F.col(text)).alias("words"))
    shifted = F.arrays_zip(F.col("words").alias("w0"), *[F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(1, K)])
    rows = explode_each(words, shifted, "h1", "h2", item="gram")
    return rows.select("h1", "h2", "pos", *[F.col(f"gram.w{i}").alias(f"w{i}") for i in range(K)])


def _base(grams: DataFrame) -> DataFrame:
    """Places of the base phrases, per text."""
    label = F.lit(None).cast("string")
    for phrase, name in PHRASES:
        is_here = F.lit(True)
        for i, word in enumerate(phrase.split()):
            is_here = is_here & F.col(f"w{i}").eqNullSafe(F.lit(word))
        label = F.when(is_here, F.lit(name)).otherwise(label)
    found = grams.select("h1", "h2", "pos", label.alias("label")).filter(F.col("label").isNotNull())
    return found.select("h1", "h2", F.lit(-1).cast("long").alias("template"), "label", F.lit(0).alias("grams"), "pos", F.lit(0).alias("at"))


def _votes(grams: DataFrame, templates: DataFrame) -> DataFrame:
    """All k-grams joined to the template positions; the words decide, not the hash alone."""
    hashed = grams.withColumn("gram", F.xxhash64(*[f"w{i}" for i in range(K)]))
    equal = F.col("words.gram") == F.col("places.gram")
    for i in range(K):
        equal = equal & (F.col(f"w{i}") == F.col(f"t{i}"))
    joined = hashed.alias("words").join(hinted(templates, 192).alias("places"), equal)
    return joined.select("h1", "h2", "template", "label", "grams", "pos", "at")


def license_spans(votes: DataFrame) -> DataFrame:
    """``h1, h2, label, first, last, coverage``: verified alignments of a template with a text.

    Votes are summed along diagonals (place in the text less place in the template);
    diagonals at most ``SLACK`` apart that follow each other are merged. A span holds
    if it covers ``MIN_COVERAGE`` of the template's k-grams in at most half as many words again.
    """
    diagonal = votes.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("h1", "h2", "template", "label", "grams", "diagonal")
    sums = diagonal.agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("h1", "h2", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True))
    numbered = sums.withColumn("fresh", fresh.cast("int")).withColumn("group", F.sum("fresh").over(along))
    merged = numbered.groupBy("h1", "h2", "template", "label", "grams", "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        F.min("first").alias("first"),
        (F.max("last") + K - 1).alias("last"),
    )
    coverage = F.col("covered") / F.col("grams")
    room = (F.col("grams") + K - 1) * 1.5 + 1
    return merged.filter((coverage >= MIN_COVERAGE) & (F.col("last") - F.col("first") + 1 <= room)).select(
        "h1", "h2", "label", "first", "last", coverage.alias("coverage")
    )


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row.

    Base: places where a phrase of ``PHRASES`` stands word for word. ``labels`` adds
    those of templates found by diagonal voting; ``score`` is the best coverage of a
    template, 1 with a base phrase, 0 without any find. Null text: empty; repeated
    rows, null ids and equal texts each keep a row; other columns are ignored.
    ``templates`` (``label, wording``) takes the place of the built-in list.

    Texts are worked on by their 128-bit key, so what is shuffled is the finds alone;
    the templates' positions are broadcast only if their counted number is small.
    """
    grams = _grams(docs, text)
    base = _base(grams)
    votes = _votes(grams, template_positions(known_templates(docs.sparkSession) if templates is None else templates))
    found = base.unionByName(votes).distinct()  # equal texts give equal rows
    spans = license_spans(found.filter("template >= 0"))
    base_part = found.filter("template < 0").groupBy("h1", "h2").agg(
        F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    span_part = spans.groupBy("h1", "h2").agg(F.max("coverage").alias("coverage"), F.collect_set("label").alias("span_set"))
    finds = base_part.join(span_part, ["h1", "h2"], "full")
    rows = docs.select(docs[doc_id].alias("doc_id"), *text_key(text), F.size(license_words(F.col(text))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    base_set = F.coalesce("base_set", none)
    return rows.join(finds, ["h1", "h2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.coalesce("span_set", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
