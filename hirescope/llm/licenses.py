"""License scans by diagonal voting.

Every rolling word pair of every text meets the positions of equal pairs in the
templates, in one join on the pair's hash (the words themselves are compared too). A
hit at document word d and template word t votes for the diagonal d - t. Votes are
gathered by (text, template, diagonal) as a bit mask of template positions, so that
copies of a text and repeated hits count once. Diagonals of one template within
``SLACK`` words of each other are merged (words put in or left out), and a span is
verified by the share of the template's pairs that its diagonals cover.

Base phrases are templates whose single diagonal must hold every pair: the places
where their words stand consecutively. The other templates add labels of their own:
those of fewer than ``LONG`` pairs need all of them, longer ones a share ``COVER``.

Results, for each row: ``n_words``; ``n_base`` (all places of base phrases),
``first_word`` and ``last_word`` (their smallest and largest start, else null);
``base_labels`` and ``labels`` (distinct, sorted, comma-joined); ``score`` (the
largest share covered by a verified span; 1 with any base phrase, 0 without a span).

Nulls: a null text is empty and matches nothing; a null id is kept. Repeated rows
give a row each; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirescope.session import written

# Phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Passages of well-known licenses, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("the software is provided as is without warranty of any kind express or implied", "no-warranty"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("released under the mit license", "mit-notice"),
)
SLACK, COVER, LONG = 2, 0.75, 10
#: Template positions in one bit mask.
MASK = 60
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _templates(spark: SparkSession) -> DataFrame:
    """template, label, is_base, pairs, at, part, bit, w, v: a row for each word pair; a
    fixed table."""
    rows = []
    for i, (phrase, label) in enumerate((*BASE, *TEMPLATES)):
        words = phrase.split()
        rows += [(i, label, i < len(BASE), len(words) - 1, at, at // MASK, 1 << at % MASK, w, v) for at, (w, v) in enumerate(zip(words, words[1:], strict=False))]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, pairs int, at int, part int, bit long, w string, v string")


def _votes(texts: DataFrame) -> DataFrame:
    """Spans by (text, template): is_base, first, votes."""
    words = texts.select("key", words_of(F.col("text")).alias("_w"))
    pairs = words.filter(F.size("_w") > 1).select("key", F.posexplode(F.arrays_zip(
        F.slice("_w", F.lit(1), F.size("_w") - 1).alias("w"), F.slice("_w", F.lit(2), F.size("_w") - 1).alias("v"))).alias("d", "_p"))
    pairs = pairs.select("key", "d", F.col("_p.w").alias("dw"), F.col("_p.v").alias("dv"))
    templates = _templates(texts.sparkSession)
    hits = pairs.join(
        F.broadcast(templates),  # a fixed table of some hundred rows
        (F.xxhash64("dw", "dv") == F.xxhash64("w", "v")) & (F.col("dw") == F.col("w")) & (F.col("dv") == F.col("v")))
    place = ["key", "template", "label", "is_base", "pairs", (F.col("d") - F.col("at")).alias("diagonal")]
    masks = written(hits.groupBy(*place, "part").agg(F.bit_or("bit").alias("mask")), "votes")
    diagonals = masks.withColumn("votes", F.bit_count("mask"))
    base = diagonals.filter("is_base").groupBy("key", "template", "label", "is_base", "pairs", "diagonal").agg(
        F.sum("votes").alias("votes")).filter("votes = pairs").select(
        "key", "label", "is_base", F.col("diagonal").alias("first"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int")
    merged = diagonals.filter("NOT is_base").withColumn(
        "_run", F.sum(F.coalesce(fresh, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("key", "template", "label", "is_base", "pairs", "_run", "part").agg(
        F.min("diagonal").alias("first"), F.bit_or("mask").alias("mask")).groupBy(
        "key", "template", "label", "is_base", "pairs", "_run").agg(
        F.min("first").alias("first"), (F.sum(F.bit_count("mask")) / F.first("pairs")).alias("share"))
    return base.unionByName(spans.filter(F.col("share") >= F.when(F.col("pairs") < LONG, 1.0).otherwise(COVER)).select("key", "label", "is_base", "first", "share"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    own = F.col("is_base")
    found = _votes(rows.select("key", "text")).groupBy("key").agg(
        F.count(F.when(own, 1)).alias("n_base"), F.min(F.when(own, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(own, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(own, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    # Read from a table, so that a text with many copies may be split in the join below.
    found = written(found, "labels")
    counted = rows.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    joined = counted.join(found, "key", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
