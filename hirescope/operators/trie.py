"""A phrase library as a trie in a table, walked over texts level by level.

An edge leads from a prefix to the prefix one word longer; prefixes are named by their
hash. The first level joins a text's words to the first words of the library. From then
on only prefixes that the library goes on from are extended, by one join a level, so a
level has no more rows than the one before has live prefixes, and phrases may be of any
length. Words are compared as words: a hash only has to tell the library's own prefixes
apart, which ``phrase_trie`` checks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import written

WORD = r"\.?[A-Za-z0-9+#]+(?:[.\-/&'][A-Za-z0-9+#]+)*"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(WORD), F.lit(0))


def phrase_trie(phrases: DataFrame) -> DataFrame:
    """Edges of the library (phrase, cased, term): level, cased, parent, word, node, the
    term that ends here or null, and how many words may follow."""
    parts = phrases.withColumn("_w", F.split("phrase", " ")).withColumn("_n", F.size("_w"))
    name = lambda i: F.xxhash64("cased", F.array_join(F.slice("_w", F.lit(1), i), " "))
    steps = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.struct(
        i.alias("level"), name(i - 1).alias("parent"), F.get("_w", i - 1).alias("word"), name(i).alias("node"),
        F.when(i == F.col("_n"), F.col("term")).alias("term"), (F.col("_n") - i).alias("deeper")))
    edges = written(
        parts.select("cased", F.explode(steps).alias("e")).select("cased", "e.*")
        .groupBy("cased", "level", "parent", "word")
        .agg(F.min("node").alias("node"), F.min("term").alias("term"), F.max("deeper").alias("deeper")), "trie")
    if edges.groupBy("node").count().filter("count > 1").limit(1).count():
        raise ValueError("two prefixes of the library have one hash")
    return edges


def levels(texts: DataFrame, key: Sequence[str], text: str, trie: DataFrame) -> Iterator[DataFrame]:
    """Live prefixes, a table for each level: key, start (from 1), cased, node, term, deeper.

    The words after a first word that begins a longer phrase are fetched once, as many as
    the library may need.
    """
    words = texts.select(*key, tokens(text).alias("_words"))
    each = words.select(*key, F.posexplode("_words").alias("_at", "_word"))
    # A word is looked up as written and in lower case, in whichever part the library has.
    size = trie.agg(F.max("level").alias("depth"), F.collect_set("cased").alias("parts")).first()
    ways = [F.struct(F.lit(part).alias("cased"), (F.col("_word") if part else F.lower("_word")).alias("word")) for part in sorted(size.parts) or [False]]
    way = F.explode(F.array(*ways)) if len(ways) > 1 else ways[0]
    spelt = each.select(*key, (F.col("_at") + 1).alias("start"), way.alias("w")).select(*key, "start", "w.*")
    kept = [*key, "start", "cased", "node", "term", "deeper"]
    depth = size.depth or 0
    first = written(spelt.join(trie.filter("level = 1"), ["cased", "word"]).select(*kept), "trie-level")
    yield first
    live = first.filter("deeper > 0")
    if depth < 2 or live.isEmpty():
        return
    longer = live.join(words, list(key)).withColumn("_rest", F.slice("_words", F.col("start") + 1, F.col("deeper")))
    rest = F.when(F.col("cased"), F.col("_rest")).otherwise(F.transform("_rest", F.lower)).alias("_rest")
    live = longer.filter(F.size("_rest") > 0).select(*kept, rest)
    for level in range(2, depth + 1):
        edge = trie.filter(F.col("level") == level).select(
            "cased", F.col("parent").alias("_from"), F.col("word").alias("_word"), F.col("node").alias("_node"),
            F.col("term").alias("_term"), F.col("deeper").alias("_deeper"))
        here = live.withColumn("_next", F.get("_rest", F.lit(level - 2)))
        met = here.join(edge, (here["cased"] == edge["cased"]) & (here["node"] == edge["_from"]) & (here["_next"] == edge["_word"]))
        rows = written(met.select(*key, "start", here["cased"], F.col("_node").alias("node"), F.col("_term").alias("term"),
                                  F.col("_deeper").alias("deeper"), "_rest"), "trie-level")
        yield rows.select(*kept)
        live = rows.filter((F.col("deeper") > 0) & (F.size("_rest") >= level))
        if live.isEmpty():
            return


def matches(texts: DataFrame, key: Sequence[str], text: str, trie: DataFrame) -> DataFrame:
    """Every place of every phrase: key, start, len, cased, term."""
    found = [rows.filter("term IS NOT NULL").select(*key, "start", F.lit(n).alias("len"), "cased", "term")
             for n, rows in enumerate(levels(texts, key, text, trie), 1)]
    return reduce(DataFrame.unionByName, found)


def leftmost_longest(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """The places that reading from the left takes: key, start, len, term; the longest phrase
    at a place, as written before case-blind, and no word twice.

    Only places that overlap have to be taken one after the other; they are cut into
    stretches that nothing reaches across, and folded stretch by stretch.
    """
    best = found.groupBy(*key, "start").agg(F.max(F.struct("len", "cased", "term")).alias("b")).select(
        *key, "start", "b.len", "b.term")
    order = Window.partitionBy(*key).orderBy("start")
    reach = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = best.withColumn("_new", (F.coalesce(reach, F.lit(0)) <= F.col("start")).cast("int"))
    stretch = cut.withColumn("_stretch", F.sum("_new").over(order)).groupBy(*key, "_stretch").agg(
        F.sort_array(F.collect_list(F.struct("start", "len", "term"))).alias("_m"))
    empty = F.lit(None).cast("array<struct<start:int,len:int,term:string>>")
    taken = F.aggregate("_m", F.struct(F.lit(0).alias("free"), F.coalesce(empty, F.array()).alias("out")), lambda s, m: F.when(
        m["start"] < s["free"], s).otherwise(F.struct((m["start"] + m["len"]).alias("free"), F.array_append(s["out"], m).alias("out"))),
        lambda s: s["out"])
    return stretch.select(*key, F.explode(F.when(F.size("_m") == 1, F.col("_m")).otherwise(taken)).alias("m")).select(*key, "m.*")


def match_library(texts: DataFrame, key: Sequence[str], text: str, phrases: DataFrame) -> DataFrame:
    """(key, term, n) of the phrases read from the left."""
    trie = phrase_trie(phrases)
    found = matches(texts, key, text, trie)
    single = trie.filter("cased OR level > 1").isEmpty()
    taken = found if single else leftmost_longest(found, key)
    return taken.groupBy(*key, "term").agg(F.count("*").alias("n"))
