"""Near-duplicate groups by a multi-index Hamming join of b-bit signatures.

A document is its set of word shingles. Its signature holds ``SYMBOLS`` min-hash
symbols of 16 bits, in ``CHUNKS`` chunks of four. Two signatures that differ in
at most ``REACH`` symbols have, by the pigeonhole, a chunk that differs in at most
``REACH // CHUNKS`` = 1 symbol. So each signature is entered under every chunk with
every one symbol left out, and any such pair meets under a key. At a similarity
of 0.8 a symbol differs with probability 0.2, and more than ``REACH`` of ``SYMBOLS``
do in one pair of 250,000; at 0.85 in one of 10^8. Pairs that meet and are within
reach are confirmed on the full sets.

Equal sets are one class before anything is joined. Pairs within a key are not all
emitted. First each key's members meet its smallest class. A key whose members are
then in one component needs no more. In keys of up to ``SMALL`` members the members of
different components meet in a join. Families of classes that meet in larger keys are
compared in blocks of ``BLOCK`` classes, block against block: signatures first, then
the full sets, as one product of incidence matrices; a block sends on the links that
join components, not the pairs it has compared. So no link between components is lost.

Results: ``n_shingles`` (set size), ``component_id`` (smallest id reachable, itself
included), ``kept`` (id = component_id). Null or empty texts have no shingles and
are linked with nothing. A null id takes part in no link: its component is null
and it is kept. Repeated rows share a component; an id with several texts stands
for all of them. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.components import components
from hirescope.llm.words import ascii_words, finish, mapped, rolling, word_hashes
from hirescope.session import written

SYMBOLS, CHUNKS, REACH = 48, 12, 23
WIDTH = SYMBOLS // CHUNKS
#: Members of a key that are joined with each other; classes in a block of a larger family.
SMALL, BLOCK = 32, 400
#: Shingles that are multiplied at once.
COLUMNS = 8_000
#: Rows, and bytes of their texts, that may be sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 8_000_000

_seeds = np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_XOR, _MUL = finish(_seeds)[:, None], (finish(_seeds + np.uint64(1)) | np.uint64(1))[:, None]
_BLOCK = 4096


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted."""
    return np.unique(rolling(word_hashes(ascii_words(text)), size))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the mixed minimum under each hash."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        np.minimum(least, ((shingles[None, i:i + _BLOCK] ^ _XOR) * _MUL).min(axis=1), out=least)
    return (finish(least) & np.uint64(0xFFFF)).astype(np.uint16)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits over the sorted set), signature."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, ids, signatures = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, size)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "set_id": ids, "signature": signatures})

    return mapped(docs, sign, T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_shingles", T.LongType()),
        T.StructField("set_id", T.BinaryType()), T.StructField("signature", T.BinaryType())]))


def _entries(classes: DataFrame) -> DataFrame:
    """``key``, ``node``: every chunk with every one symbol left out."""
    keep = np.array([[j for j in range(WIDTH) if j != gone] for gone in range(WIDTH)])
    tag = finish(np.arange(CHUNKS * WIDTH, dtype=np.uint64) + np.uint64(7)).reshape(CHUNKS, WIDTH)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                s = np.frombuffer(b"".join(batch["signature"]), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
                packed = s[:, :, keep]
                packed = packed[..., 0] | packed[..., 1] << np.uint64(16) | packed[..., 2] << np.uint64(32)
                keys = finish(packed + tag).reshape(len(batch), -1).view(np.int64)
                yield pd.DataFrame({"key": keys.ravel(), "node": batch["node"].repeat(keys.shape[1]).to_numpy()})

    return mapped(classes.select("node", "signature"), entries, T.StructType([
        T.StructField("key", T.LongType()), T.StructField("node", classes.schema["node"].dataType)]))


def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """Symbols in which two signatures differ."""
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, SYMBOLS) for s in (a, b))
    return pd.Series((x != y).sum(axis=1).astype("int32"))


def small(df: DataFrame) -> DataFrame:
    """Sent to every executor if it is a written table of few rows and bytes; numbers take 8 bytes at most."""
    sizes = [F.octet_length(c) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    n, size = df.agg(F.count("*"), F.sum(sum(sizes[1:], F.coalesce(sizes[0], F.lit(0))))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node``, ``shingles`` of the classes in ``nodes``."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["doc_id"], "shingles": [shingle_set(t, size).view(np.int64) for t in batch["text"]]})

    found = docs.join(small(nodes), F.col("doc_id") == F.col("node"), "left_semi")
    return mapped(found, sets, T.StructType([
        T.StructField("node", docs.schema["doc_id"].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(a, "a").join(b, "b").filter(
        100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b")


def _within_reach(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs, smaller id first, whose signatures are within reach."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    apart = F.pandas_udf(_apart, T.IntegerType())
    a = classes.select(F.col("node").alias("a"), F.col("signature").alias("_x"))
    b = classes.select(F.col("node").alias("b"), F.col("signature").alias("_y"))
    return pairs.join(a, "a").join(b, "b").filter(apart("_x", "_y") <= REACH).select("a", "b").distinct()


def _products(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every one of ``y``."""
    flat = np.concatenate([*x, *y])
    distinct, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[place]
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    out = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, int(often.sum()), COLUMNS):
        inside = (column >= start) & (column < start + COLUMNS)
        hit = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        hit[row[inside], column[inside] - start] = 1
        out += hit[:len(x)] @ hit[len(x):].T
    return out


def _block_links(group: pd.DataFrame, percent: int) -> list[tuple]:
    """Links that join components, between the two sides of a block pair or within one."""
    if group["side"].nunique() > 1:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
    else:
        left = right = group
    sides = [np.frombuffer(b"".join(g["signature"]), np.uint16).reshape(-1, SYMBOLS) for g in (left, right)]
    sets = [[np.asarray(s) for s in g["shingles"]] for g in (left, right)]
    size = [np.array([len(s) for s in x]) for x in sets]
    both = _products(*sets)
    near = 100 * both >= percent * (size[0][:, None] + size[1][None] - both)
    root: dict = {}

    def find(c):
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    out = []
    ids, parts = [g["node"].to_numpy() for g in (left, right)], [g["component"].to_numpy() for g in (left, right)]
    for i, j in zip(*np.nonzero(near), strict=True):
        p, q = find(parts[0][i]), find(parts[1][j])
        if p != q and (sides[0][i] != sides[1][j]).sum() <= REACH:
            root[max(p, q)] = min(p, q)
            out.append((ids[0][i], ids[1][j]))
    return out


def _family_links(large: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the classes (``key``, ``node``, ``component``) that meet in large keys."""
    least = large.groupBy("key").agg(F.min("node").alias("_least"))
    stars = large.join(least, "key").select(F.col("node").alias("a"), F.col("_least").alias("b")).distinct()
    family = components(stars).withColumnRenamed("component", "family")
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    members = family.join(blocks, "family").join(large.groupBy("node").agg(F.first("component").alias("component")), "node")
    members = members.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    members = members.select(
        "family", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"), "node", "component")
    full = members.join(classes, "node").join(sets, "node")
    kind = classes.schema["node"].dataType

    def links(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(group, percent), columns=["a", "b"])

    return full.groupBy("family", "i", "j").applyInPandas(links, T.StructType([T.StructField(c, kind) for c in "ab"]))


def linked(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """``node``, ``component`` for the classes that have a link."""
    entries = _entries(classes)
    shared = entries.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("_hub")).filter("_n > 1")
    entries = written(entries.join(shared, "key"), "entries")
    nodes = written(entries.select("node").distinct(), "nodes")
    sets = written(_sets(docs, nodes, size), "sets")
    stars = entries.filter("node <> _hub").select(F.col("node").alias("a"), F.col("_hub").alias("b"))
    links = written(_confirmed(_within_reach(stars, classes), sets, percent), "stars")
    labels = components(links)
    part = F.coalesce("component", "node").alias("component")
    entries = entries.join(labels, "node", "left").select("key", "node", "_n", part)
    mixed = entries.groupBy("key").agg(F.min("component").alias("_p"), F.max("component").alias("_q")).filter("_p <> _q")
    entries = written(entries.join(mixed.select("key"), "key"), "mixed")
    few = entries.filter(F.col("_n") <= SMALL)
    x = few.select("key", F.col("node").alias("a"), F.col("component").alias("_p"))
    y = few.select("key", F.col("node").alias("b"), F.col("component").alias("_q"))
    met = x.join(y, "key").filter("a < b AND _p <> _q").select("a", "b")
    found = written(_confirmed(_within_reach(met, classes), sets, percent), "joined")
    large = entries.filter(F.col("_n") > SMALL).select("key", "node", "component")
    families = written(_family_links(large, classes, sets, percent), "families")
    return components(links.union(found).union(families))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``.

    Documents are linked where ``100 * intersection >= percent * union`` of their
    sets of ``size``-word shingles.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(signed(docs, size), "signed")
    classes = rows.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    labels = linked(docs.filter("doc_id IS NOT NULL"), classes.select("node", "signature"), size, percent)
    named = classes.select("set_id", "node")
    named = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # One set may be linked through several ids only if an id has several texts.
    named = named.groupBy("set_id").agg(F.min("component").alias("component_id"))
    joined = rows.join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
