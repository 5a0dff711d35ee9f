"""Stupid-backoff scores from n-gram counts of the whole corpus.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Documents are
numbered into blocks of bounded size. A block's distinct n-grams of one to ``order``
words are dealt to count tables by hash, as a run for each table, and exploded there into
rows (table, gram, block, count). The count of an n-gram over all blocks is joined to its
rows in the same shuffle. The joined counts return to their block as one array a table,
where occurrences are scored and summed by document. A frequent n-gram is one row a block,
so no key is hot.

A document is scored against all the others: its own counts are taken off first. With
c the counts in the other documents and N their words, a word after the context of its
longest known n-gram scores c(context, word) / c(context); a single word c(word) / N,
an unknown one BACKOFF / (N + 1). Each word by which the context is shorter than the
document allows (at most ``order`` - 1 words before it) costs a factor BACKOFF.
``log_micro`` adds, for each word, the natural logarithm in millionths, rounded;
``score`` is its mean in natural units. ``n_known`` counts words scored by a known
n-gram of two words or more. N-grams are told apart by 64-bit hashes: of g distinct
ones, some g * g / 2 ** 65 pairs share a count.

Nulls: a null text is empty; empty texts have no words, ``log_micro`` 0 and a null
score. A null id is kept. Repeated rows are documents of their own, so a repeated text
is known from its copy; ties play no part. A document longer than a block is a block
of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirescope.llm.words import ascii_words, finish, mapped
from hirescope.session import scratch

BACKOFF = 0.4
#: Words in a block (one document at least) and, on average, in a count table.
BLOCK_WORDS, TABLE_WORDS = 600_000, 1_000_000
_CHAIN = np.uint64(0xBF58476D1CE4E5B9)


def _packed(places: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte: frequent words have small numbers."""
    return zstandard.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered(docs: DataFrame) -> DataFrame:
    """``block``, ``doc_ids``, ``lengths``, ``places`` (of each word in ``vocabulary``),
    ``vocabulary`` (word hashes, the block's most frequent first)."""

    def block_of(ids: list, parts: list[np.ndarray], index: _Index) -> pd.DataFrame:
        places = np.concatenate(parts)
        by_count = np.argsort(-np.bincount(places, minlength=len(index)), kind="stable")
        rank = np.empty(len(index), np.int64)
        rank[by_count] = np.arange(len(index))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
        return pd.DataFrame([{
            "block": uuid.uuid4().int >> 65, "doc_ids": ids, "lengths": np.array([len(p) for p in parts], np.int64),
            "places": _packed(rank[places]), "vocabulary": hashes[by_count].tobytes()}])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, index, n = [], [], _Index(), 0
        for batch in batches:
            for key, text in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"], strict=True):
                words = ascii_words(text)
                if n and n + len(words) > BLOCK_WORDS:
                    yield block_of(ids, parts, index)
                    ids, parts, index, n = [], [], _Index(), 0
                ids.append(key)
                parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                n += len(words) + 1
        if ids:
            yield block_of(ids, parts, index)

    return mapped(docs, number, T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("places", T.BinaryType()),
        T.StructField("vocabulary", T.BinaryType())]))


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by ``key``: a later join by it moves
    them no more. The catalog forgets the table at once; its files and this frame stay."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", scratch(spark, name)).saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


class _Order:
    """A block's n-grams of one length: their hashes, counts, and each occurrence's place among them."""

    def __init__(self, keys: np.ndarray, place: np.ndarray, counts: np.ndarray, ends: np.ndarray):
        self.keys, self.place, self.counts = keys, place, counts
        self.ends = ends  # the occurrence's last word, as a position in the block


def _orders(lengths: np.ndarray, places: bytes, vocabulary: bytes, order: int) -> list[_Order]:
    distinct, at = np.frombuffer(vocabulary, np.uint64), _unpacked(places)
    words = distinct[at]
    position = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = [_Order(distinct.view(np.int64), at, np.bincount(at, minlength=len(distinct)), np.arange(len(words)))]
    grams = words
    for k in range(1, order):
        ends = np.flatnonzero(position >= k)
        longer = np.zeros(len(words), np.uint64)
        longer[ends] = finish(grams[ends - 1] * _CHAIN + words[ends])
        grams = longer
        out.append(_Order(*np.unique(grams[ends].view(np.int64), return_inverse=True, return_counts=True), ends))
    return out


def _dealt(orders: list[_Order], tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of a block by table, count and gram (equal counts in a row take no room
    in a shuffle): the order, the tables, the grams, the counts."""
    keys, counts = (np.concatenate([getattr(o, name) for o in orders]) for name in ("keys", "counts"))
    table = (keys.view(np.uint64) % np.uint64(tables)).astype(np.int32)
    at = np.argsort(keys, kind="stable")
    at = at[np.argsort((table.astype(np.int64) << 40 | counts)[at], kind="stable")]
    return at, table[at], keys[at], counts[at]


def dealt(blocks: DataFrame, order: int, tables: int) -> DataFrame:
    """``table``, ``block``, ``grams``, ``counts``: a block's distinct n-grams that belong to a
    table, and how often the block has each; by count, then gram."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                orders = _orders(np.asarray(row.lengths, np.int64), row.places, row.vocabulary, order)
                _, table, gram, own = _dealt(orders, tables)
                cuts = np.flatnonzero(np.diff(table)) + 1
                for first, grams, counts in zip([0, *cuts], np.split(gram, cuts), np.split(own, cuts), strict=True):
                    if len(grams):
                        yield pd.DataFrame({"table": [table[first]], "block": [row.block], "grams": [grams], "counts": [counts]})

    longs = T.ArrayType(T.LongType(), False)
    return mapped(blocks, deal, T.StructType([
        T.StructField("table", T.IntegerType(), False), T.StructField("block", T.LongType(), False),
        T.StructField("grams", longs, False), T.StructField("counts", longs, False)]))


def elsewhere(runs: DataFrame, tables: int) -> DataFrame:
    """``block``, ``table``, ``counts``: what the other blocks count of a block's n-grams in a
    table, in the order of its run. The runs are exploded where their table is; a window
    over (gram, table) joins an n-gram's count to its rows, at most one a block, and the
    arrays form by (block, table): all three by the one exchange on the table. (A join by
    table and gram would deal the exploded rows a second time.)"""
    zipped = F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("own"))
    exploded = runs.repartition(tables, "table").select("table", "block", F.posexplode(zipped).alias("place", "entry")).select(
        "table", "block", "place", "entry.gram", "entry.own")
    others = F.sum("own").over(Window.partitionBy("gram", "table")) - F.col("own")
    return exploded.select("table", "block", "place", others.alias("others")).groupBy("block", "table").agg(
        F.sort_array(F.collect_list(F.struct("place", "others")))["others"].alias("counts"))


def _scored(lengths: np.ndarray, orders: list[_Order], corpus: list[np.ndarray], all_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Millionths of log scores, and words known with their context, of each document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    rest = (all_words - lengths)[doc]
    value, shorter, seen = np.zeros(0), np.zeros(0, np.int64), np.zeros(len(doc), bool)
    for k, (grams, total) in enumerate(zip(orders, corpus, strict=True)):
        own_key = doc[grams.ends] * (len(total) + 1) + grams.place
        _, at, own = np.unique(own_key, return_inverse=True, return_counts=True)
        count = total[grams.place] - own[at]
        if k == 0:
            value = np.where(count > 0, count / np.maximum(rest, 1), BACKOFF / (rest + 1))
        else:
            known = count > 0
            value[grams.ends] = np.where(known, count / np.where(known, shorter[grams.ends - 1], 1), BACKOFF * value[grams.ends])
            seen[grams.ends] |= known
        shorter = np.zeros(len(doc), np.int64)
        shorter[grams.ends] = count
    micro = np.rint(np.log(value) * 1e6)
    return (np.bincount(doc, weights=micro, minlength=len(lengths)).astype(np.int64),
            np.bincount(doc, weights=seen, minlength=len(lengths)).astype(np.int64))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """doc_id, n_words, n_known, log_micro, score, by n-grams of at most ``order`` words."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _bucketed(numbered(docs), "block")
    all_words = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    tables = max(16, -(-all_words * order // (2 * TABLE_WORDS)))
    counted = elsewhere(dealt(blocks, order, tables), tables)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        lengths = np.asarray(row["lengths"], np.int64)
        orders = _orders(lengths, row["places"], row["vocabulary"], order)
        at, _, _, own = _dealt(orders, tables)
        corpus = np.empty(len(at), np.int64)
        if len(at):
            corpus[at] = own + np.concatenate(right.sort_values("table")["counts"].tolist())
        cuts = np.cumsum([len(o.keys) for o in orders])[:-1]
        micro, known = _scored(lengths, orders, np.split(corpus, cuts), all_words)
        mean = [m / 1e6 / k if k else None for m, k in zip(micro.tolist(), lengths.tolist(), strict=True)]
        return pd.DataFrame({"doc_id": pd.Series(list(row["doc_ids"]), dtype=object), "n_words": lengths, "n_known": known,
                             "log_micro": micro, "score": pd.Series(mean, dtype="float64")})

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(
        T.StructField(c, T.LongType()) for c in ("n_words", "n_known", "log_micro")), T.StructField("score", T.DoubleType())])
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(score, schema)
