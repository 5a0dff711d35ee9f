"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

``fit`` learns, from a bounded sample, a rotation whose signs make 64-bit codes
(centred vectors; alternating sign and Procrustes steps) and the Hamming radius
within which the wanted share of the sample's own nearest neighbours lies. Every
vector is indexed: vectors are dealt into blocks of bounded size, and a block
enters its codes under each of 8 substrings of 8 bits. A query probes, in each
substring's table, every value within ``radius // 8`` bit errors; by the pigeonhole
that finds every code within the radius. Those within it are ranked by distance of
the original vectors. A block that holds fewer than k codes within the radius ranks
all its vectors. The queries meet every block: they are a stated set.

Distances are Euclidean, in double precision; ties go to the smaller id. A query's
own id is no candidate; repeated query ids count once, repeated candidates each
time. Vectors that are null, zero, hold nulls or non-finite values, or differ in
length from the most common length take no part. An empty table, or one without
queries, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, PARTS = 64, 8
WIDTH = BITS // PARTS
#: Vectors the rotation and radius are learned from; share of neighbours within it.
SAMPLE, SHARE = 10_000, 0.985
#: Vectors in a block, queries in a block.
BLOCK, QUERY_BLOCK = 20_000, 2_000


def fit(sample: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """Centre, rotation (dimensions x BITS) and radius."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    x = sample - centre
    turn = rng.normal(size=(x.shape[1], BITS))
    for _ in range(30):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0), full_matrices=False)
        turn = u @ v
    codes = coded(sample, centre, turn)
    some = rng.permutation(len(x))[:300]
    far = np.empty((len(some), min(k, len(x) - 1)), int)
    for row, i in enumerate(some):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        far[row] = np.bitwise_count(codes[np.argsort(d, kind="stable")[:far.shape[1]]] ^ codes[i])
    return centre, turn, int(np.quantile(far, SHARE, method="higher")) if far.size else BITS


def coded(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.packbits((x - centre) @ turn > 0, axis=1).view("<u8").ravel()


def _masks(errors: int) -> np.ndarray:
    """Every value of a substring with at most so many bits set."""
    return np.array([sum(1 << i for i in c) for n in range(errors + 1) for c in combinations(range(WIDTH), n)], np.uint8)


class Block:
    """The substring tables of one block's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(np.uint8).reshape(-1, PARTS)
        self.order = np.argsort(self.parts, axis=0, kind="stable")
        values = np.arange(2 ** WIDTH + 1)
        self.starts = np.stack([np.searchsorted(self.parts[self.order[:, p], p], values) for p in range(PARTS)])

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code is within the radius, by probing."""
        masks, seen = _masks(min(radius // PARTS, WIDTH)), np.zeros(len(self.codes), bool)
        for p, value in enumerate(np.array([code]).view(np.uint8)):
            for probe in masks ^ value:
                seen[self.order[self.starts[p, probe]:self.starts[p, int(probe) + 1], p]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def usable(vector: Column) -> Column:
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))

    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each id of ``queries``
    (a condition on ``vec_id``)."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "query_id long, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimensions, n = sizes[0]["d"], sizes[0]["count"]
    base = base.filter(F.size("v") == dimensions)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    centre, turn, radius = fit(np.array([r["v"] for r in sample]), k)
    asked = base.filter(queries).dropDuplicates(["vec_id"])
    blocks, query_blocks = -(-n // BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def search(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(ask) and len(have):
            have = have.sort_values("vec_id", kind="stable")
            x, ids = np.stack(have["v"].to_list()), have["vec_id"].to_numpy()
            block = Block(coded(x, centre, turn))
            q = np.stack(ask["v"].to_list())
            for query, vector, code in zip(ask["vec_id"], q, coded(q, centre, turn), strict=True):
                near = block.within(code, radius)
                near = near[ids[near] != query]
                if len(near) < k:
                    near = np.flatnonzero(ids != query)
                score = np.sqrt(((x[near] - vector) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                rows += [(query, int(ids[near[i]]), float(score[i])) for i in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    left = dealt(asked, "q", query_blocks, "b", blocks).groupBy("b", "q")
    right = dealt(base, "b", blocks, "q", query_blocks).groupBy("b", "q")
    found = left.cogroup(right).applyInPandas(search, out)
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("_best"))
    return best.select("query_id", F.posexplode("_best").alias("_at", "_hit")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), "_hit.vec_id", "_hit.score")
