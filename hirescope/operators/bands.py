"""Pay bands over a history that grows by the day, from sketches that merge.

Each day's postings are folded to one quantile sketch for each family, place and side of
the band, and stored by day. A report merges the days it covers: first to cells, then to
families, places and everything, so that no posting of an earlier day is read again and
a report over years reads a sketch a day and cell. A day landed again replaces itself.

A KLL sketch of size k tells a quantile's rank within ``rank_error(k)`` of the count, 99
times in 100, also after any number of merges; up to about k values it is exact. The
exact bands are ``market.pooled_bands``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .market import GROUP
from .ranks import value_counts

SIZE = 400
LEVELS = (("job_family", "place"), ("job_family",), ("place",), ())


def rank_error(k: int = SIZE) -> float:
    """The published single-sided bound on a KLL sketch's normalised rank, at 99 in 100."""
    return 2.296 / k ** 0.9723


def _sides(rows: DataFrame, *keep: str) -> DataFrame:
    """low and high as rows of (side, amount); missing ones drop out."""
    pair = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("amount")) for s in ("low", "high")])
    return rows.select(*keep, *GROUP, F.explode(pair).alias("s")).select(*keep, *GROUP, "s.*").filter("amount IS NOT NULL")


def daily_sketches(rows: DataFrame, day: str = "day", k: int = SIZE) -> DataFrame:
    """One sketch a day, family, place and side. ``rows`` has market columns and a day."""
    return _sides(rows, day).groupBy(F.col(day).alias("day"), *GROUP, "side").agg(
        F.kll_sketch_agg_double("amount", F.lit(k)).alias("sketch"))


def store_days(rows: DataFrame, path: str, day: str = "day", k: int = SIZE) -> None:
    """Write the days of ``rows``; those stored before are replaced, the others stay."""
    out = daily_sketches(rows, day, k).repartition("day")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored sketches of the days from ``since`` to ``until``, both included; other days' folders aren't read."""
    rows = spark.read.parquet(path)
    for bound, keep in ((since, F.col("day") >= F.lit(since)), (until, F.col("day") <= F.lit(until))):
        rows = rows if bound is None else rows.filter(keep)
    return rows


def merged_bands(days: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """A03 from sketches: any_family, any_place, job_family, place, side, n and a column for
    each quantile (``q50`` for the median)."""
    cells = days.groupBy(*GROUP, "side").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    pooled = cells.groupingSets([[*level, "side"] for level in LEVELS], *GROUP, "side").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        *[F.grouping(c).alias(f"any_{c.removeprefix('job_')}") for c in GROUP])
    return pooled.select(
        "any_family", "any_place", *GROUP, "side", F.kll_sketch_get_n_double("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in quantiles])


def sketched_bands(days: DataFrame) -> DataFrame:
    """The columns of ``market.pooled_bands``, whose medians are within the rank error."""
    rows = merged_bands(days)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return rows.groupBy("any_family", "any_place", *GROUP).agg(
        *[F.coalesce(side(s, "n"), F.lit(0)).alias(f"n_{s}") for s in ("low", "high")],
        *[side(s, "q50").alias(f"median_{s}") for s in ("low", "high")])


def true_ranks(bands: DataFrame, rows: DataFrame, quantile: str = "q50") -> DataFrame:
    """Where merged quantiles stand among the values themselves: ``below`` and ``upto``, the
    shares under the value and up to it. For checks: it reads all values."""
    counted = value_counts(_sides(rows), [*GROUP, "side"], "amount")
    keys = ["any_family", "any_place", *GROUP, "side"]
    every = counted.groupingSets([[*level, "side", "amount"] for level in LEVELS], *GROUP, "side", "amount").agg(
        F.sum("n").alias("_n"), *[F.grouping(c).alias(f"any_{c.removeprefix('job_')}") for c in GROUP])
    b, v = bands.alias("b"), every.alias("v")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"v.{c}")) for c in keys]
    return b.join(v, same).groupBy(*[f"b.{c}" for c in keys], "b.n").agg(
        (F.sum(F.when(F.col("amount") < F.col(quantile), F.col("_n")).otherwise(0)) / F.col("b.n")).alias("below"),
        (F.sum(F.when(F.col("amount") <= F.col(quantile), F.col("_n")).otherwise(0)) / F.col("b.n")).alias("upto"))
