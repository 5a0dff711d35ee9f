"""Exact order statistics per group without a whole group in one task.

Rows are first folded to one count per distinct value (partial aggregation),
so a group holding a third of all rows shrinks to its distinct values. The
running count is then taken in two steps: inside value buckets, and over the
bucket totals. Only bucket totals of one group ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(
    df: DataFrame, group: Sequence[str], value: str, probes: DataFrame | None = None
) -> DataFrame:
    """One row per (group, value): ``n`` peers. ``probes`` adds values nobody
    has, with ``n`` = 0, so a candidate outside the peers still finds its rank."""
    keys = [*group, value]
    own = df.filter(F.col(value).isNotNull()).select(*keys, F.lit(1).alias("n"))
    if probes is not None:
        own = own.unionByName(
            probes.filter(F.col(value).isNotNull()).select(*keys, F.lit(0).alias("n"))
        )
    return own.groupBy(*keys).agg(F.sum("n").alias("n"))


def running_counts(
    counts: DataFrame, group: Sequence[str], value: str, bucket: Column
) -> DataFrame:
    """Adds ``below`` (peers with a smaller value) and ``total`` to value counts.

    ``bucket`` must not decrease as ``value`` grows.
    """
    b = counts.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*group, "_bucket").orderBy(value)
    rows = b.withColumn(
        "_inside",
        F.coalesce(
            F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    totals = b.groupBy(*group, "_bucket").agg(F.sum("n").alias("_n"))
    over_buckets = Window.partitionBy(*group).orderBy("_bucket")
    totals = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_bucket").alias("_b"),
        F.coalesce(
            F.sum("_n").over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("total"),
    )
    match = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return (
        rows.join(totals, [*match, F.col("_bucket") == F.col("_b")])
        .withColumn("below", F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_b", "_before", "_inside", *[f"_g_{g}" for g in group])
    )


def middle_counts(
    counts: DataFrame, group: Sequence[str], value: str, bucket: Column, at_least: int = 1
) -> DataFrame:
    """The rows of ``running_counts`` a median is read from: those of the buckets that
    hold the middle ranks. Buckets are told from their totals, so that only a few rows are
    sorted. Groups with fewer than ``at_least`` peers are left out."""
    b = counts.withColumn("_bucket", bucket)
    over_buckets = Window.partitionBy(*group).orderBy("_bucket")
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    totals = (
        b.groupBy(*group, "_bucket").agg(F.sum("n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(over_buckets.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("_n").over(Window.partitionBy(*group)))
        .filter((F.col("total") >= at_least) & (F.col("_upto") >= lower) & (F.col("_upto") - F.col("_n") < upper))
        .select(
            *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"),
            (F.col("_upto") - F.col("_n")).alias("_before"), "total",
        )
    )
    match = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(totals, [*match, F.col("_bucket") == F.col("_b")])
        .withColumn("below", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .drop("_bucket", "_b", "_before", *[f"_g_{g}" for g in group])
    )


def midrank(below: Column, equal: Column, total: Column) -> Column:
    """Percentile with ties counted half; 50 against nobody."""
    return F.when(
        total > 0, F.lit(100.0) * (below + equal / F.lit(2.0)) / total
    ).otherwise(F.lit(50.0))


def medians(ranked: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Exact interpolated median and count per group from running counts."""
    upto = F.col("below") + F.col("n")
    lower = F.floor((F.col("total") + 1) / 2)
    upper = F.floor((F.col("total") + 2) / 2)
    has = F.col("n") > 0
    return (
        ranked.groupBy(*group)
        .agg(
            F.max("total").alias("n"),
            F.min(F.when(has & (upto >= lower), F.col(value))).alias("_lo"),
            F.min(F.when(has & (upto >= upper), F.col(value))).alias("_hi"),
        )
        .withColumn("median", (F.col("_lo") + F.col("_hi")) / 2)
        .drop("_lo", "_hi")
    )
