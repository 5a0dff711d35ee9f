"""The seen table laid out by month of the first sighting and hash of the id.

A batch reads and writes only the partitions that its postings live in. Which those are
follows from the hashes of its ids, and from the months in which a posting that is still
remembered can have begun; both are partition filters. The partitions that change are
then written anew beside the others (dynamic partition overwrite). Forgetting a month
removes its folders and rewrites nothing.

A merge takes a posting's runs as a set, so a batch that comes again, late or after half
of its partitions were written, leads to the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import SEEN_LABELS, SEEN_RETENTION_DAYS, fold_sightings, prune_seen
from ..operators.market import stamp
from ..session import written

#: Hash partitions of a month: what the driver holds is at most a list of months times these.
BUCKETS = 16
PARTITION = ("month", "bucket")


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumns({
        "month": month_of(F.col("first_seen")), "bucket": F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int")})


def _folder(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _folder(spark, path)
    return files.exists(there)


def _remove(spark: SparkSession, path: str) -> None:
    files, there = _folder(spark, path)
    files.delete(there, True)


def merged(*folds: DataFrame) -> DataFrame:
    """Any number of folds of the same postings as one: a posting's rows are few, one for each fold."""
    labels = [c for c in SEEN_LABELS if all(c in f.columns for f in folds)]
    kept = ["uid", "first_seen", "last_seen", "score", "runs", "first_arrival", *labels]
    rows = folds[0].select(*kept)
    for fold in folds[1:]:
        rows = rows.unionByName(fold.select(*kept))
    first = F.min(F.struct("first_seen", "first_arrival", *labels)).alias("first")
    runs = F.sort_array(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs")
    one = rows.groupBy("uid").agg(first, F.max(F.struct("last_seen", "score")).alias("last"), runs)
    return one.select(
        "uid", "first.first_seen", "last.last_seen", F.size("runs").cast("long").alias("times_seen"), "last.score",
        *[f"first.{c}" for c in labels], "runs", "first.first_arrival")


def read_seen(spark: SparkSession, path: str, schema: T.StructType, as_of=None, days: int = SEEN_RETENTION_DAYS) -> DataFrame:
    """The table; with ``as_of``, what is remembered then, from the months that can hold it."""
    rows = spark.read.schema(schema).parquet(path)
    if as_of is None:
        return rows
    since = month_of(stamp(as_of) - F.make_dt_interval(F.lit(days)))
    return prune_seen(rows.filter(F.col("month") >= since), as_of, days)


def _among(pairs: Iterable[tuple[str, int]]) -> Column:
    """A partition filter for these months and buckets."""
    by_month: dict[str, list[int]] = {}
    for month, bucket in pairs:
        by_month.setdefault(month, []).append(bucket)
    out = F.lit(False)
    for month, buckets in sorted(by_month.items()):
        out = out | ((F.col("month") == month) & F.col("bucket").isin(sorted(buckets)))
    return out


def touched(state: DataFrame, fresh: DataFrame, days: int | None) -> tuple[DataFrame, datetime | None]:
    """The part of the table where a fold's postings may already stand: by their hashes, and
    with ``days`` by the months from which a posting is still remembered at the fold's first run."""
    bounds = fresh.agg(F.collect_set("bucket").alias("buckets"), F.min("first_seen").alias("first")).first()
    rows = state.filter(F.col("bucket").isin(sorted(bounds.buckets)))
    if days is not None and bounds.first is not None:
        rows = rows.filter(F.col("month") >= month_of(F.lit(bounds.first) - F.make_dt_interval(F.lit(days))))
    return rows, bounds.first


def merge_batch(path: str, sightings: DataFrame, buckets: int = BUCKETS, days: int | None = SEEN_RETENTION_DAYS) -> list[tuple[str, int]]:
    """Merge sightings into the table at ``path``; the partitions written."""
    spark = sightings.sparkSession
    fresh = written(_placed(fold_sightings(sightings), buckets), "fold")
    if not exists(spark, path):
        spark.createDataFrame([], fresh.schema).write.partitionBy(*PARTITION).parquet(path)
    state, first = touched(read_seen(spark, path, fresh.schema), fresh, days)
    if first is None:
        return []
    homes = state.join(fresh.select("uid"), "uid", "left_semi").select(*PARTITION).union(fresh.select(*PARTITION))
    pairs = [tuple(r) for r in homes.distinct().collect()]
    # A late run may move a posting to an earlier month: its old home is among the pairs.
    rows = written(_placed(merged(state.filter(_among(pairs)), fresh), buckets).repartition(*PARTITION), "merged")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path))
    filled = {tuple(r) for r in rows.select(*PARTITION).distinct().collect()}
    for month, bucket in set(pairs) - filled:
        _remove(spark, f"{path}/month={month}/bucket={bucket}")
    return sorted(filled)


def merge_batches(path: str, buckets: int = BUCKETS, days: int | None = SEEN_RETENTION_DAYS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over sightings."""
    def step(batch: DataFrame, batch_id: int) -> None:
        merge_batch(path, batch, buckets, days)

    return step


def forget(spark: SparkSession, path: str, as_of, days: int = SEEN_RETENTION_DAYS) -> list[str]:
    """Remove the months that ended before anything is remembered; no row is read.

    The month of the bound stays whole; ``read_seen`` leaves its older rows out.
    """
    since = spark.range(1).select(month_of(stamp(as_of) - F.make_dt_interval(F.lit(days)))).first()[0]
    files, there = _folder(spark, path)
    months = [s.getPath().getName().removeprefix("month=") for s in files.listStatus(there) if s.isDirectory()]
    gone = sorted(m for m in months if "0000" <= m < since)
    for month in gone:
        _remove(spark, f"{path}/month={month}")
    return gone
