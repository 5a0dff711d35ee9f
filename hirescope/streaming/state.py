"""The stateful behaviours as streams.

Nothing here windows events: the state is per posting or per follow-up, and
expiry counts from the first sighting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, IntegerType, StringType, StructField, StructType, TimestampType,
)

from ..operators.applications import follow_ups_due
from ..operators.history import (
    GHOST_DAYS, GHOST_TIMES, SEEN_RETENTION_DAYS, first_copies, fold_sightings, merge_copies, merge_seen, prune_seen,
)


def _fields(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


SEEN_OUT = _fields(
    ("uid", StringType()), ("first_seen", TimestampType()), ("last_seen", TimestampType()),
    ("times_seen", IntegerType()), ("score", IntegerType()), ("posted_at", TimestampType()),
    ("is_new", BooleanType()), ("ghost", BooleanType()),
)
#: A bucket's postings (a plus and the uid, a minus for none), their scores, and the runs of all
#: of them: how many each has, and 64-bit microseconds, a posting's in ascending order.
_STATE = _fields(
    ("uids", ArrayType(StringType())), ("scores", ArrayType(IntegerType())),
    ("times", ArrayType(IntegerType())), ("runs", BinaryType()),
)
#: Buckets that postings are dealt to; a task reads and writes the memory of a bucket at once.
BUCKETS = 1024


_DAY = 86_400_000_000


def _expiry(us: int) -> int:
    """When a posting first seen so is forgotten, in milliseconds."""
    return (int(us) + SEEN_RETENTION_DAYS * _DAY) // 1000


class SeenProcessor(StatefulProcessor):
    """The memory of a bucket of postings. A run's copies count once; a post date
    after the first sighting is clamped to it; a posting is forgotten 120 days
    after it was FIRST seen, so a long-running one comes back as new. Runs that come
    so late that they were forgotten before the known ones began give a row of their own.
    Sightings without a run are of no use to it. The bucket's timer is its earliest posting's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _known(self) -> tuple[pd.DataFrame, pd.Series]:
        """uid and run of every sighting remembered, and the score by uid."""
        uids, scores, times, runs = self.seen.get() if self.seen.exists() else ([], [], [], b"")
        names = np.array(uids, dtype=object)
        held = pd.DataFrame({"uid": np.repeat(names, np.array(times, np.int64)), "run": np.frombuffer(runs, np.int64)})
        return held, pd.Series(scores, index=pd.Index(names, dtype=object), dtype="Int64")

    def _remember(self, held: pd.DataFrame, score: pd.Series, before: int | None) -> None:
        """Store the memory; ``before`` is the first run that the bucket's timer stands for."""
        first = None if held.empty else int(held["run"].min())
        if before is not None and before != first:
            self.handle.deleteTimer(_expiry(before))
        if first is None:
            self.seen.clear()
            return
        held = held.sort_values(["uid", "run"])
        times = held.groupby("uid", sort=True).size()
        scores = [None if pd.isna(x) else int(x) for x in score.reindex(times.index)]
        self.seen.update((times.index.tolist(), scores, times.tolist(), held["run"].to_numpy(np.int64).tobytes()))
        if before != first:
            self.handle.registerTimer(_expiry(first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).dropna(subset=["run_ts"]).sort_values("run_ts", kind="stable")
        batch["uid"] = ("+" + batch["uid"].astype("object")).where(batch["uid"].notna(), "-")
        batch["run"] = batch["run_ts"].astype("datetime64[us]").astype(np.int64)
        held, score = self._known()
        before = None if held.empty else int(held["run"].min())
        began = batch["uid"].map(held.groupby("uid")["run"].min())
        old = (batch["run"] <= began - SEEN_RETENTION_DAYS * _DAY).to_numpy(bool)
        if old.any():
            yield self._rows(batch[old], held.iloc[:0], score.iloc[:0])[0]
            batch = batch[~old]
        if batch.empty:
            return
        out, runs, scores = self._rows(batch, held[held["uid"].isin(batch["uid"])], score)
        held = pd.concat([held, runs]).drop_duplicates()
        self._remember(held, scores.combine_first(score), before)
        yield out

    @staticmethod
    def _rows(batch: pd.DataFrame, held: pd.DataFrame, score: pd.Series) -> tuple[pd.DataFrame, pd.DataFrame, pd.Series]:
        """A row for each posting of a batch, its runs and its score; ``held`` are the runs it had."""
        # A run that comes late, or again, counts once; the score is the latest run's.
        best = batch.assign(score=batch["score"].astype("Int64")).groupby(["uid", "run"], sort=True)["score"].max().reset_index()
        newest = best.drop_duplicates("uid", keep="last").set_index("uid")
        last = held.groupby("uid")["run"].max().reindex(newest.index)
        was = score.reindex(newest.index)
        newer = (last.isna() | (newest["run"] > last)).to_numpy(bool)
        same = (newest["run"] == last).to_numpy(bool)
        top = pd.concat([newest["score"], was], axis=1).max(axis=1).astype("Int64")
        scores = newest["score"].where(newer, top.where(same, was))
        runs = pd.concat([held, best[["uid", "run"]]]).drop_duplicates()
        fold = runs.groupby("uid")["run"].agg(["min", "max", "size"]).reindex(newest.index)
        # A missing date stays missing.
        posted = batch.dropna(subset=["posted_at"]).groupby("uid")["posted_at"].last().reindex(newest.index).astype("datetime64[us]")
        first, final = (fold[c].astype("datetime64[us]") for c in ("min", "max"))
        ghost = ((fold["max"] - fold["min"]) // _DAY >= GHOST_DAYS) & (fold["size"] >= GHOST_TIMES)
        return pd.DataFrame({
            "uid": [None if u == "-" else u[1:] for u in newest.index], "first_seen": first.to_numpy(), "last_seen": final.to_numpy(),
            "times_seen": fold["size"].to_numpy(np.int32), "score": scores.astype("Int32").array,
            "posted_at": posted.where(~(posted > first), first).to_numpy(), "is_new": last.isna().to_numpy(bool), "ghost": ghost.to_numpy(bool),
        }), runs, scores

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, score = self._known()
        if held.empty:
            return iter([])
        first = held.groupby("uid")["run"].transform("min")
        expiry = (first + SEEN_RETENTION_DAYS * _DAY) // 1000
        gone = (expiry <= expiredTimerInfo.getExpiryTimeInMs()) | (expiry < timerValues.getCurrentWatermarkInMs())
        # The timer that fired is taken off by Spark.
        left = held[~gone]
        if left.empty:
            self.seen.clear()
        else:
            self._remember(left, score, None)
        return iter([])

    def close(self) -> None:
        pass


def seen_stream(sightings: DataFrame, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Sightings (uid, run_ts, posted_at, score) to one row per posting and
    batch. Needs the RocksDB state store. ``late`` only says when postings are
    forgotten: the watermark is on a column that the processor doesn't get, so no
    sighting is dropped for coming late. Postings are dealt to ``buckets`` by their uid, as
    each call of Python and each reading of the state takes longer than its rows do; a bucket should
    hold some thousands of postings at most, and their number stays what a checkpoint began with."""
    return (
        sightings.select("uid", "run_ts", "posted_at", "score", F.col("run_ts").alias("_run"))
        .withWatermark("_run", late)
        .select("uid", "run_ts", "posted_at", "score", F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("_bucket"))
        .groupBy("_bucket")
        .transformWithStateInPandas(
            statefulProcessor=SeenProcessor(), outputStructType=SEEN_OUT, outputMode="Update",
            timeMode="EventTime",
        )
    )


def seen_batches(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], as_of=None):
    """X01, simple form: a foreachBatch function that merges each batch into
    the stored seen table. ``read`` gives the current table (or None) and
    ``write`` stores the next version, named by batch so a replay overwrites
    itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = fold_sightings(batch)
        state = read()
        merged = fresh if state is None else merge_seen(state, fresh)
        write(prune_seen(merged, as_of) if as_of is not None else merged, batch_id)

    return step


def exact_copies_dropped(postings: DataFrame, at: str = "run_ts", late: str = "2 days") -> DataFrame:
    """Copies of one posting inside the watermark are passed on once."""
    return postings.withWatermark(at, late).dropDuplicatesWithinWatermark(["dedupe_key"])


def collapse_batches(read: Callable[[int], DataFrame | None], write: Callable[[DataFrame, int], None]):
    """A foreachBatch function that merges each batch's first copies into the
    stored ones; ``history.settled`` makes the source-priority choice from them.
    ``read`` gives the table as it stood before a batch (or None), so that a replay
    counts no copy twice, and ``write`` stores the next version, named by batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = first_copies(batch)
        state = read(batch_id)
        write(fresh if state is None else merge_copies(state, fresh), batch_id)

    return step


def follow_up_stream(log: DataFrame, as_of, at: str | None = None, late: str = "1 day") -> DataFrame:
    """An overdue follow-up once per due date: a moved date fires again."""
    due = follow_ups_due(log, as_of)
    if at is None:
        return due.dropDuplicates(["id", "follow_up_due"])
    return due.withWatermark(at, late).dropDuplicates(["id", "follow_up_due"])


def changed_since(table: DataFrame, stamp_col: str, since) -> DataFrame:
    """One row: has the table changed since a stamp, and its newest stamp."""
    newest = table.agg(F.max(stamp_col).alias("newest"))
    return newest.select("newest", (F.col("newest") > F.lit(str(since)).cast("timestamp")).alias("changed"))
