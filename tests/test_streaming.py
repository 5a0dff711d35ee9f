"""Streams over several files: state carries between micro-batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hirescope.operators import history
from hirescope.streaming import state

FIELDS = "uid string, run_ts timestamp, posted_at timestamp, score int, arrival long, title string, company string"


def land(spark, path, n, rows):
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(f"{path}/f{n}")


def row(uid, day, posted=None, score=50, arrival=0):
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    return (uid, at(day), None if posted is None else at(posted), score, arrival, "t", "c")


def source(spark, path):
    return spark.readStream.schema(FIELDS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, tmp_path, mode="update"):
    out: list = []
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True)
         .foreachBatch(lambda b, i: out.append(b.collect())).start())
    q.awaitTermination()
    return [r for batch in out for r in batch]


def test_seen_stream_forgets_by_first_sighting(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, 1, [row("a", 0, 5), row("a", 0, 5, arrival=1), row("b", 0)])
    land(spark, path, 2, [row("a", 60)])
    land(spark, path, 3, [row("b", 130)])
    land(spark, path, 4, [row("c", 131)])
    land(spark, path, 5, [row("a", 132)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = run(spark, state.seen_stream(source(spark, path), "0 seconds"), tmp_path)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    a = [r for r in rows if r["uid"] == "a"]
    assert [r["times_seen"] for r in a[:2]] == [1, 2] and a[0]["is_new"] and not a[1]["is_new"]
    # A date after the first sighting is clamped; an undated posting stays undated.
    assert a[0]["posted_at"] == dt.datetime(2026, 1, 1)
    assert next(r for r in rows if r["uid"] == "b")["posted_at"] is None
    # 132 days after its first sighting, "a" comes back as new.
    assert a[-1]["is_new"] and a[-1]["times_seen"] == 1


def test_seen_batches_merge(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, 1, [row("a", 0), row("b", 0)])
    land(spark, path, 2, [row("a", 2, score=70)])
    held: list = []
    step = state.seen_batches(lambda: held[-1] if held else None,
                              lambda df, i: held.append(spark.createDataFrame(df.collect(), df.schema)))
    q = (source(spark, path).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(step).start())
    q.awaitTermination()
    got = {r["uid"]: r for r in held[-1].collect()}
    assert got["a"]["times_seen"] == 2 and got["a"]["score"] == 70 and got["b"]["times_seen"] == 1


def test_copies_dropped_once(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, 1, [row("a", 0), row("a", 0, arrival=1)])
    land(spark, path, 2, [row("a", 1), row("b", 1)])
    df = state.exact_copies_dropped(source(spark, path).withColumn("dedupe_key", F.col("uid")), "run_ts", "10 days")
    rows = run(spark, df, tmp_path, "append")
    assert sorted(r["uid"] for r in rows) == ["a", "b"]


def test_seen_stream_counts_late_runs(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, 1, [row("a", 50), row("b", 200)])
    land(spark, path, 2, [row("b", 201)])
    land(spark, path, 3, [row("c", 100), row("b", 190), row("b", 3)])
    land(spark, path, 4, [row("c", 101), row("b", 202)])
    land(spark, path, 5, [row("b", 311)])
    land(spark, path, 6, [row("d", 312)])
    land(spark, path, 7, [row("b", 313)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = run(spark, state.seen_stream(source(spark, path), "0 seconds"), tmp_path)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    c = [r for r in rows if r["uid"] == "c"]
    assert [(r["first_seen"], r["times_seen"]) for r in c] == [(at(100), 1), (at(100), 2)]
    b = [(r["first_seen"], r["times_seen"], r["is_new"]) for r in rows if r["uid"] == "b"]
    # Day 3 belongs to a time before the known one; the late day 190 is its beginning,
    # and from there it is forgotten after 120 days.
    assert b[:2] == [(at(200), 1, True), (at(200), 2, False)]
    assert sorted(b[2:4]) == [(at(3), 1, True), (at(190), 3, False)]
    assert b[4] == (at(190), 4, False) and b[-1] == (at(313), 1, True)


def test_collapse_batches_merge(spark, tmp_path):
    """A posting met in several batches keeps one row, the best source's, as in one batch."""
    path = str(tmp_path / "in")
    fields = FIELDS + ", source string, description string, partial boolean, dedupe_key string"
    rows = [(*row(k, 1, arrival=i), s, d, False, k) for i, (k, s, d) in enumerate([
        ("a", "adzuna", "long body of a"), ("b", "workday", ""), ("a", "workday", "short"), ("a", "hackernews", ""),
        ("b", "adzuna", ""), ("c", "adzuna", "")])]
    for n, part in enumerate((rows[3:5], rows[:1], rows[5:], rows[1:3])):
        spark.createDataFrame(part, fields).coalesce(1).write.parquet(f"{path}/f{n}")
    held: dict = {}

    def read(batch_id):
        before = [i for i in held if i < batch_id]
        return held[max(before)] if before else None

    def write(df, batch_id):
        held[batch_id] = spark.createDataFrame(df.collect(), df.schema)

    step = state.collapse_batches(read, write)

    def twice(batch, batch_id):
        step(batch, batch_id)
        step(batch, batch_id)

    q = (spark.readStream.schema(fields).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)
         .writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(twice).start())
    q.awaitTermination()
    assert len(held) == 4
    got = sorted(history.settled(held[max(held)]).collect(), key=lambda r: r["dedupe_key"])
    want = sorted(history.collapse(spark.createDataFrame(rows, fields)).collect(), key=lambda r: r["dedupe_key"])
    assert got == want and [(r["source"], r["collapsed"]) for r in got] == [("workday", 2), ("workday", 1), ("adzuna", 0)]
    assert got[0]["description"] == "long body of a"


def test_seen_stream_many_postings_of_a_bucket(spark, tmp_path):
    """Postings are handled together, so that calls and readings of the state don't grow with them."""
    path, calls = str(tmp_path / "in"), spark.sparkContext.accumulator(0)
    uids = [None, "", "+", "-", *map(str, range(400))]
    land(spark, path, 1, [row(u, d, d + 1, score=i % 90 + d) for i, u in enumerate(uids) for d in (3, 1)] + [row("0", 3, score=None), row("x", 200)])
    land(spark, path, 2, [row(u, d, score=7) for u in uids[::2] for d in (3, 2)])
    land(spark, path, 3, [row(u, 202) for u in uids])

    class Counted(state.SeenProcessor):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            return super().handleInputRows(key, rows, timerValues)

    kept, state.SeenProcessor = state.SeenProcessor, Counted
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = run(spark, state.seen_stream(source(spark, path), "0 seconds", buckets=4), tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        state.SeenProcessor = kept
    assert calls.value <= 12
    at = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    found: dict = {}
    for r in rows:
        found.setdefault(r["uid"], []).append(tuple(r)[1:])
    for i, u in enumerate(uids):
        first, score = (at(1), at(3), 2, i % 90 + 3, at(1), True, False), max(i % 90 + 3, 7)
        second = [(at(1), at(3), 3, score, None, False, False)] if i % 2 == 0 else []
        assert found[u] == [first, *second, (at(202), at(202), 1, 50, None, True, False)]
