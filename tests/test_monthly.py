"""The seen table by month and hash: what a batch writes, late runs, replays, forgetting."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from hirescope.operators.history import fold_sightings
from hirescope.streaming import monthly

FIELDS = "uid string, run_ts timestamp, score int, arrival long, title string, company string"


def sightings(spark, *rows):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    return spark.createDataFrame([(u, at(d), s, i, f"t{d}", "c") for i, (u, d, s) in enumerate(rows)], FIELDS)


def files(path):
    return {str(p.parent): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def table(spark, path):
    return {r.uid: r for r in spark.read.parquet(path).collect()}


def test_a_batch_writes_only_the_partitions_it_touches(spark, tmp_path):
    path = str(tmp_path / "seen")
    monthly.merge_batch(path, sightings(spark, *[(f"u{i}", 10 * i, i) for i in range(40)]), buckets=4)
    before = files(path)
    assert len(before) > 20
    wrote = monthly.merge_batch(path, sightings(spark, ("u39", 395, 50), ("new", 396, 1)), buckets=4)
    after = files(path)
    changed = {p for p in after if after[p] != before.get(p)}
    assert changed == {f"{path}/month={m}/bucket={b}" for m, b in wrote} and 1 <= len(wrote) <= 2
    got = table(spark, path)
    assert len(got) == 41 and got["u39"].times_seen == 2 and got["u39"].score == 50 and got["u39"].title == "t390"


def test_the_plan_prunes_by_month_and_hash(spark, tmp_path):
    path = str(tmp_path / "seen")
    monthly.merge_batch(path, sightings(spark, *[(f"u{i}", 10 * i, i) for i in range(40)]), buckets=4)
    schema = spark.read.parquet(path).schema
    fresh = monthly._placed(fold_sightings(sightings(spark, ("u39", 395, 1))), 4)
    state, _ = monthly.touched(monthly.read_seen(spark, path, schema), fresh, 120)
    plan = state._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.splitlines() if "PartitionFilters" in x).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "month" in filters and "bucket" in filters
    read = {tuple(r) for r in state.select("month", "bucket").distinct().collect()}
    assert read and all(m >= "2024-10" for m, _ in read) and len({b for _, b in read}) == 1


def test_late_repeated_and_shuffled_batches_end_alike(spark, tmp_path):
    rows = [(f"u{i % 7}", (i * 37) % 110, i) for i in range(60)]
    parts = [rows[i::4] for i in range(4)]
    for n, order in enumerate(([0, 1, 2, 3], [3, 1, 3, 0, 2, 2])):
        path = str(tmp_path / f"seen{n}")
        for i in order:
            monthly.merge_batch(path, sightings(spark, *parts[i]), buckets=3, days=None)
        got = table(spark, path)
        assert spark.read.parquet(path).count() == len(got) == 7
        for u, r in got.items():
            days = sorted({d for v, d, _ in rows if v == u})
            at = [dt.datetime(2024, 1, 1) + dt.timedelta(days=d) for d in days]
            assert (r.first_seen, r.last_seen, r.times_seen, r.month) == (at[0], at[-1], len(days), f"{at[0]:%Y-%m}")


def test_a_posting_that_moves_leaves_no_copy_behind(spark, tmp_path):
    path = str(tmp_path / "seen")
    monthly.merge_batch(path, sightings(spark, ("a", 80, 1)), buckets=2)
    monthly.merge_batch(path, sightings(spark, ("a", 5, 1)), buckets=2)
    [row] = spark.read.parquet(path).collect()
    assert row.month == "2024-01" and row.times_seen == 2 and len(files(path)) == 1


def test_forgetting_removes_folders_and_rewrites_nothing(spark, tmp_path):
    path = str(tmp_path / "seen")
    monthly.merge_batch(path, sightings(spark, *[(f"u{i}", 10 * i, i) for i in range(20)]), buckets=2)
    before, schema = files(path), spark.read.parquet(path).schema
    gone = monthly.forget(spark, path, "2024-07-10 00:00:00", 90)
    after = files(path)
    assert gone == ["2024-01", "2024-02", "2024-03"] and all(before[p] == t for p, t in after.items())
    left = monthly.read_seen(spark, path, schema, "2024-07-10 00:00:00", 90)
    assert sorted(r.uid for r in left.collect()) == sorted(f"u{i}" for i in range(20) if i >= 11)
    assert "PartitionFilters: [isnotnull(month" in left._jdf.queryExecution().executedPlan().toString()


def test_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert monthly.merge_batch(path, sightings(spark, ("a", 1, 1)).filter(F.lit(False))) == []
    monthly.merge_batch(path, sightings(spark, ("a", 1, 1)))
    assert monthly.merge_batch(path, sightings(spark, ("a", 1, 1)).filter(F.lit(False))) == []
    assert list(table(spark, path)) == ["a"]
