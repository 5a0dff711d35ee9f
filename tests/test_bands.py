"""Pay bands from sketches stored by day."""

import random
from pathlib import Path
from statistics import median

from pyspark.sql import functions as F

from hirescope.operators import bands, market

FIELDS = "day string, job_family string, place string, low double, high double"


def rows(seed, days, n):
    rng = random.Random(seed)
    out = []
    for d in days:
        for _ in range(n):
            low = rng.choice([None, float(rng.randrange(40_000, 90_000))])
            out.append((d, rng.choice("ab"), rng.choice("xyz"), low, None if low is None else low + rng.randrange(30_000)))
    return out


def exact(data):
    out = {}
    for families in (0, 1):
        for places in (0, 1):
            keys = {(None if families else f, None if places else p) for _, f, p, _, _ in data}
            for f, p in keys:
                own = [r for r in data if (families or r[1] == f) and (places or r[2] == p)]
                out[families, places, f, p] = tuple(sorted(r[i] for r in own if r[i] is not None) for i in (3, 4))
    return out


def test_merged_days_are_exact_while_they_are_small(spark, tmp_path):
    path = str(tmp_path / "days")
    data = rows(1, ["2024-01-01", "2024-01-02", "2024-01-03"], 40)
    bands.store_days(spark.createDataFrame(data, FIELDS), path)
    got = {(r.any_family, r.any_place, r.job_family, r.place): r for r in bands.sketched_bands(bands.read_days(spark, path)).collect()}
    want = exact(data)
    assert {k for k, v in want.items() if v[0]} == set(got)
    for key, (lows, highs) in want.items():
        if lows:
            assert (got[key].n_low, got[key].n_high) == (len(lows), len(highs))
            # A sketch gives one of its values; a median of an even count lies between two.
            assert lows[(len(lows) - 1) // 2] <= got[key].median_low <= lows[len(lows) // 2]
            assert abs(got[key].median_high - median(highs)) <= highs[len(highs) // 2] - highs[(len(highs) - 1) // 2]


def test_a_day_landed_again_replaces_itself_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "days")
    bands.store_days(spark.createDataFrame(rows(1, ["2024-01-01", "2024-01-02"], 30), FIELDS), path)
    stamps = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    again = rows(2, ["2024-01-02"], 50)
    bands.store_days(spark.createDataFrame(again, FIELDS), path)
    kept = [p for p in stamps if "day=2024-01-01" in str(p)]
    assert kept and all(p.stat().st_mtime_ns == stamps[p] for p in kept)
    days = bands.read_days(spark, path, since="2024-01-02")
    assert "PartitionFilters: [isnotnull(day" in days._jdf.queryExecution().executedPlan().toString()
    n = bands.merged_bands(days).filter("any_family = 1 AND any_place = 1 AND side = 'low'").first().n
    assert n == sum(r[3] is not None for r in again)
    assert bands.merged_bands(bands.read_days(spark, path, until="2024-01-01")).filter("any_family = 1 AND any_place = 1 AND side = 'low'").first().n != n


def test_ranks_are_within_the_bound(spark, tmp_path):
    path = str(tmp_path / "days")
    days = spark.range(30_000).select(
        F.concat(F.lit("2024-02-0"), (F.col("id") % 9 + 1).cast("string")).alias("day"), F.lit("a").alias("job_family"), F.lit("x").alias("place"),
        F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    bands.store_days(days, path, k=100)
    merged = bands.merged_bands(bands.read_days(spark, path), (0.1, 0.5, 0.9))
    assert {c for c in merged.columns if c[0] == "q"} == {"q10", "q50", "q90"}
    error = 2 * bands.rank_error(100)
    for name, at in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
        found = bands.true_ranks(merged, days, name).collect()
        assert len(found) == 4 and all(r.below <= at + error and r.upto >= at - error for r in found)


def test_salaries_are_estimated_from_stored_bands(spark, tmp_path):
    path = str(tmp_path / "days")
    data = [("2024-01-01", "a", "x", 50_000.0 + i, 70_000.0 + i) for i in range(9)]
    bands.store_days(spark.createDataFrame(data, FIELDS), path)
    want = ("posting_key string, company string, title string, source string, job_family string, place string, salary_min double, "
            "salary_max double, posted_at timestamp")
    open_ones = spark.createDataFrame([("k", "c", "t", "s", "a", "x", None, None, None), ("m", "c", "t", "s", "b", "y", None, None, None)], want)
    got = {r.posting_key: r for r in market.estimate_salary(open_ones, open_ones, "2024-01-02 00:00:00", bands.sketched_bands(bands.read_days(spark, path))).collect()}
    assert (got["k"].est_min, got["k"].est_max, got["k"].basis) == (50_004, 70_004, "cell")
    assert got["m"].basis == "all"
