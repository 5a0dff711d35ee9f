"""Market groups and pools that cannot answer are left out before the ranks are taken."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirescope.operators import market


def _postings(spark):
    rows = [(f"p{i}", f"c{i}", f"t{i % 3}", "s", "wide" if i < 9 else f"f{i}", "here", 1000.0 * (20 + i), 1000.0 * (30 + i))
            for i in range(30)]
    return spark.createDataFrame(rows, "posting_key string, company string, title string, source string, job_family string, "
                                       "place string, salary_min double, salary_max double").withColumns(
        {"posted_at": F.lit("2001-11-01").cast("timestamp"), "also_on": F.array().cast("array<string>")})


def test_groups_without_support_are_not_ranked(spark, monkeypatch):
    """Only postings of groups that can answer are ranked."""
    ranked = []
    real = market.factor_ranks
    monkeypatch.setattr(market, "factor_ranks", lambda c, p: ranked.append(p.count()) or real(c, p))
    p = _postings(spark)
    out = market.assess(p, p, "2001-12-01 00:00:00").collect()
    assert ranked == [9] and {r.job_family for r in out} == {"wide"} and len(out) == 9


def test_medians_read_the_middle_buckets_alone(spark, monkeypatch):
    """Pools too small to answer, and figures far from the middle, are not sorted."""
    seen = []
    real = market.medians
    monkeypatch.setattr(market, "medians", lambda r, *a: seen.append(r.count()) or real(r, *a))
    p = market.with_market_columns(_postings(spark), "2001-12-01 00:00:00")
    pools = {(r.any_family, r.any_place, r.job_family, r.place): (r.n_low, r.median_low, r.n_high, r.median_high)
             for r in market.pooled_bands(p, market.MIN_PEERS).collect()}
    assert seen[0] <= 12
    assert pools == {(0, 0, "wide", "here"): (9, 24000.0, 9, 34000.0), (0, 1, "wide", None): (9, 24000.0, 9, 34000.0),
                     (1, 0, None, "here"): (30, 34500.0, 30, 44500.0), (1, 1, None, None): (30, 34500.0, 30, 44500.0)}
    assert market.pooled_bands(p).count() == 1 + 1 + 22 * 2
