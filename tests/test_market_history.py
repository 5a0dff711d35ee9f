"""Market context and history on small literal tables, against plain Python."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from hirescope.functions import keys
from hirescope.operators import history, market

AS_OF = "2026-06-01 00:00:00"


def peers(spark, n, pay=lambda i: 50_000.0 + 1_000 * i):
    rows = [(f"k{i}", f"Co {i}", f"Data Analyst {'abc'[i % 3]}", "analyst", "OH", "lever", pay(i), pay(i),
             dt.datetime(2026, 5, 1) + dt.timedelta(days=i % 20), ["x"] * (i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "posting_key string, company string, title string, job_family string, place string, "
                                       "source string, salary_min double, salary_max double, posted_at timestamp, also_on array<string>")


def midrank(values, v):
    return 100 * (sum(x < v for x in values) + sum(x == v for x in values) / 2) / len(values)


def test_assess_matches_plain_python(spark):
    p = peers(spark, 40)
    got = {r["posting_key"]: r for r in market.assess(p, p, AS_OF).collect()}
    pays = [50_000.0 + 1_000 * i for i in range(40)]
    ages = [(dt.datetime(2026, 6, 1) - dt.datetime(2026, 5, 1)).days - i % 20 for i in range(40)]
    roles = {"a": 14, "b": 13, "c": 13}
    for i in (0, 7, 39):
        pay, crowd = midrank(pays, pays[i]), 100 - midrank(list(roles.values()), roles["abc"[i % 3]])
        reach = 100 - midrank([1 + j % 2 for j in range(40)], 1 + i % 2)
        fresh = 100 - midrank(ages, ages[i])
        want = 0.4 * pay + 0.25 * crowd + 0.15 * reach + 0.2 * fresh
        r = got[f"k{i}"]
        assert r["delta"] == round(want - 50) and r["pay_percentile"] == round(pay)
        assert r["confident"] and r["pay_share"] == 40


def test_thin_group_and_missing_factors(spark):
    assert market.assess(peers(spark, 3), peers(spark, 3), AS_OF).count() == 0
    same_reach = peers(spark, 10).withColumn("also_on", F.array().cast("array<string>"))
    r = market.assess(same_reach, same_reach, AS_OF).first()
    assert r["reach_percentile"] is None and r["pay_share"] == round(100 * 0.4 / 0.85)


def test_candidate_outside_the_peers(spark):
    high = peers(spark, 1, lambda i: 900_000.0).withColumn("posting_key", F.lit("new"))
    r = market.assess(high, peers(spark, 20), AS_OF).first()
    assert r["pay_percentile"] == 100


def test_estimate_widens(spark):
    base = peers(spark, 20)
    ask = base.limit(1).withColumns({"salary_min": F.lit(None).cast("double"), "salary_max": F.lit(None).cast("double")})
    est = lambda d: market.estimate_salary(d, base, AS_OF).first()
    assert est(ask)["basis"] == "cell" and est(ask)["est_min"] == 59_500
    assert est(ask.withColumn("place", F.lit("VA")))["basis"] == "family"
    assert est(ask.withColumn("job_family", F.lit("z")))["basis"] == "place"
    assert est(ask.withColumns({"place": F.lit("VA"), "job_family": F.lit("z")}))["basis"] == "all"


def test_collapse_against_a_loop(spark):
    """Random copies: the chain rule as one pass in arrival order."""
    rng = random.Random(5)
    sources = ["workday", "adzuna", "remoteok", "usajobs", "hackernews", "mystery"]
    rows = [(i, f"Co{rng.randrange(20)}", "Analyst", rng.choice(sources), "x" * rng.randrange(9), rng.random() < 0.4,
             dt.datetime(2026, 1, 1 + rng.randrange(28)) if rng.random() < 0.5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "arrival long, company string, title string, source string, description string, partial boolean, posted_at timestamp")
    best, also = {}, {}
    rank = history.SOURCE_PRIORITY
    for arrival, company, _, source, body, partial, at in rows:
        also.setdefault(company, set()).add(source)
        now = dict(source=source, body=body, partial=partial, at=at)
        old = best.get(company)
        if old is None:
            best[company] = now
        elif rank.get(source, 9) < rank.get(old["source"], 9):
            if len(old["body"]) > len(body):
                now["body"], now["partial"] = old["body"], old["partial"]
            now["at"] = at or old["at"]
            best[company] = now
    got = {r["company"]: r for r in history.collapse(df).collect()}
    assert got.keys() == best.keys()
    for c, w in best.items():
        r = got[c]
        assert (r["source"], r["description"], r["partial"], r["posted_at"]) == (w["source"], w["body"], w["partial"], w["at"])
        assert r["also_on"] == sorted(also[c] - {w["source"]})


def farm(spark, n, flagged, known=()):
    rows = [(f"u{i}", i, f"Shop {i}", "Power BI Developer" + (" (Hybrid)" if i % 2 else " | W2/1099"), "adzuna", 50 + i,
             "body", ["staffing-agency"] if i < flagged else [], []) for i in range(n)]
    return spark.createDataFrame(rows, "uid string, arrival long, company string, title string, source string, score int, "
                                       "description string, flags array<string>, reasons array<string>")


def test_repost_farm(spark):
    none = spark.createDataFrame([("Nobody",)], "name string")
    out = history.collapse_reposts(farm(spark, 4, 1), none).collect()
    assert [r["uid"] for r in out] == ["u3"]
    assert "reposted by 4 firms" in out[0]["flags"] and "staffing-agency" in out[0]["flags"]
    # Three companies, or nobody flagged, is no farm.
    assert history.collapse_reposts(farm(spark, 3, 3), none).count() == 3
    assert history.collapse_reposts(farm(spark, 6, 0), none).count() == 6
    # A watched company is never dropped.
    watched = spark.createDataFrame([("Shop 0",)], "name string")
    assert sorted(r["uid"] for r in history.collapse_reposts(farm(spark, 5, 2), watched).collect()) == ["u0", "u4"]


def test_settle_posted_keeps_undated(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2026, 5, 9)), ("b", None), ("c", dt.datetime(2026, 5, 1))], "uid string, posted_at timestamp")
    seen = spark.createDataFrame([(u, dt.datetime(2026, 5, 5)) for u in "abc"], "uid string, first_seen timestamp")
    got = {r["uid"]: r["posted_at"] for r in history.settle_posted(rows, seen).collect()}
    assert got == {"a": dt.datetime(2026, 5, 5), "b": None, "c": dt.datetime(2026, 5, 1)}


def test_repost_title_keys(spark):
    rows = [("Power BI Developer (Hybrid)", "power bi developer"), ("SCC - Power BI Developer", "power bi developer"),
            ("Power BI Developer | W2/1099 | Applicant Must Be Current VA Resident", "power bi developer w2 1099 applicant must be current va resident"),
            ("Business Analyst (Federal Grants & eRA Systems)", "business analyst federal grants era systems"),
            ("Data Analyst in Richmond, VA", "data analyst"), ("Data Analyst 00151", "data analyst")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.withColumn("got", keys.repost_title("t", ("richmond", "va"))).collect():
        if "W2" in r["t"]:
            assert r["got"] == "power bi developer"
        else:
            assert r["got"] == r["want"], r


def test_merge_seen_in_any_order(spark):
    """The same runs split over batches, out of order, fold to one table."""
    from datetime import datetime

    from hirescope.operators import history

    rows = [("a", datetime(2026, 1, d), 10 * d + k, 100 * d + k, f"t{d}{k}") for d in (3, 1, 2) for k in (0, 1)]
    rows += [("b", datetime(2026, 1, 2), 5, 7, "b")]
    schema = "uid string, run_ts timestamp, score int, arrival long, title string"
    whole = history.fold_sightings(spark.createDataFrame(rows, schema))
    for order in ([0, 3, 1, 2, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0]):
        state = None
        for i in order:
            fold = history.fold_sightings(spark.createDataFrame([rows[i]], schema))
            state = fold if state is None else history.merge_seen(state, fold)
        names = ["uid", "first_seen", "last_seen", "times_seen", "score", "title"]
        assert sorted(state.select(names).collect()) == sorted(whole.select(names).collect())


def test_long_bodies_stay_whole(spark):
    body = "x" * 13_000 + " remote"
    at = "2026-01-02 00:00:00"
    filled = spark.createDataFrame([("u", body, False)], "url string, description string, partial boolean")
    store = spark.createDataFrame([], "url string, body string, at timestamp")
    assert history.remember_bodies(store, filled, at).first()["body"] == body
    fields = "uid string, title string, score int, description string, first_seen timestamp, last_seen timestamp"
    run = spark.createDataFrame([("a", "t", 90, body, None, None)], fields)
    assert history.upsert_candidates(run, run.limit(0), at).first()["description"] == body
    assert history.upsert_candidates(run, run.limit(0), at, max_body=100).first()["description"] == "x" * 100
