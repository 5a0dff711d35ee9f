"""Registered queries for the market group (A) and its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import bands, history, market
from ..session import scratch, written
from .registry import query
from .views import AS_OF, SIGHTINGS_SQL, applications, sightings

_S = f"WITH s AS ({SIGHTINGS_SQL})"

# The latest sighting per posting with the boards that carried it.
_P = (
    _S
    + """, ranked AS (SELECT *, lower(concat(company, '|', title)) AS posting_key,
    row_number() OVER (PARTITION BY lower(concat(company, '|', title))
        ORDER BY run_ts DESC, arrival DESC) AS rn FROM s),
boards AS (SELECT posting_key, count(DISTINCT source) AS reach FROM ranked GROUP BY posting_key),
p AS (SELECT *, (low / 2 + high / 2) AS pay FROM (
    SELECT r.posting_key, company, title, job_family, brand, place, source, run_ts, posted_at,
    CASE WHEN salary_min < 1000 THEN salary_min * 2080 ELSE salary_min END AS low,
    CASE WHEN salary_max < 1000 THEN salary_max * 2080 ELSE salary_max END AS high,
    salary_min AS raw_low, salary_max AS raw_high, remote, score, b.reach, flag,
    greatest(0e0, epoch_us(TIMESTAMP '2001-12-01 00:00:00' - posted_at) / 86400e6) AS age,
    lower(title) AS role
    FROM ranked r JOIN boards b USING (posting_key) WHERE rn = 1))"""
)


def _peers(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``without`` are columns that nobody reads; only ones from the end on, as the columns
    before them decide between equal sightings."""
    keep = ["run_ts", "arrival", "company", "title", "job_family", "brand", "place", "source",
            "posted_at", "salary_min", "salary_max", "remote", "score", "flag"]
    if without and set(keep[-len(without):]) != set(without):
        raise ValueError("only the last columns may be left out")
    return market.latest_sightings(sightings(spark, sf_dir), keep=keep[:len(keep) - len(without)], sources=True)


@query("A01_latest_sighting", _P + " SELECT posting_key, company, title, source, run_ts, score, reach FROM p")
def a01(spark, sf_dir):
    p = _peers(spark, sf_dir)
    return p.select("posting_key", "company", "title", "source", "run_ts", "score",
                    (F.size("also_on") + 1).alias("reach"))


@query("A02_peer_groups", _P + """ SELECT job_family, place, count(*) AS peers,
    count(DISTINCT lower(company)) AS employers, count(pay) AS n_pay, count(low) AS n_low,
    count(high) AS n_high, count(age) AS n_age, sum(reach) AS reach_sum,
    min(reach) AS reach_min, max(reach) AS reach_max FROM p GROUP BY job_family, place""")
def a02(spark, sf_dir):
    return market.peer_groups(market.with_market_columns(_peers(spark, sf_dir), AS_OF))


@query("A02_role_counts", _P + """ SELECT job_family, place, role, count(*) AS openings FROM p
    GROUP BY job_family, place, role""")
def a02_roles(spark, sf_dir):
    return market.role_counts(market.with_market_columns(_peers(spark, sf_dir), AS_OF))


_BANDS = """ SELECT CAST(grouping(job_family) AS INT) AS any_family,
    CAST(grouping(place) AS INT) AS any_place, job_family, place,
    count(low) AS n_low, count(high) AS n_high, median(low) AS median_low,
    median(high) AS median_high FROM p
    GROUP BY GROUPING SETS ((job_family, place), (job_family), (place), ())"""


@query("A03_pooled_bands", _P + _BANDS)
def a03(spark, sf_dir):
    return market.pooled_bands(market.with_market_columns(_peers(spark, sf_dir), AS_OF))


@query("A03_sketched_bands", _P + """, v AS (SELECT job_family, place, side, amount FROM (SELECT job_family, place, 'low' AS side, low AS amount FROM p UNION ALL SELECT job_family, place, 'high', high FROM p) WHERE amount IS NOT NULL)
    SELECT CAST(grouping(job_family) AS INT) AS any_family, CAST(grouping(place) AS INT) AS any_place, job_family, place, side, count(*) AS n, true AS within FROM v
    GROUP BY GROUPING SETS ((job_family, place, side), (job_family, side), (place, side), (side))""")
def a03_sketched(spark, sf_dir):
    """Sketches stored by day and merged: counts, and whether each median's true rank is
    within twice the published error."""
    p = market.with_market_columns(_peers(spark, sf_dir), AS_OF)
    # A folder for each month: the sketches of a month of this table are as small as a day's would be at size.
    peers = written(p.select(F.date_format("run_ts", "yyyy-MM").alias("day"), *market.GROUP, "low", "high"), "peers")
    path = scratch(spark, "sketches")
    bands.store_days(peers, path)
    merged = bands.merged_bands(bands.read_days(spark, path))
    error = 2 * bands.rank_error()
    ranks = bands.true_ranks(merged, peers)
    return ranks.select("any_family", "any_place", "job_family", "place", "side", "n",
                        ((F.col("below") <= 0.5 + error) & (F.col("upto") >= 0.5 - error)).alias("within"))


@query("A04_midrank", _P + """ SELECT posting_key, 1e2 * ((rank() OVER w - 1)
    + (count(*) OVER (PARTITION BY job_family, place, pay)) / 2e0)
    / count(*) OVER (PARTITION BY job_family, place) AS percentile
    FROM p WHERE pay IS NOT NULL
    WINDOW w AS (PARTITION BY job_family, place ORDER BY pay)""")
def a04(spark, sf_dir):
    p = market.with_market_columns(_peers(spark, sf_dir), AS_OF)
    ranks = market.factor_ranks(
        p.select(*market.GROUP, "pay", "age", "reach", F.lit(None).cast("double").alias("crowd")), p
    ).filter(F.col("factor") == "pay")
    return (
        p.filter(F.col("pay").isNotNull())
        .join(ranks.select(*market.GROUP, F.col("value").alias("pay"), "percentile"),
              [*market.GROUP, "pay"])
        .select("posting_key", "percentile")
    )


_ASSESS = """, peers AS (SELECT *, {fam} AS fam, {plc} AS plc FROM p),
roles AS (SELECT fam, plc, role, count(*) AS openings FROM peers GROUP BY ALL),
crowd AS (SELECT fam, plc, role, openings, 1e2 * ((rank() OVER (PARTITION BY fam, plc ORDER BY openings) - 1)
    + (count(*) OVER (PARTITION BY fam, plc, openings)) / 2e0) / count(*) OVER (PARTITION BY fam, plc) AS pct
    FROM roles),
g AS (SELECT fam, plc, count(*) AS peers, count(DISTINCT lower(company)) AS employers,
    count(pay) AS n_pay, min(reach) AS rmin, max(reach) AS rmax FROM peers GROUP BY fam, plc),
pays AS (SELECT posting_key, 1e2 * ((rank() OVER (PARTITION BY fam, plc ORDER BY pay) - 1)
    + (count(*) OVER (PARTITION BY fam, plc, pay)) / 2e0) / count(*) OVER (PARTITION BY fam, plc) AS pct
    FROM peers WHERE pay IS NOT NULL),
f AS (SELECT a.posting_key, a.fam, a.plc, g.peers, g.employers,
    CASE WHEN n_pay >= 8 THEN pays.pct END AS p_pay, 1e2 - crowd.pct AS p_crowd,
    CASE WHEN rmin <> rmax THEN 1e2 - 1e2 * ((rank() OVER (PARTITION BY a.fam, a.plc ORDER BY reach) - 1)
    + (count(*) OVER (PARTITION BY a.fam, a.plc, reach)) / 2e0) / count(*) OVER (PARTITION BY a.fam, a.plc) END AS p_reach,
    1e2 - 1e2 * ((rank() OVER (PARTITION BY a.fam, a.plc ORDER BY age) - 1)
    + (count(*) OVER (PARTITION BY a.fam, a.plc, age)) / 2e0) / count(*) OVER (PARTITION BY a.fam, a.plc) AS p_fresh
    FROM peers a JOIN g ON g.fam = a.fam AND g.plc = a.plc
    JOIN crowd ON crowd.fam = a.fam AND crowd.plc = a.plc AND crowd.role = a.role
    LEFT JOIN pays ON pays.posting_key = a.posting_key),
w AS (SELECT *, CASE WHEN p_pay IS NULL THEN 0e0 ELSE 0.4e0 END + 0.25e0
    + CASE WHEN p_reach IS NULL THEN 0e0 ELSE 0.15e0 END + 0.2e0 AS total FROM f WHERE peers >= 8),
c AS (SELECT *, (coalesce(p_pay, 0e0) * 0.4e0 + p_crowd * 0.25e0 + coalesce(p_reach, 0e0) * 0.15e0
    + p_fresh * 0.2e0) / total AS composite FROM w),
d AS (SELECT *, CAST(round_even(composite - 50, 0) AS INT) AS delta FROM c)
SELECT posting_key, fam AS job_family, plc AS place, peers, employers, delta,
    CASE WHEN delta >= 3 THEN 'up' WHEN delta <= -3 THEN 'down' ELSE 'flat' END AS direction,
    CAST(round_even(composite, 0) AS INT) AS percentile, peers >= 25 AS confident,
    CAST(round_even(p_pay, 0) AS INT) AS pay_percentile,
    CAST(round_even(p_crowd, 0) AS INT) AS crowd_percentile,
    CAST(round_even(p_reach, 0) AS INT) AS reach_percentile,
    CAST(round_even(p_fresh, 0) AS INT) AS fresh_percentile,
    CASE WHEN p_pay IS NOT NULL THEN CAST(round_even(1e2 * 0.4e0 / total, 0) AS INT) END AS pay_share,
    CAST(round_even(1e2 * 0.25e0 / total, 0) AS INT) AS crowd_share,
    CASE WHEN p_reach IS NOT NULL THEN CAST(round_even(1e2 * 0.15e0 / total, 0) AS INT) END AS reach_share,
    CAST(round_even(1e2 * 0.2e0 / total, 0) AS INT) AS fresh_share FROM d"""


@query("A05_assess", _P + _ASSESS.replace("{fam}", "job_family").replace("{plc}", "place"))
def a05(spark, sf_dir):
    p = _peers(spark, sf_dir)
    return market.assess(p, p, AS_OF)


@query("A05_assess_thin_groups", _P + _ASSESS.replace("{fam}", "concat(job_family, brand)").replace("{plc}", "company"))
def a05_thin(spark, sf_dir):
    """The same with groups so narrow that many have under eight peers."""
    p = _peers(spark, sf_dir).withColumn("job_family", F.concat("job_family", "brand")).withColumn(
        "place", F.col("company"))
    return market.assess(p, p, AS_OF)


_EST = """, bands AS (SELECT grouping(job_family) AS af, grouping(place) AS ap, job_family AS bf, place AS bp,
    count(low) AS n, count(high) AS nh, median(low) AS ml, median(high) AS mh FROM peers
    GROUP BY GROUPING SETS ((job_family, place), (job_family), (place), ())),
ok AS (SELECT * FROM bands WHERE n >= 8 AND nh >= 8 AND mh >= ml),
hit AS (SELECT posting_key, n, ml, mh, CASE WHEN af = 0 AND ap = 0 THEN 0 WHEN af = 0 THEN 1
    WHEN ap = 0 THEN 2 ELSE 3 END AS rung FROM peers JOIN ok
    ON (af = 1 OR bf = job_family) AND (ap = 1 OR bp = place) WHERE low IS NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY posting_key ORDER BY rung) AS rn FROM hit)
"""
_EST_SELECT = """SELECT posting_key, CAST(round_even(ml, 0) AS BIGINT) AS est_min,
    CAST(round_even(mh, 0) AS BIGINT) AS est_max, ['cell','family','place','all'][rung + 1] AS basis
    FROM best WHERE rn = 1"""


@query("A06_estimate_salary", _P + ", peers AS (SELECT * FROM p)" + _EST + _EST_SELECT)
def a06(spark, sf_dir):
    p = _peers(spark, sf_dir)
    return market.estimate_salary(p, p, AS_OF).select("posting_key", "est_min", "est_max", "basis")


@query("A06_estimate_salary_thin", _P + """, peers AS (SELECT * REPLACE (concat(job_family, brand) AS job_family,
    company AS place) FROM p)""" + _EST + _EST_SELECT)
def a06_thin(spark, sf_dir):
    p = _peers(spark, sf_dir).withColumn("job_family", F.concat("job_family", "brand")).withColumn(
        "place", F.col("company"))
    return market.estimate_salary(p, p, AS_OF).select("posting_key", "est_min", "est_max", "basis")


@query("A07_market_context", _P + _ASSESS.replace("{fam}", "job_family").replace("{plc}", "place")
       .replace("SELECT posting_key, fam AS job_family", ", assessed AS (SELECT posting_key, fam AS job_family")
       + """)""" + _EST.replace("FROM peers\n", "FROM p\n").replace("FROM peers JOIN", "FROM p JOIN")
       + """, est AS (""" + _EST_SELECT + """)
SELECT p.posting_key, company, title, delta, direction, peers, confident, est_min, est_max, basis
FROM p LEFT JOIN assessed a ON a.posting_key = p.posting_key LEFT JOIN est ON est.posting_key = p.posting_key
WHERE delta IS NOT NULL OR est_min IS NOT NULL""")
def a07(spark, sf_dir):
    p = _peers(spark, sf_dir, without=("remote", "score", "flag"))
    return market.market_context(p, p, AS_OF)


@query("A07_index_summary", _P + """ SELECT (SELECT count(DISTINCT run_ts) FROM s) AS files,
    count(*) AS postings, count(DISTINCT (job_family, place)) AS groups FROM p""")
def a07_index(spark, sf_dir):
    s = sightings(spark, sf_dir)
    p = market.latest_sightings(s, keep=["run_ts", "arrival", "company", "title", "job_family", "place"])
    return market.index_summary(s, p, "run_ts")


# -- archive ----------------------------------------------------------------------

ARCHIVE_SQL = _S + """, keyed AS (SELECT *, substring(sha1(regexp_replace(lower(concat(company, '|', title)),
    '[^a-z0-9]+', '', 'g')), 1, 16) AS uid FROM s),
fold AS (SELECT uid, CAST(min(run_ts) AS DATE) AS first_seen, CAST(max(run_ts) AS DATE) AS last_seen,
    count(DISTINCT run_ts) AS times_seen FROM keyed GROUP BY uid),
lastrun AS (SELECT k.uid, max(score) AS score FROM keyed k JOIN (SELECT uid, max(run_ts) AS m FROM keyed
    GROUP BY uid) x ON x.uid = k.uid AND x.m = k.run_ts GROUP BY k.uid),
label AS (SELECT uid, company, title, url FROM (SELECT *, row_number() OVER (PARTITION BY uid
    ORDER BY run_ts, arrival) AS rn FROM keyed) WHERE rn = 1),
a AS (SELECT fold.*, score, company, title, url FROM fold JOIN lastrun USING (uid) JOIN label USING (uid))
"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        sightings(spark, sf_dir)
        .withColumn("dedupe_key", keys.dedupe_key())
        .withColumn("uid", keys.uid())
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = history.fold_sightings(keyed(spark, sf_dir))
    return seen.withColumn("first_seen", F.col("first_seen").cast("date")).withColumn(
        "last_seen", F.col("last_seen").cast("date"))


@query("A08_archive_search", ARCHIVE_SQL + """SELECT uid, title, company, score, times_seen, first_seen, last_seen,
    date_diff('day', first_seen, last_seen) AS live_days,
    (SELECT count(*) FROM a) AS total,
    (SELECT count(*) FROM a WHERE score >= 40 AND last_seen >= DATE '1999-06-01'
        AND lower(concat(title, ' ', company)) LIKE '%promo%' AND lower(concat(title, ' ', company)) LIKE '%supplier%') AS matched
    FROM a WHERE score >= 40 AND last_seen >= DATE '1999-06-01' AND lower(concat(title, ' ', company)) LIKE '%promo%'
    AND lower(concat(title, ' ', company)) LIKE '%supplier%'
    ORDER BY last_seen DESC, score DESC, uid LIMIT 200 OFFSET 50""")
def a08(spark, sf_dir):
    found = market.archive_search(archive(spark, sf_dir), "promo supplier", 40, "1999-06-01", 200, 50)
    return found.select("uid", "title", "company", "score", "times_seen", "first_seen", "last_seen",
                        "live_days", "total", "matched")


@query("A09_archive_summary", ARCHIVE_SQL + """, m AS (SELECT max(last_seen) AS u FROM a),
    t AS (SELECT company, title, times_seen FROM a ORDER BY times_seen DESC, uid DESC LIMIT 1)
    SELECT count(*) AS total, count(DISTINCT lower(a.company)) AS companies, min(first_seen) AS since,
    max(last_seen) AS until, count(*) FILTER (score > 0) AS scored, CAST(sum(a.times_seen) AS BIGINT) AS readings,
    count(*) FILTER (last_seen = u) AS last_read, count(*) FILTER (first_seen = u) AS last_new,
    min(t.company) AS most_read_company, min(t.title) AS most_read_title, min(t.times_seen) AS most_read_times
    FROM a, m, t""")
def a09(spark, sf_dir):
    return market.archive_summary(archive(spark, sf_dir))


@query("A10_company_board", ARCHIVE_SQL + """SELECT lower(company) AS company_key, min(company) AS company,
    count(*) AS postings, max(score) AS best, count(*) FILTER (score > 0) AS scored FROM a GROUP BY lower(company)
    ORDER BY scored DESC, postings DESC, company_key LIMIT 60""")
def a10(spark, sf_dir):
    return market.company_board(archive(spark, sf_dir))


_TIER = """CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C'
    WHEN score >= 30 THEN 'D' ELSE 'F' END"""


@query("A11_tier_counts", ARCHIVE_SQL + f""", c AS (SELECT {_TIER} AS tier FROM a)
    SELECT t.tier, count(c.tier) AS n FROM (VALUES ('A'),('B'),('C'),('D'),('F')) t(tier) LEFT JOIN c
    ON c.tier = t.tier GROUP BY t.tier""")
def a11(spark, sf_dir):
    return market.tier_counts(archive(spark, sf_dir).withColumn("tier", F.expr(_TIER)))


@query("A11_source_counts", _S + " SELECT source, count(*) AS n FROM s GROUP BY source")
def a11_sources(spark, sf_dir):
    return market.source_counts(sightings(spark, sf_dir))


@query("A11_effective_floor", ARCHIVE_SQL + """SELECT count(*) AS rows, 45 AS configured, min(score) AS effective,
    count(*) >= 1500 AND min(score) > 45 AS capped FROM a""")
def a11_floor(spark, sf_dir):
    return market.effective_floor(archive(spark, sf_dir), 45, 1500)


# The annotated list: archive rows, application state by uid, stars by uid.
LIST_SQL = _P + """, apps AS (SELECT substring(sha1(regexp_replace(lower(concat(s_name, '|', p_type, ' ', p_name)),
    '[^a-z0-9]+', '', 'g')), 1, 16) AS uid, o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS id,
    CASE o_orderkey % 9 WHEN 0 THEN 'prepared' WHEN 1 THEN 'applied' WHEN 2 THEN 'followed-up'
        WHEN 3 THEN 'screening' WHEN 4 THEN 'interview' WHEN 5 THEN 'offer'
        WHEN 6 THEN 'rejected' WHEN 7 THEN 'ghosted' ELSE 'withdrawn' END AS status
    FROM orders JOIN part ON p_partkey = o_orderkey % 199 JOIN supplier ON s_suppkey = o_custkey % 100),
log AS (SELECT uid, max_by(id, seq) AS id, max_by(status, seq) AS status FROM apps GROUP BY uid),
l AS (SELECT p.*, substring(sha1(regexp_replace(lower(posting_key), '[^a-z0-9]+', '', 'g')), 1, 16) AS uid,
    date_diff('day', CAST(posted_at AS DATE), DATE '2001-12-01') AS age_days FROM p),
x AS (SELECT l.*, age_days % 7 = 0 AS starred, coalesce(status <> 'prepared', false) AS applied,
    coalesce(status = 'prepared', false) AS prepared, coalesce(id, '') AS application,
    coalesce(status, '') AS app_status FROM l LEFT JOIN log USING (uid))
"""


def list_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .views import table

    o, p, s = (table(spark, sf_dir, t) for t in ("orders", "part", "supplier"))
    status = F.expr("element_at(array('prepared','applied','followed-up','screening','interview','offer',"
                    "'rejected','ghosted','withdrawn'), cast(o_orderkey % 9 as int) + 1)")
    j = o.join(p, F.col("p_partkey") == F.col("o_orderkey") % 199).join(
        s, F.col("s_suppkey") == F.col("o_custkey") % 100)
    return j.select(
        keys.uid(keys.dedupe_key("s_name", F.concat_ws(" ", "p_type", "p_name"))).alias("uid"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"),
        status.alias("status"),
    )


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _peers(spark, sf_dir).withColumn("dedupe_key", keys.dedupe_key()).withColumn("uid", keys.uid())
    return p.withColumn("age_days", F.datediff(F.lit(AS_OF).cast("date"), F.col("posted_at")))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listed(spark, sf_dir)
    stars = rows.filter(F.col("age_days") % 7 == 0).select("uid")
    return market.annotate(rows, list_apps(spark, sf_dir), stars)


@query("A15_list_annotation", LIST_SQL + "SELECT uid, title, starred, applied, prepared, application, app_status FROM x")
def a15(spark, sf_dir):
    return annotated(spark, sf_dir).select("uid", "title", "starred", "applied", "prepared", "application", "app_status")


@query("A12_list_filters", LIST_SQL + """SELECT uid, score FROM x WHERE score BETWEEN 20 AND 90 AND NOT applied
    AND NOT prepared AND remote AND low IS NOT NULL AND age_days <= 1200 AND lower(concat(title, ' ', company)) LIKE '%econ%'""")
def a12(spark, sf_dir):
    rows = annotated(spark, sf_dir).withColumn("location", F.lit(""))
    return market.list_filter(rows, min_score=90, max_score=20, hide_applied=True, hide_prepared=True,
                              remote_only=True, has_pay=True, posted_within=1200, text="ECON").select("uid", "score")


@query("A13_null_last_sort", _P + ", peers AS (SELECT * FROM p)" + _EST + ", est AS (" + _EST_SELECT + """)
    SELECT p.posting_key, coalesce(raw_low, raw_high, est_min) AS sort_key, row_number() OVER (ORDER BY
    coalesce(raw_low, raw_high, est_min) DESC NULLS LAST, p.posting_key) AS pos FROM p LEFT JOIN est
    ON est.posting_key = p.posting_key ORDER BY pos LIMIT 300""")
def a13(spark, sf_dir):
    # The index and the list read the postings: sightings are folded once.
    p = written(_peers(spark, sf_dir), "listed")
    est = market.estimate_salary(p, p, AS_OF).select("posting_key", "est_min")
    top = market.sort_rows(p.join(est, "posting_key", "left"), "salary", descending=True, tie=("posting_key",)).limit(300)
    key = F.coalesce("salary_min", "salary_max", "est_min")
    # The page (300 rows) is numbered after the limit.
    from pyspark.sql import Window
    return top.select("posting_key", key.alias("sort_key"),
                      F.row_number().over(Window.orderBy(F.desc_nulls_last(key), "posting_key")).alias("pos"))


@query("A14_timeline", LIST_SQL + """, y AS (SELECT *, age_days % 40 AS d FROM x)
    SELECT CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 7 THEN concat(d, ' days ago')
    WHEN d <= 14 THEN 'Last week' WHEN d < 38 THEN 'Older' ELSE 'Date unknown' END AS bucket, count(*) AS n FROM y GROUP BY bucket""")
def a14(spark, sf_dir):
    rows = listed(spark, sf_dir).withColumn("d", F.col("age_days") % 40)
    d = F.when(F.col("d") < 38, F.col("d"))
    return rows.groupBy(market.day_bucket(d).alias("bucket")).agg(F.count("*").alias("n"))


@query("A16_stars", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS uid, ts AS seen_at, event_type <> 'error' AS is_on,
    event_type AS title, event_id FROM events),
    offs AS (SELECT uid, max(seen_at) AS off_at FROM e WHERE NOT is_on GROUP BY uid)
    SELECT e.uid, min(seen_at) AS starred_at, max_by(title, (seen_at, title)) AS title FROM e LEFT JOIN offs USING (uid)
    WHERE is_on AND (off_at IS NULL OR seen_at > off_at) GROUP BY e.uid""")
def a16(spark, sf_dir):
    from .views import table
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("uid"), F.col("ts").alias("at"),
        (F.col("event_type") != "error").alias("on"), F.col("event_type").alias("title"),
        F.lit("").alias("company"), F.lit("").alias("url"), F.lit("").alias("source"))
    return market.fold_stars(ev).select("uid", "starred_at", "title")
