"""Registered queries for duplicates and history (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import history
from .market_queries import ARCHIVE_SQL, keyed
from .registry import query
from .views import AS_OF, SIGHTINGS_SQL, sightings, table

_S = f"WITH s AS ({SIGHTINGS_SQL})"
_PRIORITY = """CASE source WHEN 'workday' THEN 0 WHEN 'greenhouse' THEN 0 WHEN 'lever' THEN 0
    WHEN 'usajobs' THEN 2 WHEN 'adzuna' THEN 3 WHEN 'remoteok' THEN 4 WHEN 'hackernews' THEN 5 ELSE 9 END"""

# Copies with bodies of different lengths, some dates missing, some snippets.
COPIES_SQL = _S + f""", k AS (SELECT *, regexp_replace(lower(concat(company, '|', title)), '[^a-z0-9]+', '', 'g') AS dedupe_key,
    repeat('x', CAST(qty AS INT)) AS description, line % 3 = 0 AS partial,
    CASE WHEN line % 2 = 0 THEN posted_at END AS dated, {_PRIORITY} AS prio, disc >= 0.065 AS agency FROM s),
w AS (SELECT *, min(prio) OVER (PARTITION BY dedupe_key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
chain AS (SELECT * FROM w WHERE before IS NULL OR prio < before),
best AS (SELECT dedupe_key, max_by(url, arrival) AS url, max_by(source, arrival) AS source, max_by(company, arrival) AS company,
    max_by(title, arrival) AS title, max_by(score, arrival) AS score, max(arrival) AS arrival, max_by(agency, arrival) AS agency,
    max_by(description, (length(description), arrival)) AS description, max_by(partial, (length(description), arrival)) AS partial,
    max_by(dated, arrival) FILTER (dated IS NOT NULL) AS posted_at FROM chain GROUP BY dedupe_key),
boards AS (SELECT dedupe_key, list_sort(list(DISTINCT source)) AS boards, count(*) AS copies FROM k GROUP BY dedupe_key),
h01 AS (SELECT b.*, substring(sha1(b.dedupe_key), 1, 16) AS uid, copies - 1 AS collapsed,
    array_to_string(list_filter(boards, lambda x: x <> b.source), ',') AS also_on FROM best b JOIN boards USING (dedupe_key))
"""


def copies(spark, sf_dir):
    return sightings(spark, sf_dir).withColumns({
        "description": F.expr("repeat('x', cast(qty as int))"), "partial": F.col("line") % 3 == 0,
        "posted_at": F.when(F.col("line") % 2 == 0, F.col("posted_at")),
        "flags": F.when(F.col("disc") >= 0.065, F.array(F.lit("staffing-agency"))).otherwise(F.array().cast("array<string>")),
        "reasons": F.array().cast("array<string>"),
    })


@query("H01_collapse", COPIES_SQL + """SELECT uid, url, source, score, posted_at, length(description) AS body,
    partial, also_on, collapsed FROM h01""")
def h01(spark, sf_dir):
    c = history.collapse(copies(spark, sf_dir))
    return c.select("uid", "url", "source", "score", "posted_at", F.length("description").alias("body"), "partial",
                    F.array_join("also_on", ",").alias("also_on"), "collapsed")


@query("H02_collapse_reposts", COPIES_SQL + """, open AS (SELECT *, lower(title) AS tkey,
        source NOT IN ('workday', 'greenhouse', 'lever') AS is_open, right(company, 1) = '0' AS known FROM h01),
    g AS (SELECT source, tkey, count(DISTINCT lower(company)) AS companies, avg(CAST(agency AS INT)) AS share,
        count(DISTINCT lower(company)) FILTER (NOT known) AS shops,
        max_by(uid, (score, -arrival)) FILTER (NOT known) AS keep FROM open WHERE is_open GROUP BY source, tkey),
    farms AS (SELECT * FROM g WHERE companies >= 4 AND share >= 0.25 AND keep IS NOT NULL)
    SELECT uid, o.source, CASE WHEN f.keep = uid THEN f.shops END AS shops FROM open o LEFT JOIN farms f
    ON f.source = o.source AND f.tkey = o.tkey AND is_open
    WHERE f.keep IS NULL OR known OR f.keep = uid""")
def h02(spark, sf_dir):
    c = history.collapse(copies(spark, sf_dir))
    known = table(spark, sf_dir, "supplier").filter(F.col("s_name").endswith("0")).select(F.col("s_name").alias("name"))
    out = history.collapse_reposts(c, known)
    firms = F.filter("flags", lambda f: f.startswith("reposted by"))
    n = F.regexp_extract(F.try_element_at(firms, F.lit(1)), r"(\d+)", 1).cast("long")
    return out.select("uid", "source", n.alias("shops"))


@query("H03_fold_sightings", ARCHIVE_SQL + "SELECT uid, first_seen, last_seen, times_seen, score, company, title FROM a")
def h03(spark, sf_dir):
    f = history.fold_sightings(keyed(spark, sf_dir))
    return f.select("uid", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"),
                    "times_seen", "score", "company", "title")


@query("H03_incremental_merge", ARCHIVE_SQL + "SELECT uid, first_seen, last_seen, times_seen, score, company, title FROM a")
def h03_merge(spark, sf_dir):
    """The same table from an old state and one newer run folded in."""
    k = keyed(spark, sf_dir)
    cut = F.lit("2000-06-01").cast("timestamp")
    m = history.merge_seen(history.fold_sightings(k.filter(F.col("run_ts") < cut)),
                           history.fold_sightings(k.filter(F.col("run_ts") >= cut)))
    return m.select("uid", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"),
                    "times_seen", "score", "company", "title")


_SPLIT = ARCHIVE_SQL + """, old AS (SELECT DISTINCT uid FROM keyed WHERE run_ts < TIMESTAMP '2001-01-01'),
    run AS (SELECT * FROM keyed WHERE run_ts >= TIMESTAMP '2001-01-01')"""


@query("H04_new_postings", _SPLIT + """ SELECT uid, url, score FROM run WHERE score >= 45
    AND uid NOT IN (SELECT uid FROM old)""")
def h04(spark, sf_dir):
    k = keyed(spark, sf_dir)
    cut = F.lit("2001-01-01").cast("timestamp")
    seen = history.fold_sightings(k.filter(F.col("run_ts") < cut))
    return history.new_postings(k.filter(F.col("run_ts") >= cut), seen, history.MIN_SCORE_TO_REPORT).select(
        "uid", "url", "score")


@query("H05_settle_posted", ARCHIVE_SQL + """, f AS (SELECT uid, min(run_ts) AS first FROM keyed GROUP BY uid)
    SELECT url, CASE WHEN line % 5 = 0 THEN NULL WHEN posted_at > first THEN first ELSE posted_at END AS posted_at,
    first AS first_seen FROM keyed JOIN f USING (uid)""")
def h05(spark, sf_dir):
    k = keyed(spark, sf_dir).withColumn("posted_at", F.when(F.col("line") % 5 != 0, F.col("posted_at")))
    return history.settle_posted(k, history.fold_sightings(k)).select("url", "posted_at", "first_seen")


@query("H06_ghosts", ARCHIVE_SQL + """, t AS (SELECT substring(sha1(lower(company)), 1, 16) AS uid, min(run_ts) AS f, count(DISTINCT run_ts) AS n
    FROM s GROUP BY company)
    SELECT uid, n AS times_seen, date_diff('day', CAST(f AS DATE), DATE '2001-12-01') AS span_days FROM t
    WHERE n >= 20 AND date_diff('day', CAST(f AS DATE), DATE '2001-12-01') >= 45""")
def h06(spark, sf_dir):
    s = sightings(spark, sf_dir).withColumn("uid", F.substring(F.sha1(F.lower("company").cast("binary")), 1, 16))
    return history.ghosts(history.fold_sightings(s), AS_OF).select("uid", "times_seen", "span_days")


@query("H07_prune_seen", ARCHIVE_SQL + """SELECT uid, first_seen, last_seen FROM a
    WHERE first_seen >= TIMESTAMP '2001-12-01' - INTERVAL 120 DAY""")
def h07(spark, sf_dir):
    p = history.prune_seen(history.fold_sightings(keyed(spark, sf_dir)), AS_OF)
    return p.select("uid", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"))


_WORKING = ARCHIVE_SQL + """, r AS (SELECT uid, max_by(score, (run_ts, arrival)) AS score, max_by(qty, (run_ts, arrival)) AS q,
    min(run_ts) AS f FROM keyed WHERE run_ts >= TIMESTAMP '2001-10-01' GROUP BY uid),
    p AS (SELECT uid, max_by(score, (run_ts, arrival)) AS score, max_by(qty, (run_ts, arrival)) AS q,
    min(run_ts) AS f, max(run_ts) AS l FROM keyed WHERE run_ts < TIMESTAMP '2001-11-10' AND run_ts >= TIMESTAMP '2001-08-01' GROUP BY uid),
    m AS (SELECT coalesce(r2.uid, p.uid) AS uid, coalesce(r2.score, p.score) AS score,
    CASE WHEN r2.uid IS NULL THEN p.q WHEN CAST(r2.q AS INT) % 3 = 0 THEN coalesce(p.q, 0) ELSE r2.q END AS body,
    coalesce(p.f, r2.f) AS first_seen, CASE WHEN r2.uid IS NULL THEN p.l ELSE TIMESTAMP '2001-12-01' END AS last_seen
    FROM (SELECT * FROM r WHERE score >= 45) r2 FULL JOIN p ON p.uid = r2.uid)
    SELECT uid, score, CAST(body AS INT) AS body, first_seen, last_seen FROM m WHERE score >= 45
    AND last_seen >= TIMESTAMP '2001-12-01' - INTERVAL 30 DAY ORDER BY score DESC, last_seen, uid LIMIT 1500"""


@query("H08_upsert_candidates", _WORKING)
def h08(spark, sf_dir):
    k = keyed(spark, sf_dir)

    def latest(df):
        return df.groupBy("uid").agg(
            F.max(F.struct("run_ts", "arrival", "score", "qty")).alias("m"),
            F.min("run_ts").alias("first_seen"), F.max("run_ts").alias("last_seen"),
        ).select("uid", "m.score", "m.qty", F.col("first_seen").cast("timestamp"), F.col("last_seen").cast("timestamp"))

    run = latest(k.filter("run_ts >= timestamp '2001-10-01'")).withColumn(
        "description", F.expr("case when cast(qty as int) % 3 = 0 then '' else repeat('x', cast(qty as int)) end")
    ).drop("last_seen", "qty")
    prior = latest(k.filter("run_ts < timestamp '2001-11-10' and run_ts >= timestamp '2001-08-01'")).withColumn(
        "description", F.expr("repeat('x', cast(qty as int))")).drop("qty")
    out = history.upsert_candidates(run, prior, AS_OF)
    return out.select("uid", "score", F.length("description").alias("body"),
                      F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
                      F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("H09_reuse_bodies", ARCHIVE_SQL + """, run AS (SELECT uid, url, qty, line FROM keyed),
    cand AS (SELECT uid, url, max(repeat('y', CAST(qty + 10 AS INT))) AS b FROM keyed WHERE line % 2 = 0 GROUP BY uid, url),
    bod AS (SELECT url, max(repeat('z', 40)) AS b FROM keyed WHERE line = 3 GROUP BY url),
    j AS (SELECT r.uid, r.url, CASE WHEN line % 4 = 0 THEN 0 ELSE CAST(qty AS INT) END AS n, line IN (2, 3) AS part,
    length(coalesce(c.b, CASE WHEN line IN (2, 3) THEN bod.b END)) AS given FROM run r LEFT JOIN cand c ON c.uid = r.uid AND c.url = r.url
    LEFT JOIN bod ON bod.url = r.url)
    SELECT url, coalesce((n = 0 OR part) AND given > n, false) AS reused,
    CASE WHEN (n = 0 OR part) AND given > n THEN given ELSE n END AS body,
    part AND NOT coalesce((n = 0 OR part) AND given > n, false) AS partial FROM j""")
def h09(spark, sf_dir):
    k = keyed(spark, sf_dir).withColumn("flags", F.array().cast("array<string>"))
    run = k.withColumns({
        "description": F.expr("case when line % 4 = 0 then '' else repeat('x', cast(qty as int)) end"),
        "partial": F.col("line").isin(2, 3)})
    cand = k.filter("line % 2 = 0").withColumns({"description": F.expr("repeat('y', cast(qty + 10 as int))"), "partial": F.lit(False)})
    filled = k.filter("line = 3").withColumns({"description": F.expr("repeat('z', 40)"), "partial": F.lit(False)})
    empty = filled.select("url", F.lit("").alias("body"), F.lit(AS_OF).cast("timestamp").alias("at")).limit(0)
    bodies = history.remember_bodies(empty, filled, AS_OF)
    return history.reuse_bodies(run, cand, bodies).select("url", "reused", F.length("description").alias("body"), "partial")


@query("H11_work_list", ARCHIVE_SQL + """, w AS (SELECT uid, url, score, concat(source, '.example.com') AS host FROM keyed WHERE score >= 30),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, uid, url) AS host_rank FROM w)
    SELECT uid, url, host, score, host_rank FROM r WHERE host_rank <= 60 ORDER BY score DESC, uid, url LIMIT 250""")
def h11(spark, sf_dir):
    return history.work_list(keyed(spark, sf_dir)).select("uid", "url", "host", "score", "host_rank")


@query("H12_sweep_list", ARCHIVE_SQL + """, w AS (SELECT uid, url, score, last_seen, line, CASE WHEN line % 3 = 0 THEN NULL ELSE posted_at END AS checked
    FROM (SELECT *, run_ts AS last_seen FROM keyed))
    SELECT uid, url, score FROM w WHERE last_seen < (SELECT max(last_seen) FROM w) AND line IN (2, 3, 5)
    ORDER BY checked NULLS FIRST, score DESC, uid, url LIMIT 20""")
def h12(spark, sf_dir):
    k = keyed(spark, sf_dir).withColumns({
        "last_seen": F.col("run_ts"), "flags": F.array(F.when(F.col("line") == 2, F.lit("partial-description"))),
        "partial": F.col("line") == 3, "description": F.when(F.col("line") == 5, F.lit(" ")).otherwise(F.lit("text")),
        "checked_at": F.when(F.col("line") % 3 != 0, F.col("posted_at"))})
    # Copies share a uid here, so the link settles the tie.
    return history.sweep_list(k.withColumn("uid", F.concat("uid", F.lit("|"), "url"))).select(
        F.split("uid", r"\|")[0].alias("uid"), "url", "score")


@query("H12_close_gone", ARCHIVE_SQL + """, gone AS (SELECT uid FROM a WHERE times_seen % 2 = 0)
    SELECT uid, score FROM a WHERE score >= 45 AND NOT (uid IN (SELECT uid FROM gone)
    AND last_seen < (SELECT max(last_seen) FROM a))""")
def h12_close(spark, sf_dir):
    a = history.fold_sightings(keyed(spark, sf_dir))
    return history.close_gone(a, a.filter("times_seen % 2 = 0").select("uid")).select("uid", "score")


@query("H13_learn_candidates", _S + """, q AS (SELECT * FROM s WHERE score >= 75 AND disc < 0.065 AND right(company, 1) <> '0'
    AND NOT (right(company, 1) = '7')),
    c AS (SELECT lower(company) AS k, max(score) AS best, min_by(company, arrival) AS name, count(DISTINCT title) AS n_titles FROM q GROUP BY lower(company))
    SELECT name, best, n_titles FROM c ORDER BY best DESC, name LIMIT 5""")
def h13(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    known = s.filter(F.col("s_name").endswith("0")).select(F.col("s_name").alias("name"))
    misses = s.filter(F.col("s_name").rlike("[78]$")).select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_name").endswith("7"), F.lit("2001-11-20")).otherwise(F.lit("2001-09-01")).cast("date").alias("tried_on"))
    return history.learn_candidates(copies(spark, sf_dir), known, misses, AS_OF).select("name", "best", "n_titles")


@query("H14_confirm_boards", _S + """, b AS (SELECT DISTINCT company, source AS slug, lower(title) AS t FROM s WHERE source IN ('greenhouse', 'lever', 'workday')),
    h AS (SELECT lower(company) AS c, lower(title) AS t, min(title) AS title FROM s WHERE source IN ('adzuna', 'remoteok') GROUP BY 1, 2)
    SELECT b.company, b.slug, min(h.title) AS proof FROM b JOIN h ON h.c = lower(b.company) AND h.t = b.t GROUP BY b.company, b.slug""")
def h14(spark, sf_dir):
    s = sightings(spark, sf_dir)
    boards = s.filter(F.col("source").isin("greenhouse", "lever", "workday")).select("company", F.col("source").alias("slug"), F.upper("title").alias("title"))
    seen = s.filter(F.col("source").isin("adzuna", "remoteok")).select("company", "title")
    return history.confirm_boards(boards, seen)


@query("H14_confirm_local_boards", """SELECT s_name AS company, 'b' AS slug, 'columbus' AS proof FROM supplier WHERE s_suppkey % 3 = 0""")
def h14_local(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    b = s.select(F.col("s_name").alias("company"),
                 F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 1, F.lit(" Advanced")).otherwise(F.lit(" Holdings, Inc."))).alias("board_company"),
                 F.lit("b").alias("slug"),
                 F.when(F.col("s_suppkey") % 3 == 2, F.lit("Columbus, Georgia")).otherwise(F.lit("Columbus, OH")).alias("location"))
    return history.confirm_local_boards(b, ("columbus",), "oh")


@query("H15_seed_candidates", _S + """, loc AS (SELECT company FROM s WHERE place IN ('NATION_1', 'NATION_2') UNION ALL
    SELECT company FROM s WHERE place IN ('NATION_1', 'NATION_2') AND score >= 45),
    c AS (SELECT lower(company) AS k, min(company) AS name, count(*) AS n FROM loc GROUP BY 1),
    n AS (SELECT lower(s_name) AS k, s_name AS name, s_suppkey AS pos FROM supplier WHERE s_suppkey < 30),
    u AS (SELECT k, name, 2 AS sightings, 0 AS part, pos FROM n UNION ALL SELECT k, name, n, 1, 0 FROM c WHERE n >= 2 AND k NOT IN (SELECT k FROM n))
    SELECT name, sightings, part = 0 AS pasted FROM u WHERE right(name, 1) NOT IN ('0', '7')""")
def h15(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    named = s.filter("s_suppkey < 30").select(F.col("s_name").alias("name"), F.lit("").alias("site"), F.col("s_suppkey").alias("pos"))
    known = s.filter(F.col("s_name").endswith("0")).select(F.col("s_name").alias("name"))
    misses = s.filter(F.col("s_name").endswith("7")).select(F.col("s_name").alias("name"), F.lit("2001-11-20").cast("date").alias("tried_on"))
    si = sightings(spark, sf_dir).withColumn("location", F.regexp_replace("place", "_", " "))
    out = history.seed_candidates(named, si, si.filter("score >= 45"), known, misses, AS_OF, ("nation 1", "nation 2"), limit=None)
    return out.select("name", "sightings", "pasted")
