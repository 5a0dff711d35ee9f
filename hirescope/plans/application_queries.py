"""Registered queries for the application log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import applications as ap
from .registry import query
from .views import APPLICATIONS_SQL, applications, table

AS_OF = "1999-06-01 00:00:00"
_L = f"WITH l AS ({APPLICATIONS_SQL})"


@query("K06_fold_log", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, event_type, event_id, value FROM events),
    last AS (SELECT id, max(ts) AS last_ts, max(ts) FILTER (event_type = 'error') AS removed FROM e GROUP BY id),
    s AS (SELECT id, max_by(event_type, ts) FILTER (event_type <> 'error') AS status, max_by(event_id, ts) FILTER (event_type = 'click') AS packet, count(*) FILTER (event_type = 'click') AS n FROM e GROUP BY id)
    SELECT s.id, status, packet, n AS messages FROM s JOIN last USING (id) WHERE removed IS NULL OR removed < last_ts""")
def k06(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "remove").otherwise("update").alias("kind"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("clicked "), F.col("event_id").cast("string"))).alias("message"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("packet"))
    return ap.fold_log(e, ("status", "packet")).select("id", "status", "packet", "messages")


@query("G15_funnel", _L + """ SELECT s.status, count(l.id) AS n FROM (VALUES ('prepared'),('applied'),('followed-up'),('screening'),('interview'),('offer'),('rejected'),('ghosted'),('withdrawn')) s(status)
    LEFT JOIN l ON l.status = s.status GROUP BY s.status""")
def g15(spark, sf_dir):
    return ap.funnel(applications(spark, sf_dir))


@query("G15_by_source", _L + """ SELECT source, count(*) AS sent, count(*) FILTER (status IN ('screening','interview','offer','rejected')) AS responses,
    count(*) FILTER (status IN ('screening','interview','offer','rejected')) / CAST(count(*) AS DOUBLE) AS rate FROM l WHERE status <> 'prepared' GROUP BY source""")
def g15_source(spark, sf_dir):
    return ap.by_source(applications(spark, sf_dir))


@query("G15_rejections", _L + """ SELECT CASE WHEN ostatus = 'P' THEN 'unknown' WHEN ostatus = 'F' THEN 'interview' ELSE 'screening' END AS stage, count(*) AS n FROM l WHERE status = 'rejected' GROUP BY 1""")
def g15_rejections(spark, sf_dir):
    stage = F.when(F.col("ostatus") == "P", "").when(F.col("ostatus") == "F", "interview").otherwise("screening")
    return ap.rejections(applications(spark, sf_dir).withColumn("rejected_stage", stage))


@query("G15_weekly", _L + """ SELECT count(*) FILTER (status <> 'prepared') AS sent, count(*) FILTER (status IN ('screening','interview','offer','rejected')) AS responses,
    count(*) FILTER (status <> 'prepared') >= 20 AS enough FROM l""")
def g15_weekly(spark, sf_dir):
    return ap.weekly(applications(spark, sf_dir))


def due_log(spark, sf_dir):
    return applications(spark, sf_dir).withColumn("follow_up_due", ap.follow_up_date("applied_on"))


@query("G16_follow_ups_due", _L + " SELECT id, applied_on + 7 AS follow_up_due FROM l WHERE status = 'applied' AND applied_on + 7 <= DATE '1999-06-01'")
def g16(spark, sf_dir):
    return ap.follow_ups_due(due_log(spark, sf_dir), AS_OF).select("id", "follow_up_due")


@query("G16_unpinged", _L + " SELECT id, applied_on + 7 AS follow_up_due FROM l WHERE status = 'applied' AND applied_on + 7 <= DATE '1999-06-01' AND okey % 2 = 0")
def g16_unpinged(spark, sf_dir):
    log = due_log(spark, sf_dir)
    pings = log.filter("okey % 2 = 1").select("id", "follow_up_due").union(log.filter("okey % 2 = 0").select("id", F.date_sub("follow_up_due", 3)))
    return ap.unpinged(log, pings, AS_OF).select("id", "follow_up_due")


def log_rows(spark, sf_dir):
    """Applications with the identities the guard compares."""
    a = applications(spark, sf_dir)
    return a.withColumns({
        "uid": F.when(F.col("okey") % 3 == 0, F.concat(F.lit("u"), (F.col("okey") % 5000).cast("string"))).otherwise(F.lit("")),
        "dedupe_key": F.when(F.col("okey") % 3 == 1, F.concat(F.lit("k"), (F.col("okey") % 5000).cast("string"))).otherwise(F.lit("")),
        "url": F.when(F.col("okey") % 3 == 2, F.concat(F.lit("x"), (F.col("okey") % 5000).cast("string"))).otherwise(F.lit("")),
        "division": F.when(F.col("okey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Dept of "), F.col("ostatus"))),
        "agency": F.when(F.col("okey") % 50 == 0, F.lit("Some Agency")).otherwise(F.lit("")),
        "auto": F.col("okey") % 2 == 0, "prepared_on": F.col("applied_on"),
    })


def queue_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("u"), n.cast("string")).alias("uid"), F.concat(F.lit("k"), n.cast("string")).alias("dedupe_key"),
        F.concat(F.lit("x"), n.cast("string")).alias("url"), F.upper("c_name").alias("company"),
        F.element_at(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW")), (n % 3 + 1).cast("int")).alias("title"),
        F.when(n % 2 == 0, F.lit("Department of P")).otherwise(F.lit("")).alias("division"),
        F.when(n % 9 == 0, F.array(F.lit("staffing-agency"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        (n % 101).cast("int").alias("score"), (n % 40).cast("int").alias("age_days"),
        F.date_add(F.lit("1999-01-01").cast("date"), (n % 30).cast("int")).alias("first_seen"))


_G = _L + """, a AS (SELECT *, CASE WHEN okey % 3 = 0 THEN 'u' || (okey % 5000) ELSE '' END AS uid, CASE WHEN okey % 3 = 1 THEN 'k' || (okey % 5000) ELSE '' END AS dkey,
    CASE WHEN okey % 3 = 2 THEN 'x' || (okey % 5000) ELSE '' END AS url, CASE WHEN okey % 4 = 0 THEN '' ELSE 'department' || lower(ostatus) END AS div,
    okey % 50 = 0 AS via, okey % 2 = 0 AS auto, regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') AS cokey FROM l),
    q AS (SELECT 'u' || c_custkey AS uid, 'k' || c_custkey AS dkey, 'x' || c_custkey AS url, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS cokey,
    ['1-URGENT', '2-HIGH', '5-LOW'][c_custkey % 3 + 1] AS title, CASE WHEN c_custkey % 2 = 0 THEN 'departmentp' ELSE '' END AS div, c_custkey % 9 = 0 AS flagged, c_custkey % 101 AS score,
    c_custkey % 40 AS age, DATE '1999-01-01' + CAST(c_custkey % 30 AS INT) AS first_seen FROM customer),
    pairs AS (SELECT DISTINCT q.uid AS quid, a.id FROM q JOIN a ON a.uid = q.uid UNION SELECT q.uid, a.id FROM q JOIN a ON a.dkey = q.dkey UNION SELECT q.uid, a.id FROM q JOIN a ON a.url = q.url)
"""


@query("G17_same_req", _G + "SELECT quid AS q_uid, id FROM pairs")
def g17(spark, sf_dir):
    return ap.same_req(queue_rows(spark, sf_dir), log_rows(spark, sf_dir))


@query("G17_same_role", _G + """SELECT q.uid AS q_uid, a.id FROM q JOIN a ON a.cokey = q.cokey AND regexp_replace(regexp_replace(lower(a.role), '^[123]', ''), '[- ]', '', 'g') = regexp_replace(regexp_replace(lower(q.title), '^[123]', ''), '[- ]', '', 'g')""")
def g17_role(spark, sf_dir):
    return ap.same_role(queue_rows(spark, sf_dir), log_rows(spark, sf_dir))


@query("G17_hidden_uids", _G + "SELECT DISTINCT uid FROM a WHERE uid <> '' AND NOT (auto AND status = 'prepared')")
def g17_hidden(spark, sf_dir):
    return ap.hidden_uids(log_rows(spark, sf_dir))


@query("G17_find", _G + "SELECT id FROM a WHERE contains(lower(company), '00000012') OR contains(id, '00000012') OR contains(lower(role), '00000012')")
def g17_find(spark, sf_dir):
    return ap.find(log_rows(spark, sf_dir), "00000012").select("id")


@query("G18_guard", _G + """, days AS (SELECT *, date_diff('day', applied_on, DATE '1999-06-01') AS d FROM a),
    roles AS (SELECT q.uid AS quid, a.id FROM q JOIN a ON a.cokey = q.cokey AND regexp_replace(regexp_replace(lower(a.role), '^[123]', ''), '[- ]', '', 'g') = regexp_replace(regexp_replace(lower(q.title), '^[123]', ''), '[- ]', '', 'g')),
    open AS (SELECT q.uid AS quid, q.div AS qdiv, a.div FROM q JOIN a ON a.cokey = q.cokey AND a.status IN ('applied','followed-up','screening','interview') LEFT JOIN pairs p ON p.quid = q.uid AND p.id = a.id WHERE p.id IS NULL),
    per AS (SELECT quid, qdiv, div, count(*) AS n FROM open GROUP BY ALL),
    conc AS (SELECT quid, qdiv, sum(n) AS board, coalesce(sum(n) FILTER (div = ''), 0) AS unk, coalesce(sum(n) FILTER (div <> '' AND div = qdiv), 0) AS mine, coalesce(max(n) FILTER (div <> ''), 0) AS big, count(*) FILTER (div <> '') AS names FROM per GROUP BY ALL),
    ag AS (SELECT q.uid AS quid, q.flagged, count(*) FILTER (NOT via) AS direct, count(*) FILTER (via) AS v FROM q LEFT JOIN a ON a.cokey = q.cokey GROUP BY ALL),
    agx AS (SELECT quid, ag.flagged, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.cokey = q.cokey) THEN direct ELSE 0 END AS direct, v FROM ag JOIN q ON q.uid = quid)
    SELECT quid AS uid, CASE WHEN status = 'prepared' THEN 'WARN' ELSE 'BLOCK' END AS level, 'same-req' AS rule, id AS subject, d AS n FROM pairs JOIN days USING (id)
    UNION ALL SELECT r.quid, CASE WHEN status = 'rejected' THEN 'BLOCK' ELSE 'WARN' END, 'role-cooldown', r.id, d FROM roles r JOIN days USING (id) LEFT JOIN pairs p ON p.quid = r.quid AND p.id = r.id WHERE p.id IS NULL AND status <> 'prepared' AND d < 120
    UNION ALL SELECT quid, CASE WHEN unk + CASE WHEN qdiv <> '' THEN mine ELSE big END >= 2 THEN 'BLOCK' ELSE 'NOTE' END, 'concurrency', '', unk + CASE WHEN qdiv <> '' THEN mine ELSE big END FROM conc WHERE unk + CASE WHEN qdiv <> '' THEN mine ELSE big END > 0
    UNION ALL SELECT quid, 'WARN', 'board-concurrency', '', board FROM conc WHERE (qdiv <> '' OR names > 0) AND board >= 6
    UNION ALL SELECT quid, CASE WHEN direct > 0 THEN 'BLOCK' ELSE 'WARN' END, 'agency', '', direct FROM agx WHERE flagged
    UNION ALL SELECT quid, 'NOTE', 'agency-history', '', v FROM agx WHERE NOT flagged AND v > 0""")
def g18(spark, sf_dir):
    return ap.guard(queue_rows(spark, sf_dir), log_rows(spark, sf_dir), AS_OF)


@query("G19_apply_queue", _G + """SELECT uid, score, age FROM q WHERE score >= 40 AND uid NOT IN (SELECT uid FROM a WHERE uid <> '' AND NOT (auto AND status = 'prepared'))
    ORDER BY score DESC, age, uid LIMIT 40""")
def g19(spark, sf_dir):
    return ap.apply_queue(queue_rows(spark, sf_dir), ap.hidden_uids(log_rows(spark, sf_dir)), 40).select("uid", "score", F.col("age_days").alias("age"))


@query("G19_queue_day", _G + "SELECT max(first_seen) AS day FROM q")
def g19_day(spark, sf_dir):
    return ap.queue_day(queue_rows(spark, sf_dir), "1999-03-15")


@query("G20_enrich", _G + """, m AS (SELECT cokey, regexp_replace(regexp_replace(lower(title), '^[123]', ''), '[- ]', '', 'g') AS r, max_by(uid, (score, uid)) AS uid FROM q GROUP BY 1, 2)
    SELECT a.id, m.uid, CASE WHEN m.uid IS NULL THEN 'manual' ELSE 'cache' END AS origin FROM a LEFT JOIN m ON m.cokey = a.cokey AND m.r = regexp_replace(regexp_replace(lower(a.role), '^[123]', ''), '[- ]', '', 'g')""")
def g20(spark, sf_dir):
    q = queue_rows(spark, sf_dir).withColumns({"location": F.lit(""), "description": F.lit("")})
    return ap.enrich(log_rows(spark, sf_dir).select("id", "company", "role"), q).select("id", "uid", "origin")


@query("G21_newly_applied", _G + "SELECT id, applied_on FROM a WHERE status <> 'prepared' AND okey % 6 <> 0")
def g21(spark, sf_dir):
    a = log_rows(spark, sf_dir)
    rows = a.withColumn("applied_on", F.when(F.col("status") != "prepared", F.col("applied_on")))
    first = ap.mark_synced(a.filter("okey % 6 = 0").select("id"), a.filter("okey % 6 = 1").select("id"))
    synced = ap.unmark_synced(first, a.filter("okey % 6 = 1").select("id"))
    return ap.newly_applied(rows, synced).select("id", "applied_on")


@query("P11_keys", _G + """SELECT id, cokey AS company_key, regexp_replace(regexp_replace(lower(role), '^[123]', ''), '[- ]', '', 'g') AS role_key, div AS division_key FROM a""")
def p11(spark, sf_dir):
    role = F.regexp_replace(keys.role_key("role"), " ", "")
    return log_rows(spark, sf_dir).select("id", keys.company_key("company").alias("company_key"), role.alias("role_key"),
                                          keys.division_key("division").alias("division_key"))
