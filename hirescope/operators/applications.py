"""The application log: state from change events, guard rules, queue, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import col
from .market import stamp

# --- fixed values ----------------------------------------------------------------------
STATUSES = (
    "prepared", "applied", "followed-up", "screening", "interview", "offer", "rejected",
    "ghosted", "withdrawn",
)
OPEN_STATUSES = ("applied", "followed-up", "screening", "interview")
RESPONSES = ("screening", "interview", "offer", "rejected")
FOLLOW_UP_DAYS, SAME_ROLE_COOLDOWN_DAYS = 7, 120
MAX_OPEN_PER_COMPANY, MAX_OPEN_PER_BOARD, WEEKLY_MINIMUM = 2, 6, 20
LEVEL_ORDER = {"BLOCK": 0, "WARN": 1, "NOTE": 2}


def fold_log(events: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Current rows from (id, at, kind, message, fields...) change events.

    A field keeps its latest non-null value; a row whose latest event is a
    removal is gone. The dated messages stay rows (see log_history), so an
    application with millions of changes folds like any other.
    """
    at = F.col("at")
    newest = [
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields
    ]
    removed = F.max(F.when(F.col("kind") == "remove", at))
    last = F.max(at)
    return (
        events.groupBy("id")
        .agg(*newest, removed.alias("_removed"), last.alias("_last"),
             F.count_if(F.coalesce("message", F.lit("")) != "").alias("messages"))
        .filter(F.col("_removed").isNull() | (F.col("_removed") < F.col("_last")))
        .drop("_removed", "_last")
    )


def log_history(events: DataFrame) -> DataFrame:
    """The dated messages of every application, one row each."""
    return events.filter(F.coalesce("message", F.lit("")) != "").select("id", "at", "message")


def follow_up_date(applied_on: Column | str) -> Column:
    return F.date_add(col(applied_on), FOLLOW_UP_DAYS)


def funnel(log: DataFrame) -> DataFrame:
    """Applications per status, zeros included."""
    ladder = log.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return ladder.join(log.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n")
    )


def by_source(log: DataFrame) -> DataFrame:
    """Sent and answered per source; a packet never sent does not count."""
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    return (
        log.filter(F.col("status") != "prepared")
        .groupBy(source.alias("source"))
        .agg(F.count("*").alias("sent"), F.count_if(F.col("status").isin(*RESPONSES)).alias("responses"))
        .withColumn("rate", F.col("responses") / F.col("sent"))
    )


def rejections(log: DataFrame) -> DataFrame:
    """Rejections by the furthest stage reached."""
    return (
        log.filter(F.col("status") == "rejected")
        .groupBy(F.coalesce(F.nullif("rejected_stage", F.lit("")), F.lit("unknown")).alias("stage"))
        .agg(F.count("*").alias("n"))
    )


def weekly(log: DataFrame) -> DataFrame:
    """The weekly review: totals, and whether there is enough to read."""
    return log.agg(
        F.count_if(F.col("status") != "prepared").alias("sent"),
        F.count_if(F.col("status").isin(*RESPONSES)).alias("responses"),
    ).withColumn("enough", F.col("sent") >= WEEKLY_MINIMUM)


def follow_ups_due(log: DataFrame, as_of) -> DataFrame:
    """Applied, and the follow-up date has come."""
    return log.filter((F.col("status") == "applied") & (F.col("follow_up_due") <= stamp(as_of).cast("date")))


def unpinged(log: DataFrame, pings: DataFrame, as_of) -> DataFrame:
    """Due follow-ups not yet announced for this due date. ``pings`` is
    (id, follow_up_due); a moved due date may ping again."""
    return follow_ups_due(log, as_of).join(
        pings.select("id", "follow_up_due").distinct(), ["id", "follow_up_due"], "left_anti"
    )


def same_req(queue: DataFrame, log: DataFrame) -> DataFrame:
    """(queue uid, application id) for the identical requisition: same uid,
    else same key, else same url. Three equi-joins and a union."""
    q = queue.select(F.col("uid").alias("q_uid"), F.col("dedupe_key").alias("q_key"), F.col("url").alias("q_url"))
    a = log.select("id", F.col("uid").alias("a_uid"), F.col("dedupe_key").alias("a_key"), F.col("url").alias("a_url"))
    pairs = None
    for left, right in (("q_uid", "a_uid"), ("q_key", "a_key"), ("q_url", "a_url")):
        hit = q.filter(F.coalesce(left, F.lit("")) != "").join(a, F.col(left) == F.col(right)).select("q_uid", "id")
        pairs = hit if pairs is None else pairs.union(hit)
    return pairs.distinct()


def same_role(queue: DataFrame, log: DataFrame) -> DataFrame:
    """(queue uid, application id) at the same company in the same role."""
    q = queue.select(F.col("uid").alias("q_uid"), keys.company_key("company").alias("_c"), keys.role_key("title").alias("_r"))
    a = log.select("id", keys.company_key("company").alias("_c"), keys.role_key("role").alias("_r"))
    return q.join(a, ["_c", "_r"]).select("q_uid", "id")


def open_at(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status").isin(*OPEN_STATUSES))


def find(log: DataFrame, needle: str) -> DataFrame:
    low = needle.lower()
    return log.filter(
        F.lower("id").contains(low) | F.lower("company").contains(low) | F.lower("role").contains(low)
    )


def hidden_uids(log: DataFrame) -> DataFrame:
    """Uids the queue stops showing: all but unopened automatic packets."""
    auto = F.coalesce("auto", F.lit(False)) & (F.col("status") == "prepared")
    return log.filter((F.coalesce("uid", F.lit("")) != "") & ~auto).select("uid").distinct()


def auto_prepared(log: DataFrame) -> DataFrame:
    return log.filter(
        (F.coalesce("uid", F.lit("")) != "") & F.coalesce("auto", F.lit(False)) & (F.col("status") == "prepared")
    )


def guard(queue: DataFrame, log: DataFrame, as_of) -> DataFrame:
    """Every rule for a whole queue: (uid, level, rule, subject, n).

    Each rule is an equi-join on a key; the concurrency counts are aggregated
    per company and division before they meet the queue, so a company with a
    million applications joins as one row per division.
    """
    today = stamp(as_of).cast("date")
    log = log.withColumn("_on", F.coalesce("applied_on", "prepared_on")).withColumn(
        "_ckey", keys.company_key("company")
    )
    pairs = same_req(queue, log)
    prior = pairs.join(log.select("id", "status", "_on"), "id")
    requisition = prior.select(
        F.col("q_uid").alias("uid"),
        F.when(F.col("status") == "prepared", "WARN").otherwise("BLOCK").alias("level"),
        F.lit("same-req").alias("rule"), F.col("id").alias("subject"),
        F.datediff(today, "_on").cast("long").alias("n"),
    )
    cool = (
        same_role(queue, log)
        .join(pairs, ["q_uid", "id"], "left_anti")
        .join(log.select("id", "status", "_on"), "id")
        .withColumn("_days", F.datediff(today, "_on"))
        .filter((F.col("status") != "prepared") & (F.col("_days") < SAME_ROLE_COOLDOWN_DAYS))
        .select(
            F.col("q_uid").alias("uid"),
            F.when(F.col("status") == "rejected", "BLOCK").otherwise("WARN").alias("level"),
            F.lit("role-cooldown").alias("rule"), F.col("id").alias("subject"),
            F.col("_days").cast("long").alias("n"),
        )
    )
    concurrency, board = _concurrency(queue, log, pairs)
    flagged = F.exists(
        F.coalesce("flags", F.array().cast("array<string>")),
        lambda f: f.startswith("agency") | (f == "staffing-agency"),
    )
    by_company = log.groupBy("_ckey").agg(
        F.count_if(F.coalesce("agency", F.lit("")) == "").alias("_direct"),
        F.count_if(F.coalesce("agency", F.lit("")) != "").alias("_via"),
    )
    seen = queue.select("uid", keys.company_key("company").alias("_ckey"), flagged.alias("_agency")).join(
        by_company, "_ckey", "left"
    )
    agency = seen.filter("_agency").select(
        "uid", F.when(F.coalesce("_direct", F.lit(0)) > 0, "BLOCK").otherwise("WARN").alias("level"),
        F.lit("agency").alias("rule"), F.lit("").alias("subject"),
        F.coalesce("_direct", F.lit(0)).cast("long").alias("n"),
    )
    history = seen.filter(~F.col("_agency") & (F.col("_via") > 0)).select(
        "uid", F.lit("NOTE").alias("level"), F.lit("agency-history").alias("rule"),
        F.lit("").alias("subject"), F.col("_via").cast("long").alias("n"),
    )
    out = requisition
    for part in (cool, concurrency, board, agency, history):
        out = out.unionByName(part)
    return out


def _concurrency(queue: DataFrame, log: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open applications that could be at the employer of each queued posting.

    Rows of unknown division could be anywhere, so they always count; of the
    named divisions either the posting's own counts, or, when it names none,
    the largest one.
    """
    live = open_at(log).withColumn("_dkey", keys.division_key("division")).withColumn(
        "_named", F.coalesce("division", F.lit("")) != ""
    )
    per = live.groupBy("_ckey", "_named", "_dkey").agg(F.count("*").alias("n"))
    q = queue.select(
        "uid", keys.company_key("company").alias("_ckey"),
        (F.coalesce("division", F.lit("")) != "").alias("_qnamed"),
        keys.division_key("division").alias("_qdiv"),
    )
    # Applications for the posting itself do not count against it.
    own = (
        pairs.withColumnRenamed("q_uid", "uid").join(live.select("id", "_ckey", "_named", "_dkey"), "id")
        .groupBy("uid", "_ckey", "_named", "_dkey").agg(F.count("*").alias("_own"))
    )
    counted = (
        q.join(per, "_ckey")
        .join(own, ["uid", "_ckey", "_named", "_dkey"], "left")
        .withColumn("n", F.col("n") - F.coalesce("_own", F.lit(0)))
        .filter(F.col("n") > 0)
    )
    mine = F.col("_named") & (F.col("_dkey") == F.col("_qdiv"))
    sums = counted.groupBy("uid", "_qnamed").agg(
        F.sum("n").alias("_board"),
        F.coalesce(F.sum(F.when(~F.col("_named"), F.col("n"))), F.lit(0)).alias("_unknown"),
        F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("_mine"),
        F.coalesce(F.max(F.when(F.col("_named"), F.col("n"))), F.lit(0)).alias("_biggest"),
        F.count_if("_named").alias("_names"),
    )
    open_now = F.col("_unknown") + F.when(F.col("_qnamed"), F.col("_mine")).otherwise(F.col("_biggest"))
    sums = sums.withColumn("n", open_now.cast("long"))
    concurrency = sums.filter(F.col("n") > 0).select(
        "uid", F.when(F.col("n") >= MAX_OPEN_PER_COMPANY, "BLOCK").otherwise("NOTE").alias("level"),
        F.lit("concurrency").alias("rule"), F.lit("").alias("subject"), "n",
    )
    board = sums.filter(
        (F.col("_qnamed") | (F.col("_names") > 0)) & (F.col("_board") >= MAX_OPEN_PER_BOARD)
    ).select(
        "uid", F.lit("WARN").alias("level"), F.lit("board-concurrency").alias("rule"),
        F.lit("").alias("subject"), F.col("_board").cast("long").alias("n"),
    )
    return concurrency, board


def blocked(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("level") == "BLOCK")


def severity(checks: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for kv in LEVEL_ORDER.items() for x in kv])
    return checks.orderBy("uid", F.element_at(order, F.col("level")), "rule", "subject")


def apply_queue(
    candidates: DataFrame, hidden: DataFrame, min_score: int = 0, limit: int = 40, found_on: str = ""
) -> DataFrame:
    """The queue, best first; the limit is the page."""
    rows = candidates.filter(F.col("score") >= min_score).join(hidden.select("uid"), "uid", "left_anti")
    if found_on:
        rows = rows.filter(F.col("first_seen").cast("date") == F.lit(found_on).cast("date"))
    return rows.orderBy(F.desc("score"), F.coalesce("age_days", F.lit(99)), "uid").limit(limit)


def queue_day(candidates: DataFrame, day: str) -> DataFrame:
    """The day itself when it found anything, else the newest one before."""
    d = F.lit(day).cast("date")
    seen = F.col("first_seen").cast("date")
    return candidates.agg(
        F.coalesce(F.max(F.when(seen == d, seen)), F.max(F.when(seen < d, seen))).alias("day")
    )


def enrich(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tracker rows with the matching candidate, best score first, else bare."""
    match = candidates.select(
        keys.company_key("company").alias("_c"), keys.role_key("title").alias("_r"),
        F.struct("score", "uid", "url", "location", "description").alias("_m"),
    ).groupBy("_c", "_r").agg(F.max("_m").alias("_m"))
    keyed = rows.withColumn("_c", keys.company_key("company")).withColumn("_r", keys.role_key("role"))
    return keyed.join(match, ["_c", "_r"], "left").select(
        *rows.columns, F.col("_m.uid").alias("uid"), F.coalesce("_m.url", F.lit("")).alias("url"),
        F.coalesce("_m.location", F.lit("")).alias("location"),
        F.coalesce("_m.description", F.lit("")).alias("description"),
        F.when(F.col("_m").isNotNull(), "cache").otherwise("manual").alias("origin"),
    )


def newly_applied(rows: DataFrame, synced: DataFrame) -> DataFrame:
    """Rows with an applied date whose id was never synced."""
    return rows.filter(F.col("applied_on").isNotNull()).join(synced.select("id").distinct(), "id", "left_anti")


def mark_synced(synced: DataFrame, ids: DataFrame) -> DataFrame:
    return synced.select("id").union(ids.select("id")).distinct()


def unmark_synced(synced: DataFrame, ids: DataFrame) -> DataFrame:
    return synced.join(ids.select("id").distinct(), "id", "left_anti")
