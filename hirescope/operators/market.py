"""Market context: each posting against the postings of its own family and place."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.places import place_label, region
from ..functions.text import col, squash, zero_to_null
from ..session import written
from .ranks import medians, middle_counts, midrank, running_counts, value_counts

# --- fixed values ------------------------------------------------------------
MIN_PEERS = 8
CONFIDENT_PEERS = 25
HOURS_PER_YEAR = 2080
HOURLY_BELOW = 1000
WEIGHTS = {"pay": 0.40, "crowd": 0.25, "reach": 0.15, "fresh": 0.20}

GROUP = ("job_family", "place")


def annual(c: Column | str) -> Column:
    """A salary figure as an annual number: rates under 1,000 are hourly."""
    v = col(c).cast("double")
    return F.when(v > 0, F.when(v < HOURLY_BELOW, v * HOURS_PER_YEAR).otherwise(v))


def midpoint(low: Column, high: Column) -> Column:
    return F.coalesce(low, high) / 2 + F.coalesce(high, low) / 2


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Elapsed days, null when either is unknown."""
    later, earlier = later.cast("timestamp"), earlier.cast("timestamp")
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)


def stamp(value: str | dt.datetime | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def latest_sightings(
    df: DataFrame,
    order: str = "run_ts",
    keep: Sequence[str] | None = None,
    sources: bool = False,
) -> DataFrame:
    """One row per company and title, case-blind; the latest sighting wins.

    A plain max over a struct: partial aggregation keeps one row per task and
    key, so a posting sighted a billion times shuffles once per task. Equal
    times are decided by the remaining columns, so the answer is repeatable.
    ``sources`` adds ``also_on``, every other board that carried it.
    """
    cols = [c for c in (keep or df.columns) if c != order]
    key = F.lower(F.concat(F.col("company"), F.lit("|"), F.col("title")))
    aggs = [F.max(F.struct(order, *cols)).alias("row")]
    if sources:
        aggs.append(F.collect_set("source").alias("boards"))
    rows = (
        df.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("company", F.lit("")) != ""))
        .groupBy(key.alias("posting_key"))
        .agg(*aggs)
    )
    out = ["posting_key", "row.*"]
    if sources:
        out.append(
            F.sort_array(F.array_except("boards", F.array("row.source"))).alias("also_on")
        )
    return rows.select(*out)


def with_market_columns(df: DataFrame, as_of) -> DataFrame:
    """The columns every market operator reads."""
    if "place" not in df.columns:
        df = df.withColumn("place", region("location", "remote"))
    reach = (
        F.lit(1) + F.coalesce(F.size("also_on"), F.lit(0)) if "also_on" in df.columns else F.lit(1)
    )
    age = F.when(
        F.col("posted_at").isNotNull(),
        F.greatest(F.lit(0.0), elapsed_days(stamp(as_of), F.col("posted_at").cast("timestamp"))),
    )
    return (
        df.withColumn("job_family", F.coalesce(F.nullif("job_family", F.lit("")), F.lit("other")))
        .withColumn("low", annual("salary_min"))
        .withColumn("high", annual("salary_max"))
        .withColumn("pay", midpoint(F.col("low"), F.col("high")))
        .withColumn("age", age)
        .withColumn("reach", reach)
        .withColumn("role", keys.market_role("title"))
    )


INDEX = ("low", "high", "pay", "age", "reach", "role")


def market_index(peers: DataFrame, as_of, key: str = "posting_key") -> DataFrame:
    """The peers' market columns as a written table. Every report below reads
    it several times over; a frame that is an index already passes through."""
    if set(INDEX) <= set(peers.columns):
        return peers
    keep = [c for c in (key, "company", "title", "source") if c in peers.columns]
    return written(with_market_columns(peers, as_of).select(*keep, *GROUP, *INDEX), "market-index")


def peer_groups(peers: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """The size and shape of each peer group. ``peers`` has market columns.

    Distinct employers are counted in two steps so a giant group spreads over
    its employers instead of carrying one set through one task.
    """
    per_employer = peers.groupBy(*group, F.lower("company").alias("employer")).agg(
        F.count("*").alias("n"),
        F.count("pay").alias("n_pay"),
        F.count("low").alias("n_low"),
        F.count("high").alias("n_high"),
        F.count("age").alias("n_age"),
        F.sum("reach").alias("reach_sum"),
        F.min("reach").alias("reach_min"),
        F.max("reach").alias("reach_max"),
    )
    return per_employer.groupBy(*group).agg(
        F.sum("n").alias("peers"),
        F.count("*").alias("employers"),
        *[F.sum(c).alias(c) for c in ("n_pay", "n_low", "n_high", "n_age", "reach_sum")],
        F.min("reach_min").alias("reach_min"),
        F.max("reach_max").alias("reach_max"),
    )


def role_counts(peers: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Openings per role inside each peer group."""
    return peers.filter(F.col("role") != "").groupBy(*group, "role").agg(
        F.count("*").alias("openings")
    )


def pooled_bands(peers: DataFrame, at_least: int = 1) -> DataFrame:
    """Counts and exact medians of published lows and highs at four levels:
    family and place, family, place, and everything.

    The bands are folded to value counts first; the grouping sets then expand
    that small table, not the postings. A side with fewer than ``at_least`` figures
    counts as none.
    """
    sides = peers.select(
        *GROUP,
        F.explode(
            F.array(
                F.struct(F.lit("low").alias("side"), F.col("low").alias("amount")),
                F.struct(F.lit("high").alias("side"), F.col("high").alias("amount")),
            )
        ).alias("s"),
    ).select(*GROUP, "s.*")
    counted = value_counts(sides, [*GROUP, "side"], "amount")
    levels = counted.groupingSets(
        [
            ["job_family", "place", "side", "amount"],
            ["job_family", "side", "amount"],
            ["place", "side", "amount"],
            ["side", "amount"],
        ],
        "job_family",
        "place",
        "side",
        "amount",
    ).agg(
        F.sum("n").alias("n"),
        F.grouping("job_family").alias("any_family"),
        F.grouping("place").alias("any_place"),
    )
    group = ["any_family", "any_place", "job_family", "place", "side"]
    # Read twice, for the buckets' totals and for the middle ones: written once.
    levels = written(levels, "levels")
    ranked = middle_counts(levels, group, "amount", F.floor(F.col("amount") / 1000), at_least)
    mid = medians(ranked, group, "amount")
    out = group[:-1]
    return mid.groupBy(*out).agg(
        *[
            F.coalesce(F.max(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}")
            for s in ("low", "high")
        ],
        *[
            F.max(F.when(F.col("side") == s, F.col("median"))).alias(f"median_{s}")
            for s in ("low", "high")
        ],
    )


def _long_factors(df: DataFrame, id_cols: Sequence[str], crowd: bool) -> DataFrame:
    names = ["pay", "reach", "age"] + (["crowd"] if crowd else [])
    labels = {"age": "fresh"}
    return (
        df.select(
            *id_cols,
            *GROUP,
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(labels.get(n, n)).alias("factor"),
                            F.col(n).cast("double").alias("value"),
                        )
                        for n in names
                    ]
                )
            ).alias("f"),
        )
        .select(*id_cols, *GROUP, "f.*")
        .filter(F.col("value").isNotNull())
    )


def factor_ranks(candidates: DataFrame, peers: DataFrame) -> DataFrame:
    """For every (group, factor, value) a candidate can hold, where it
    stands among the peers. One pass for all four factors."""
    roles = role_counts(peers)
    peer_values = _long_factors(peers, [], crowd=False).unionByName(
        roles.select(
            *GROUP, F.lit("crowd").alias("factor"), F.col("openings").cast("double").alias("value")
        )
    )
    probes = _long_factors(candidates, [], crowd=True)
    group = [*GROUP, "factor"]
    # Read twice, for the buckets' totals and for the ranks: written once.
    counts = written(value_counts(peer_values, group, "value", probes), "value-counts")
    # Pay runs to six figures, ages and counts to hundreds or thousands.
    bucket = F.when(F.col("factor") == "pay", F.floor(F.col("value") / 1000)).otherwise(
        F.floor(F.col("value"))
    )
    ranked = running_counts(counts, group, "value", bucket)
    return ranked.withColumn("percentile", midrank(F.col("below"), F.col("n"), F.col("total")))


def assess(candidates: DataFrame, peers: DataFrame, as_of, key: str = "posting_key") -> DataFrame:
    """Each candidate's standing, one row per candidate with support.

    Every factor points the same way: higher is better for the applicant, so
    competition, exposure and freshness are turned round. A group under eight
    peers answers nothing; a missing factor gives its weight to the others.
    """
    same = candidates is peers
    peers = market_index(peers, as_of, key)
    cand = peers if same else (
        candidates if set(INDEX) <= set(candidates.columns) else with_market_columns(candidates, as_of)
    )
    # Groups without support answer nothing: their postings are left out before any is ranked.
    groups = written(peer_groups(peers).filter(F.col("peers") >= MIN_PEERS), "groups")
    supported = groups.select(*GROUP)
    peers = written(peers.join(supported, list(GROUP), "left_semi"), "supported")
    cand = peers if same else cand.join(supported, list(GROUP), "left_semi")
    roles = role_counts(peers)
    cand = (
        cand.select(key, *GROUP, "pay", "age", "reach", "role")
        .join(roles, [*GROUP, "role"], "left")
        .withColumn(
            "crowd", F.when(F.col("role") != "", F.coalesce(F.col("openings"), F.lit(1)))
        )
        .drop("openings")
    )
    ranks = factor_ranks(cand, peers)
    usable = (
        F.when(F.col("factor") == "pay", F.col("n_pay") >= MIN_PEERS)
        .when(F.col("factor") == "fresh", F.col("n_age") >= MIN_PEERS)
        .when(F.col("factor") == "reach", F.col("reach_min") != F.col("reach_max"))
        .otherwise(F.lit(True))
    )
    oriented = F.when(F.col("factor") == "pay", F.col("percentile")).otherwise(
        F.lit(100.0) - F.col("percentile")
    )
    scored = (
        _long_factors(cand, [key], crowd=True)
        .join(ranks.select(*GROUP, "factor", "value", "percentile"), [*GROUP, "factor", "value"])
        .join(groups, list(GROUP))
        .filter(usable)
        .withColumn("percentile", oriented)
    )
    wide = scored.groupBy(key).agg(
        F.first("job_family").alias("job_family"),
        F.first("place").alias("place"),
        F.first("peers").alias("peers"),
        F.first("employers").alias("employers"),
        *[
            F.max(F.when(F.col("factor") == f, F.col("percentile"))).alias(f"p_{f}")
            for f in WEIGHTS
        ],
    )
    weighed = {
        f: F.when(F.col(f"p_{f}").isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        for f, w in WEIGHTS.items()
    }
    total = weighed["pay"] + weighed["crowd"] + weighed["reach"] + weighed["fresh"]
    points = [F.coalesce(F.col(f"p_{f}"), F.lit(0.0)) * F.lit(w) for f, w in WEIGHTS.items()]
    composite = (points[0] + points[1] + points[2] + points[3]) / total
    return (
        wide.withColumn("total_weight", total)
        .withColumn("composite", composite)
        .withColumn("delta", F.bround(F.col("composite") - 50).cast("int"))
        .select(
            key,
            "job_family",
            "place",
            "peers",
            "employers",
            "delta",
            F.when(F.col("delta") >= 3, "up").when(F.col("delta") <= -3, "down")
            .otherwise("flat").alias("direction"),
            F.bround("composite").cast("int").alias("percentile"),
            (F.col("peers") >= CONFIDENT_PEERS).alias("confident"),
            *[F.bround(f"p_{f}").cast("int").alias(f"{f}_percentile") for f in WEIGHTS],
            *[
                F.when(
                    F.col(f"p_{f}").isNotNull(),
                    F.bround(F.lit(100.0) * F.lit(w) / F.col("total_weight")).cast("int"),
                ).alias(f"{f}_share")
                for f, w in WEIGHTS.items()
            ],
        )
    )


def estimate_salary(candidates: DataFrame, peers: DataFrame, as_of, bands: DataFrame | None = None) -> DataFrame:
    """A band for postings that published none, from the narrowest pool
    with eight lows and eight highs whose medians are in order. ``bands`` are pooled
    ones made before, such as ``bands.sketched_bands``; else the peers' own."""
    same = candidates is peers
    peers = market_index(peers, as_of)
    # One row per pool, read once per rung: written, its size is known and the
    # rungs join by broadcast only while it is small.
    bands = written(
        (pooled_bands(peers, MIN_PEERS) if bands is None else bands).filter(
            (F.col("n_low") >= MIN_PEERS)
            & (F.col("n_high") >= MIN_PEERS)
            & (F.col("median_high") >= F.col("median_low"))
        ),
        "bands",
    )
    cand = peers if same else (
        candidates if set(INDEX) <= set(candidates.columns) else with_market_columns(candidates, as_of)
    )
    cand = cand.filter(F.col("low").isNull() & F.col("high").isNull())
    rungs = (
        ("cell", 0, 0, ["job_family", "place"]),
        ("family", 0, 1, ["job_family"]),
        ("place", 1, 0, ["place"]),
        ("all", 1, 1, []),
    )
    for name, any_family, any_place, on in rungs:
        pool = bands.filter(
            (F.col("any_family") == any_family) & (F.col("any_place") == any_place)
        ).select(*on, F.struct(F.col("median_low"), F.col("median_high"), F.col("n_low")).alias(f"_{name}"))
        cand = cand.join(pool, on, "left") if on else cand.join(pool, F.lit(True), "left")
    pick = F.coalesce("_cell", "_family", "_place", "_all")
    basis = (
        F.when(F.col("_cell").isNotNull(), F.lit("cell"))
        .when(F.col("_family").isNotNull(), F.lit("family"))
        .when(F.col("_place").isNotNull(), F.lit("place"))
        .otherwise(F.lit("all"))
    )
    family, place = F.col("job_family"), place_label(F.col("place"))
    described = (
        F.when(F.col("basis") == "cell", F.concat(family, F.lit(" postings in "), place))
        .when(F.col("basis") == "family", F.concat(family, F.lit(" postings everywhere")))
        .when(
            F.col("basis") == "place",
            F.concat(F.lit("postings in "), place, F.lit(", across every job family")),
        )
        .otherwise(F.lit("postings in the whole series, across every family and place"))
    )
    return (
        cand.withColumn("_pick", pick)
        .filter(F.col("_pick").isNotNull())
        .withColumn("basis", basis)
        .withColumn("est_min", F.bround("_pick.median_low").cast("long"))
        .withColumn("est_max", F.bround("_pick.median_high").cast("long"))
        .withColumn(
            "basis_text",
            F.concat(
                F.lit("Median of "), F.col("_pick.n_low").cast("string"), F.lit(" "), described,
                F.lit(" that published a band. The employer did not state one."),
            ),
        )
        .drop("_pick", "_cell", "_family", "_place", "_all")
    )


def market_context(current: DataFrame, peers: DataFrame, as_of, key: str = "posting_key") -> DataFrame:
    """Standing and salary estimate joined to the current list."""
    same = current is peers
    peers = market_index(peers, as_of, key)
    current = peers if same else current
    standing = assess(current, peers, as_of, key).select(
        key, "delta", "direction", "peers", "confident"
    )
    estimate = estimate_salary(current, peers, as_of).select(key, "est_min", "est_max", "basis")
    return (
        current.select(key, "company", "title")
        .join(standing, key, "left")
        .join(estimate, key, "left")
        .filter(F.col("delta").isNotNull() | F.col("est_min").isNotNull())
    )


def index_summary(sightings: DataFrame, peers: DataFrame, file_col: str) -> DataFrame:
    """How many snapshot files, postings and groups the index is made of."""
    files = sightings.select(file_col).distinct().agg(F.count("*").alias("files"))
    groups = (
        peers.groupBy(*GROUP).agg(F.count("*").alias("n"))
        .agg(F.sum("n").alias("postings"), F.count("*").alias("groups"))
    )
    return files.join(groups, F.lit(True))


# -- archive ------------------------------------------------------------------


def live_days(first: Column | str, last: Column | str) -> Column:
    return F.datediff(col(last), col(first))


def archive_search(
    archive: DataFrame,
    text: str = "",
    min_score: int = 0,
    since: str = "",
    limit: int = 200,
    offset: int = 0,
) -> DataFrame:
    """Every word in title or company; newest and best first; one page.

    The page itself is the feature (at most 500 rows); ``matched`` and
    ``total`` count everything.
    """
    found = _archive_match(archive, text, min_score, since)
    counts = archive.agg(
        F.count("*").alias("total"),
        F.count_if(_archive_test(text, min_score, since)).alias("matched"),
    )
    page = (
        found.orderBy(F.desc("last_seen"), F.desc("score"), "uid")
        .offset(offset)
        .limit(max(1, min(limit, 500)))
        .withColumn("live_days", live_days("first_seen", "last_seen"))
    )
    return page.join(counts, F.lit(True))


def _archive_test(text: str, min_score: int, since: str) -> Column:
    test = F.lit(True)
    if min_score:
        test = test & (F.col("score") >= min_score)
    if since:
        test = test & (F.col("last_seen") >= F.lit(since).cast("date"))
    hay = F.lower(F.concat_ws(" ", "title", "company"))
    for word in text.lower().split():
        test = test & hay.contains(word)
    return test


def _archive_match(archive: DataFrame, text: str, min_score: int, since: str) -> DataFrame:
    return archive.filter(_archive_test(text, min_score, since))


def archive_summary(archive: DataFrame) -> DataFrame:
    """The numbers above the archive table."""
    until = archive.agg(F.max("last_seen")).scalar()
    per_company = archive.groupBy(F.lower("company").alias("c")).agg(
        F.count("*").alias("n"),
        F.min("first_seen").alias("since"),
        F.max("last_seen").alias("until"),
        F.count_if(F.col("score") > 0).alias("scored"),
        F.sum("times_seen").alias("readings"),
        F.max(F.struct("times_seen", "uid", "company", "title")).alias("top"),
    )
    main = per_company.agg(
        F.sum("n").alias("total"),
        F.count_if(F.col("c") != "").alias("companies"),
        F.min("since").alias("since"),
        F.max("until").alias("until"),
        F.sum("scored").alias("scored"),
        F.sum("readings").alias("readings"),
        F.max("top").alias("top"),
    )
    marked = archive.select(
        (F.col("last_seen") == until).alias("read"), (F.col("first_seen") == until).alias("new")
    )
    last = marked.agg(F.count_if("read").alias("last_read"), F.count_if("new").alias("last_new"))
    return main.join(last, F.lit(True)).select(
        "total", "companies", "since", "until", "scored", "readings", "last_read", "last_new",
        F.col("top.company").alias("most_read_company"),
        F.col("top.title").alias("most_read_title"),
        F.col("top.times_seen").alias("most_read_times"),
    )


def company_board(archive: DataFrame, limit: int | None = 60) -> DataFrame:
    """A10: who posts, and how well their postings score."""
    board = (
        archive.withColumn("company", squash("company"))
        .filter(F.col("company") != "")
        .groupBy(F.lower("company").alias("company_key"))
        .agg(
            F.min("company").alias("company"),
            F.count("*").alias("postings"),
            F.max("score").alias("best"),
            F.count_if(F.col("score") > 0).alias("scored"),
        )
        .orderBy(F.desc("scored"), F.desc("postings"), "company_key")
    )
    return board.limit(limit) if limit else board


# -- the list -------------------------------------------------------------------

TIERS = ("A", "B", "C", "D", "F")


def tier_counts(rows: DataFrame) -> DataFrame:
    """Postings per tier, zeros included."""
    spark = rows.sparkSession
    ladder = spark.createDataFrame([(t,) for t in TIERS], "tier string")
    return (
        ladder.join(rows.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left")
        .select("tier", F.coalesce("n", F.lit(0)).alias("n"))
    )


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def effective_floor(rows: DataFrame, floor: int, cap: int) -> DataFrame:
    """The score the list really starts at, and whether the cap raised it."""
    return rows.agg(F.count("*").alias("rows"), F.min("score").alias("lowest")).select(
        "rows",
        F.lit(floor).alias("configured"),
        F.coalesce("lowest", F.lit(floor)).alias("effective"),
        ((F.col("rows") >= cap) & (F.coalesce("lowest", F.lit(floor)) > floor)).alias("capped"),
    )


def list_filter(
    rows: DataFrame,
    *,
    min_score: int | None = None,
    max_score: int | None = None,
    hide_applied: bool = False,
    hide_prepared: bool = False,
    remote_only: bool = False,
    starred_only: bool = False,
    has_pay: bool = False,
    market_up: bool = False,
    tier: str = "",
    source: str = "",
    posted_within: int | None = None,
    text: str = "",
) -> DataFrame:
    """A saved view over the annotated list. Inverted bounds are swapped."""
    lo, hi = min_score, max_score
    if lo is not None and hi is not None and lo > hi:
        lo, hi = hi, lo
    tests: list[Column] = []
    if lo is not None:
        tests.append(F.col("score") >= lo)
    if hi is not None:
        tests.append(F.col("score") <= hi)
    if hide_applied:
        tests.append(~F.col("applied"))
    if hide_prepared:
        tests.append(~F.col("prepared"))
    if remote_only:
        tests.append(F.col("remote"))
    if starred_only:
        tests.append(F.col("starred"))
    if has_pay:
        tests.append(zero_to_null("salary_min").isNotNull() | zero_to_null("salary_max").isNotNull())
    if market_up:
        tests.append(F.col("direction") == "up")
    if tier:
        tests.append(F.col("tier") == tier)
    if source:
        tests.append(F.col("source") == source)
    if posted_within is not None:
        tests.append(F.col("age_days").isNotNull() & (F.col("age_days") <= posted_within))
    if text:
        tests.append(
            F.lower(F.concat_ws(" ", "title", "company", "location")).contains(text.lower())
        )
    for t in tests:
        rows = rows.filter(t)
    return rows


def sort_rows(rows: DataFrame, by: str, descending: bool = False, tie: Sequence[str] = ("uid",)) -> DataFrame:
    """Blanks last both ways; salary falls back to the estimate."""
    if by == "salary":
        key = F.coalesce(zero_to_null("salary_min"), zero_to_null("salary_max"), F.col("est_min"))
    elif by == "market":
        key = F.col("delta")
    else:
        key = F.col(by)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return rows.orderBy(order, *tie)


def day_bucket(age_days: Column | str) -> Column:
    """The timeline heading of a calendar age."""
    a = col(age_days)
    return (
        F.when(a.isNull(), F.lit("Date unknown"))
        .when(a <= 0, F.lit("Today"))
        .when(a == 1, F.lit("Yesterday"))
        .when(a <= 7, F.concat(a.cast("string"), F.lit(" days ago")))
        .when(a <= 14, F.lit("Last week"))
        .otherwise(F.lit("Older"))
    )


SENT = (
    "applied", "followed-up", "screening", "interview", "offer", "rejected", "ghosted", "withdrawn",
)


def annotate(rows: DataFrame, applications: DataFrame, starred: DataFrame) -> DataFrame:
    """What the application log and the stars say about each posting."""
    log = applications.filter(F.coalesce("uid", F.lit("")) != "").groupBy("uid").agg(
        F.max(F.struct("seq", "id", "status")).alias("_a")
    )
    marks = starred.select("uid").distinct().withColumn("_star", F.lit(True))
    status = F.coalesce(F.nullif("_a.status", F.lit("")), F.lit("prepared"))
    return (
        rows.join(log, "uid", "left")
        .join(marks, "uid", "left")
        .withColumn("starred", F.coalesce("_star", F.lit(False)))
        .withColumn("applied", F.col("_a").isNotNull() & status.isin(*SENT))
        .withColumn("prepared", F.col("_a").isNotNull() & (status == "prepared"))
        .withColumn("application", F.coalesce("_a.id", F.lit("")))
        .withColumn("app_status", F.when(F.col("_a").isNotNull(), status).otherwise(F.lit("")))
        .drop("_a", "_star")
    )


def fold_stars(events: DataFrame) -> DataFrame:
    """Current stars from (uid, at, on, title, company, url, source) events.

    The star date is the first ``on`` since the last ``off``; the label is the
    latest one given. Two aggregates, no per-star history held in memory.
    """
    off = events.filter(~F.col("on")).groupBy("uid").agg(F.max("at").alias("_off"))
    live = events.filter("on").join(off, "uid", "left").filter(
        F.col("_off").isNull() | (F.col("at") > F.col("_off"))
    )
    label = F.struct("at", "title", "company", "url", "source")
    return (
        live.groupBy("uid")
        .agg(F.min("at").alias("starred_at"), F.max(label).alias("l"))
        .select("uid", "starred_at", "l.title", "l.company", "l.url", "l.source")
    )


def stars_gone(stars: DataFrame, listed: DataFrame) -> DataFrame:
    """Starred postings no longer on the list."""
    return stars.join(listed.select("uid").distinct(), "uid", "left_anti")
