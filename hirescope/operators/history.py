"""Duplicates within a run, memory across runs, and the tables kept from both."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import mentions, squash
from .market import elapsed_days, stamp

# --- fixed values ------------------------------------------------------------
SOURCE_PRIORITY = {
    "workday": 0, "greenhouse": 0, "lever": 0, "ashby": 0,
    "smartrecruiters": 1, "workable": 1, "recruitee": 1,
    "usajobs": 2, "adzuna": 3, "hiringcafe": 3,
    "remoteok": 4, "remotive": 4, "himalayas": 4, "weworkremotely": 4,
    "themuse": 4, "jobicy": 4, "hackernews": 5,
}
UNKNOWN_PRIORITY = 9
OWN_BOARDS = (
    "workday", "greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee",
)
REPOST_MIN_COMPANIES = 4
REPOST_MIN_AGENCY_SHARE = 0.25
MIN_SCORE_TO_REPORT = 45
GHOST_DAYS, GHOST_TIMES = 45, 20
SEEN_RETENTION_DAYS = 120
RETENTION_DAYS = 30
MAX_ENTRIES = 1500
DETAIL_MIN_SCORE, MAX_DETAILS, MAX_PER_HOST, MAX_PARTIALS, SWEEP_BUDGET = 30, 250, 60, 120, 20
LEARN_MIN_SCORE, LEARN_MAX_NEW, LEARN_RETRY_DAYS = 75, 5, 30
SEED_MAX, SEED_MIN_SIGHTINGS = 300, 2


def source_priority(source: Column | str = "source") -> Column:
    c = F.col(source) if isinstance(source, str) else source
    out = F.when(F.lit(False), F.lit(UNKNOWN_PRIORITY))
    for level in sorted(set(SOURCE_PRIORITY.values())):
        out = out.when(
            c.isin(*[s for s, p in SOURCE_PRIORITY.items() if p == level]), F.lit(level)
        )
    return out.otherwise(F.lit(UNKNOWN_PRIORITY))


def collapse(postings: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row per dedupe key, the best source's copy.

    A copy takes over only when its source ranks strictly better than every
    earlier copy, so at most one copy per priority level matters: the first of
    its level, arriving before the first of any better level. Those are found
    by a partial aggregate per (key, priority), which turns a key with a
    billion copies into seven rows before anything is compared.
    """
    return settled(first_copies(postings, arrival), arrival)


def first_copies(postings: DataFrame, arrival: str = "arrival") -> DataFrame:
    """dedupe_key, priority (``_p``), its first row, boards and copies: all that
    the choice needs, and what parts of a table are merged by."""
    rows = postings
    if "dedupe_key" not in rows.columns:
        rows = rows.withColumn("dedupe_key", keys.dedupe_key())
    rows = rows.filter(F.col("dedupe_key") != "").withColumn("_p", source_priority())
    fields = [c for c in rows.columns if c not in ("dedupe_key", "_p", arrival)]
    return rows.groupBy("dedupe_key", "_p").agg(
        F.min(F.struct(arrival, *fields)).alias("row"),
        F.collect_set("source").alias("boards"),
        F.count("*").alias("copies"),
    )


def merge_copies(state: DataFrame, run: DataFrame) -> DataFrame:
    """H01 incrementally: first copies of two parts that share no row, in either order."""
    return state.unionByName(run).groupBy("dedupe_key", "_p").agg(
        F.min("row").alias("row"),
        F.array_distinct(F.flatten(F.collect_list("boards"))).alias("boards"),
        F.sum("copies").alias("copies"),
    )


def settled(firsts: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The best source's copy of each key, from its first copies."""
    fields = [c for c in firsts.schema["row"].dataType.names if c != arrival]
    # At most seven rows per key from here on.
    by_key = Window.partitionBy("dedupe_key")
    better = by_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    chain = (
        firsts.withColumn("_best_before", F.min(F.col(f"row.{arrival}")).over(better))
        .withColumn("copies", F.sum("copies").over(by_key))
        .withColumn(
            "boards", F.array_distinct(F.flatten(F.collect_list("boards").over(by_key)))
        )
        .filter(
            F.col("_best_before").isNull() | (F.col(f"row.{arrival}") < F.col("_best_before"))
        )
    )
    # Arrival order inside the chain is descending priority value.
    body = F.struct(
        F.length(F.coalesce("row.description", F.lit(""))).alias("n"),
        F.col(f"row.{arrival}").alias("at"),
        F.col("row.description").alias("description"),
        F.col("row.partial").alias("partial"),
    )
    dated = F.when(
        F.col("row.posted_at").isNotNull(),
        F.struct(F.col(f"row.{arrival}").alias("at"), F.col("row.posted_at").alias("posted_at")),
    )
    won = chain.groupBy("dedupe_key").agg(
        F.min_by("row", "_p").alias("row"),
        F.max(body).alias("body"),
        F.max(dated).alias("dated"),
        F.first("boards").alias("boards"),
        F.first("copies").alias("copies"),
    )
    kept = [c for c in fields if c not in ("description", "partial", "posted_at", "also_on", "flags")]
    also = F.sort_array(F.array_except("boards", F.array("row.source")))
    flags = (
        F.coalesce(F.col("row.flags"), F.array().cast("array<string>"))
        if "flags" in fields
        else F.array().cast("array<string>")
    )
    return won.select(
        "dedupe_key",
        keys.uid().alias("uid"),
        F.col(f"row.{arrival}").alias(arrival),
        *[F.col(f"row.{c}").alias(c) for c in kept if c != "uid"],
        F.col("dated.posted_at").alias("posted_at"),
        F.col("body.description").alias("description"),
        F.col("body.partial").alias("partial"),
        also.alias("also_on"),
        F.when(
            F.size(also) > 0,
            F.concat(flags, F.array(F.concat(F.lit("also on: "), F.array_join(also, ", ")))),
        ).otherwise(flags).alias("flags"),
        (F.col("copies") - 1).alias("collapsed"),
    )


def collapse_reposts(
    postings: DataFrame, known: DataFrame, places: Iterable[str] = ()
) -> DataFrame:
    """One requisition advertised by a crowd of agencies keeps one row.

    ``known`` is a table of watched company names; theirs are never dropped.
    Groups are judged from per-company counts; only the few farms found are
    joined back, so ordinary postings pass through one equi-join.
    """
    rows = (
        postings.withColumn("_farm_key", keys.repost_title("title", places))
        .withColumn("_company", F.lower(F.trim("company")))
        .withColumn(
            "_open",
            ~F.col("source").isin(*OWN_BOARDS) & (F.size(F.split("_farm_key", " ")) >= 2),
        )
    )
    watched = known.select(F.lower(F.trim("name")).alias("_company")).distinct()
    per_company = (
        rows.filter("_open")
        .groupBy("source", "_farm_key", "_company")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.array_contains("flags", "staffing-agency")).alias("flagged"),
            F.max(
                F.struct(
                    F.col("score"),
                    (F.length(F.coalesce("description", F.lit(""))) > 0).alias("has_body"),
                    (-F.col("arrival")).alias("early"),
                    F.col("uid"),
                )
            ).alias("top"),
        )
        .join(watched.withColumn("_watched", F.lit(True)), "_company", "left")
    )
    unwatched = F.col("_watched").isNull()
    farms = (
        per_company.groupBy("source", "_farm_key")
        .agg(
            F.count("*").alias("companies"),
            (F.sum("flagged") / F.sum("n")).alias("share"),
            F.max(F.when(unwatched, F.col("top"))).alias("top"),
            F.count_if(unwatched).alias("shops"),
        )
        .filter(
            (F.col("companies") >= REPOST_MIN_COMPANIES)
            & (F.col("share") >= REPOST_MIN_AGENCY_SHARE)
            & F.col("top").isNotNull()
        )
        .select(
            "source", "_farm_key", "shops", F.col("top.uid").alias("_keep"),
            F.col("top.early").alias("_keep_early"), F.lit(True).alias("_open"),
        )
    )
    joined = rows.join(farms, ["source", "_farm_key", "_open"], "left").join(
        watched.withColumn("_watched", F.lit(True)), "_company", "left"
    )
    in_farm = F.col("_keep").isNotNull() & F.col("_watched").isNull()
    keeper = in_farm & (F.col("uid") == F.col("_keep")) & (-F.col("arrival") == F.col("_keep_early"))
    agency = F.array(F.lit("staffing-agency"))
    marked = F.concat(
        F.when(F.array_contains("flags", "staffing-agency"), F.col("flags")).otherwise(
            F.concat("flags", agency)
        ),
        F.array(F.concat(F.lit("reposted by "), F.col("shops").cast("string"), F.lit(" firms"))),
    )
    why = F.concat(
        F.lit("one requisition advertised by "), F.col("shops").cast("string"),
        F.lit(" staffing firms"),
    )
    out = joined.filter(~in_farm | keeper).withColumn(
        "flags", F.when(keeper, marked).otherwise(F.col("flags"))
    )
    if "reasons" in postings.columns:
        out = out.withColumn(
            "reasons", F.when(keeper, F.array_append("reasons", why)).otherwise(F.col("reasons"))
        )
    return out.select(*postings.columns)


# -- the seen table -------------------------------------------------------------

SEEN_LABELS = ("title", "company", "url", "location")


def fold_sightings(sightings: DataFrame, labels: Iterable[str] = SEEN_LABELS) -> DataFrame:
    """One row per uid: first and last run, number of runs, latest score,
    and the first sighting's label.

    Runs are counted in two steps (uid and run, then uid), which also makes
    several copies in one run count once. ``runs`` and ``first_arrival`` are what
    a merge needs: a posting's runs are few, one for each day it was open.
    """
    labels = [c for c in labels if c in sightings.columns]
    per_run = sightings.groupBy("uid", "run_ts").agg(
        F.max("score").alias("score"), F.min(F.struct("arrival", *labels)).alias("label")
    )
    return (
        per_run.groupBy("uid")
        .agg(
            F.min("run_ts").alias("first_seen"),
            F.max("run_ts").alias("last_seen"),
            F.count("*").alias("times_seen"),
            F.max_by("score", "run_ts").alias("score"),
            F.min_by("label", "run_ts").alias("label"),
            F.sort_array(F.collect_list("run_ts")).alias("runs"),
        )
        .select("uid", "first_seen", "last_seen", "times_seen", "score",
                *[F.col(f"label.{c}").alias(c) for c in labels],
                "runs", F.col("label.arrival").alias("first_arrival"))
    )


def merge_seen(state: DataFrame, run: DataFrame) -> DataFrame:
    """H03 incrementally: the stored table and another fold make the next table,
    in whatever order the folds come and whether or not they share runs. Only the
    fold's own rows are new; the state is joined once."""
    labels = [c for c in SEEN_LABELS if c in state.columns and c in run.columns]
    s, r = state.alias("s"), run.alias("r")
    runs = F.sort_array(F.array_distinct(F.concat(*(F.coalesce(f"{t}.runs", F.expr("array()").cast(state.schema["runs"].dataType)) for t in "sr"))))
    newer = F.col("s.uid").isNull() | (F.col("r.last_seen") > F.col("s.last_seen"))
    same = F.col("r.last_seen") == F.col("s.last_seen")
    earlier = F.col("s.uid").isNull() | (F.col("r.uid").isNotNull() & (F.struct("r.first_seen", "r.first_arrival") < F.struct("s.first_seen", "s.first_arrival")))
    return s.join(r, F.col("s.uid") == F.col("r.uid"), "full_outer").select(
        F.coalesce("s.uid", "r.uid").alias("uid"),
        F.least("s.first_seen", "r.first_seen").alias("first_seen"),
        F.greatest("s.last_seen", "r.last_seen").alias("last_seen"),
        F.size(runs).cast("long").alias("times_seen"),
        F.when(newer, F.col("r.score")).when(same, F.greatest("s.score", "r.score")).otherwise(F.col("s.score")).alias("score"),
        *[F.when(earlier, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in (*labels, "first_arrival")],
        runs.alias("runs"),
    )


def new_postings(run: DataFrame, seen: DataFrame, min_score: int | None = None) -> DataFrame:
    """Rows whose uid the store has never held."""
    rows = run if min_score is None else run.filter(F.col("score") >= min_score)
    return rows.join(seen.select("uid"), "uid", "left_anti")


def settle(posted: Column, first_seen: Column) -> Column:
    """A post date after the first sighting is that sighting; undated stays so."""
    return F.when(posted > first_seen, first_seen).otherwise(posted)


def settle_posted(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Clamp posted_at to the run that first saw the posting."""
    first = seen.select("uid", F.col("first_seen").alias("_first"))
    out = rows.join(first, "uid", "left").withColumn(
        "posted_at", settle(F.col("posted_at"), F.col("_first"))
    )
    known = F.col("first_seen") if "first_seen" in rows.columns else F.lit(None).cast("timestamp")
    return out.withColumn("first_seen", F.coalesce("_first", known)).drop("_first")


def ghost_span(first_seen: Column, as_of) -> Column:
    return F.floor(elapsed_days(stamp(as_of), first_seen)).cast("int")


def ghosts(seen: DataFrame, as_of) -> DataFrame:
    """Postings that keep coming back over a long window."""
    return (
        seen.withColumn("span_days", ghost_span(F.col("first_seen"), as_of))
        .filter((F.col("span_days") >= GHOST_DAYS) & (F.col("times_seen") >= GHOST_TIMES))
        .withColumn("flag", F.lit("ghost-suspect"))
        .withColumn(
            "reason",
            F.concat(
                F.lit("seen "), F.col("times_seen").cast("string"), F.lit("x over "),
                F.col("span_days").cast("string"), F.lit("d - likely evergreen"),
            ),
        )
    )


def prune_seen(seen: DataFrame, as_of, days: int = SEEN_RETENTION_DAYS) -> DataFrame:
    """Forget by FIRST sighting. A plain comparison, so a table laid out
    by month of first_seen prunes partitions."""
    return seen.filter(
        F.col("first_seen").isNull()
        | (F.col("first_seen") >= stamp(as_of) - F.make_dt_interval(F.lit(days)))
    )


# -- the candidate working set ----------------------------------------------------


def _cut(text: Column, size: int | None) -> Column:
    return text if size is None else F.substring(text, 1, size)


def upsert_candidates(
    run: DataFrame,
    prior: DataFrame,
    as_of,
    floor: int = MIN_SCORE_TO_REPORT,
    cap: int = MAX_ENTRIES,
    days: int = RETENTION_DAYS,
    max_body: int | None = None,
) -> DataFrame:
    """This run's rows replace the stored ones, but never trade a body for
    an empty one and never move first_seen; old and low rows leave; the working
    set is the best ``cap`` rows (the cap is the feature)."""
    fresh = run.filter(F.col("score") >= floor)
    cols = [c for c in fresh.columns if c not in ("uid", "description", "first_seen", "last_seen")]
    r, p = fresh.alias("r"), prior.alias("p")
    here = F.col("r.uid").isNotNull()
    merged = r.join(p, F.col("r.uid") == F.col("p.uid"), "full_outer").select(
        F.coalesce("r.uid", "p.uid").alias("uid"),
        *[F.when(here, F.col(f"r.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in cols],
        _cut(
            F.coalesce(
                F.nullif("r.description", F.lit("")), F.col("p.description"), F.lit("")
            ), max_body,
        ).alias("description"),
        F.coalesce("p.first_seen", "r.first_seen", stamp(as_of)).alias("first_seen"),
        F.when(here, stamp(as_of)).otherwise(F.col("p.last_seen")).alias("last_seen"),
    )
    alive = merged.filter(
        (F.col("score") >= floor)
        & (F.col("last_seen") >= stamp(as_of) - F.make_dt_interval(F.lit(days)))
    )
    return alive.orderBy(F.desc("score"), "last_seen", "uid").limit(cap)


def remember_bodies(
    store: DataFrame, filled: DataFrame, as_of, days: int = RETENTION_DAYS
) -> DataFrame:
    """Latest full body per url, whole, for as long as a candidate row lives."""
    fresh = filled.filter(
        (F.col("url") != "") & (F.coalesce("description", F.lit("")) != "") & ~F.col("partial")
    ).select("url", F.col("description").alias("body"), stamp(as_of).alias("at"))
    return (
        store.select("url", "body", "at")
        .unionByName(fresh)
        .filter(F.col("at") >= stamp(as_of) - F.make_dt_interval(F.lit(days)))
        .groupBy("url")
        .agg(F.max(F.struct("at", "body")).alias("m"))
        .select("url", "m.body", "m.at")
    )


def full_body(flags: Column, partial: Column, body: Column) -> Column:
    return (
        (F.coalesce(body, F.lit("")) != "")
        & ~F.coalesce(partial, F.lit(False))
        & ~F.coalesce(F.array_contains(flags, "partial-description"), F.lit(False))
    )


def reuse_bodies(run: DataFrame, candidates: DataFrame, bodies: DataFrame) -> DataFrame:
    """Postings without a full body take the stored one when longer."""
    stored = (
        candidates.filter(full_body(F.col("flags"), F.col("partial"), F.col("description")))
        .groupBy("uid", "url")
        .agg(F.max("description").alias("_by_uid"))
    )
    by_url = bodies.select("url", F.col("body").alias("_by_url"))
    lacking = (F.coalesce("description", F.lit("")) == "") | F.col("partial")
    given = F.coalesce("_by_uid", F.when(F.col("partial"), F.col("_by_url")))
    better = lacking & (F.length(given) > F.length(F.coalesce("description", F.lit(""))))
    return (
        run.join(stored, ["uid", "url"], "left")
        .join(by_url, "url", "left")
        .withColumn("reused", F.coalesce(better, F.lit(False)))
        .withColumn("description", F.when(F.col("reused"), given).otherwise(F.col("description")))
        .withColumn("partial", F.when(F.col("reused"), F.lit(False)).otherwise(F.col("partial")))
        .drop("_by_uid", "_by_url")
    )


def wants_body(flags: Column, partial: Column, body: Column) -> Column:
    return (
        F.coalesce(partial, F.lit(False))
        | F.coalesce(F.array_contains(flags, "partial-description"), F.lit(False))
        | (F.trim(F.coalesce(body, F.lit(""))) == "")
    )


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def work_list(
    rows: DataFrame,
    min_score: int = DETAIL_MIN_SCORE,
    per_host: int = MAX_PER_HOST,
    total: int = MAX_DETAILS,
) -> DataFrame:
    """The budgeted list of bodies to read, best first.

    The budget is the feature. The per-host rank keeps at most ``per_host``
    rows per task before the shuffle (window group limit), so one huge host
    never lands whole in one task.
    """
    best = Window.partitionBy("host").orderBy(F.desc("score"), "uid", "url")
    return (
        rows.filter((F.col("score") >= min_score) & (F.col("url") != ""))
        .withColumn("host", url_host("url"))
        .withColumn("host_rank", F.row_number().over(best))
        .filter(F.col("host_rank") <= per_host)
        .orderBy(F.desc("score"), "uid", "url")
        .limit(total)
    )


def sweep_list(rows: DataFrame, budget: int = SWEEP_BUDGET) -> DataFrame:
    """Carried rows still lacking a body, least recently checked first."""
    latest = rows.agg(F.max("last_seen")).scalar()
    return (
        rows.filter(
            (F.col("last_seen") < latest)
            & (F.col("url") != "")
            & wants_body(F.col("flags"), F.col("partial"), F.col("description"))
        )
        .orderBy(F.asc_nulls_first("checked_at"), F.desc("score"), "uid")
        .limit(budget)
    )


def close_gone(rows: DataFrame, gone: DataFrame, floor: int = MIN_SCORE_TO_REPORT) -> DataFrame:
    """Drop rows reported gone, unless the latest run still saw them."""
    latest = rows.agg(F.max("last_seen")).scalar()
    closed = (
        rows.filter(F.col("last_seen") < latest)
        .join(gone.select("uid").distinct(), "uid", "left_semi")
        .select("uid")
    )
    return rows.filter(F.col("score") >= floor).join(closed, "uid", "left_anti")


# -- employers worth watching -----------------------------------------------------


def is_agency(name: Column, agencies: Iterable[str]) -> Column:
    return mentions(F.lower(name), [a.lower() for a in agencies])


def learn_candidates(
    postings: DataFrame,
    known: DataFrame,
    misses: DataFrame,
    as_of,
    agencies: Iterable[str] = (),
    min_score: int = LEARN_MIN_SCORE,
    limit: int | None = LEARN_MAX_NEW,
) -> DataFrame:
    """Unwatched companies by best posting, with how many different titles
    they advertise. Titles are folded per (company, title) first; the titles
    themselves are rows (see titles_of), never one company's list.
    """
    name = F.trim("company")
    cutoff = F.date_sub(stamp(as_of).cast("date"), LEARN_RETRY_DAYS)
    recent = misses.filter(F.col("tried_on") > cutoff).select(F.lower("name").alias("company_key"))
    per_title = (
        postings.filter(
            (name != "")
            & (F.col("score") >= min_score)
            & ~F.coalesce(F.array_contains("flags", "staffing-agency"), F.lit(False))
            & ~is_agency(F.col("company"), agencies)
        )
        .groupBy(F.lower(name).alias("company_key"), "title")
        .agg(
            F.max("score").alias("score"),
            F.min(F.struct("arrival", name.alias("name"))).alias("first"),
        )
        .join(known.select(F.lower("name").alias("company_key")), "company_key", "left_anti")
        .join(recent, "company_key", "left_anti")
    )
    ranked = per_title.groupBy("company_key").agg(
        F.max("score").alias("best"), F.min("first").alias("first"),
        F.count_if(F.col("title") != "").alias("n_titles"),
    ).withColumn("name", F.col("first.name")).orderBy(F.desc("best"), "name")
    if limit:
        ranked = ranked.limit(limit)
    return ranked.select("name", "best", "n_titles")


def titles_of(companies: DataFrame, postings: DataFrame, min_score: int = LEARN_MIN_SCORE) -> DataFrame:
    """(name, title) rows for chosen companies, as H14 joins them."""
    chosen = companies.select("name", F.lower(F.trim("name")).alias("_k"))
    good = postings.filter((F.col("score") >= min_score) & (F.coalesce("title", F.lit("")) != ""))
    return (
        good.select(F.lower(F.trim("company")).alias("_k"), "title").distinct()
        .join(chosen, "_k").select("name", "title")
    )


def confirm_boards(boards: DataFrame, seen: DataFrame) -> DataFrame:
    """Boards advertising a title already seen for their company.

    ``boards`` (company, slug, title) one row per advertised title; ``seen``
    (company, title). An equi-join on company and normalised title.
    """
    norm = keys.discovery_title("title")
    have = seen.select(F.lower(F.trim("company")).alias("_c"), norm.alias("_t"),
                       F.col("title").alias("seen_title"))
    have = have.groupBy("_c", "_t").agg(F.min("seen_title").alias("seen_title"))
    theirs = boards.filter(F.coalesce("title", F.lit("")) != "").select(
        "company", "slug", F.lower(F.trim("company")).alias("_c"), norm.alias("_t")
    ).distinct()
    return (
        theirs.join(have, ["_c", "_t"])
        .groupBy("company", "slug")
        .agg(F.min("seen_title").alias("proof"))
    )


def confirm_local_boards(boards: DataFrame, places: Iterable[str], state: str) -> DataFrame:
    """H14, for companies never seen: the board must carry the same company
    name and a location in the home places. ``boards`` has company,
    board_company, slug, location (one row per location)."""
    from ..functions.geo import place_named

    same = keys.same_company_key("company")
    return (
        boards.filter((same != "") & (same == keys.same_company_key("board_company")))
        .withColumn("proof", place_named("location", places, state))
        .filter(F.col("proof").isNotNull())
        .groupBy("company", "slug")
        .agg(F.min("proof").alias("proof"))
    )


def seed_candidates(
    named: DataFrame,
    seen: DataFrame,
    candidates: DataFrame,
    known: DataFrame,
    misses: DataFrame,
    as_of,
    places: Iterable[str],
    state: str = "",
    agencies: Iterable[str] = (),
    limit: int | None = SEED_MAX,
    min_sightings: int = SEED_MIN_SIGHTINGS,
    retry_missed: bool = False,
) -> DataFrame:
    """Pasted names first, then local companies by how often they turn up.

    Seen and candidate rows are counted together on purpose, so a company
    advertising now outranks one last seen weeks ago.
    """
    from ..functions.geo import place_named

    local = (
        seen.select("company", "location")
        .unionAll(candidates.select("company", "location"))
        .filter(
            (F.trim(F.coalesce("company", F.lit(""))) != "")
            & place_named("location", places, state).isNotNull()
        )
        .groupBy(F.lower(F.trim("company")).alias("_key"))
        .agg(F.min(F.trim("company")).alias("name"), F.count("*").alias("sightings"))
        .filter(F.col("sightings") >= min_sightings)
        .select("_key", "name", F.lit("").alias("site"), "sightings",
                F.lit(1).alias("_part"), F.lit(0).cast("long").alias("_pos"))
    )
    pasted = named.select(
        F.lower("name").alias("_key"), "name", F.coalesce("site", F.lit("")).alias("site"),
        F.lit(min_sightings).cast("long").alias("sightings"), F.lit(0).alias("_part"),
        F.col("pos").cast("long").alias("_pos"),
    )
    cutoff = F.date_sub(stamp(as_of).cast("date"), LEARN_RETRY_DAYS)
    rows = (
        pasted.unionByName(local)
        .filter(~is_agency(F.col("name"), agencies))
        .join(known.select(F.lower("name").alias("_key")), "_key", "left_anti")
    )
    if not retry_missed:
        recent = misses.filter(F.col("tried_on") > cutoff).select(F.lower("name").alias("_key"))
        rows = rows.join(recent, "_key", "left_anti")
    best = rows.groupBy("_key").agg(
        F.min(F.struct("_part", "_pos", (-F.col("sightings")).alias("_less"), "name", "site")).alias("b")
    ).select("b.*")
    out = best.orderBy("_part", "_pos", "_less", "name")
    if limit:
        out = out.limit(limit)
    return out.select("name", "site", (-F.col("_less")).alias("sightings"),
                      (F.col("_part") == 0).alias("pasted"))
