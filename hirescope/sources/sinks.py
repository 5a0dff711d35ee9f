"""Tables the jobs write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.pay import salary_text
from ..operators.history import new_postings
from ..schema import SNAPSHOT_DROPPED
from ..session import written

# --- fixed values ----------------------------------------------------------------------
WIDTHS = {
    "run_stamp": 20, "dedupe_key": 255, "uid": 16, "source": 50, "title": 500, "company": 255,
    "location": 255, "department": 255, "external_id": 255,
}
CHIP_FLAGS = (
    ("entry-level", "Entry level"), ("no-experience-required", "Will train"),
    ("equivalency-accepted", "Degree accepted"), ("low-competition", "Low competition"),
    ("high-competition", "Crowded"), ("staffing-agency", "Via agency"), ("hybrid", "Hybrid"),
    ("stretch-experience", "Stretch"), ("advanced-degree-req", "Wants Master's"),
    ("off-hours-availability", "Off-hours"), ("second-language-required", "Bilingual"),
    ("physical-labor", "Physical"), ("driving-required", "Driving"),
    ("ghost-suspect", "Possible ghost"), ("stale", "Stale"),
)
NOTIFY_TIERS, NOTIFY_TOP, NOTIFY_BATCH = ("A", "B", "C"), 20, 10
ROW_BOOKKEEPING = ("name", "tier", "learned_on", "learned_score", "confirmed_by")


def raw_rows(postings: DataFrame, run_stamp: str, collected_at, widths: dict[str, int] = WIDTHS) -> DataFrame:
    """The pull as it came, text trimmed to the declared widths."""
    from ..operators.market import stamp

    df = postings.withColumn("dedupe_key", keys.dedupe_key()).withColumns({
        "uid": keys.uid("dedupe_key"), "run_stamp": F.lit(run_stamp),
        "collected_at": stamp(collected_at),
    })
    cols = ("run_stamp", "collected_at", "dedupe_key", "uid", "source", "title", "company", "url",
            "location", "description", "posted_at", "salary_min", "salary_max", "remote",
            "department", "external_id")
    return df.select(*[
        (F.substring(c, 1, widths[c]) if c in widths else F.col(c)).alias(c) for c in cols if c in df.columns
    ])


def bad_rows(raw: DataFrame) -> DataFrame:
    """Rows a strict table would refuse."""
    return raw.filter((F.coalesce("uid", F.lit("")) == "") | (F.coalesce("dedupe_key", F.lit("")) == ""))


def write_raw(raw: DataFrame, path: str, quarantine: str | None = None) -> None:
    """Append, partitioned by run day; refused rows go to ``quarantine``, by
    default the folder ``path`` with ``-refused``. Rows are split by predicate, so a
    bad row costs only itself, and none is dropped."""
    day = F.to_date("collected_at")
    good = (F.coalesce("uid", F.lit("")) != "") & (F.coalesce("dedupe_key", F.lit("")) != "")
    # Both predicates would work every key out again: the rows are made once.
    raw = written(raw, "raw-rows")
    raw.filter(good).withColumn("run_date", day).write.mode("append").partitionBy("run_date").parquet(path)
    bad_rows(raw).write.mode("append").parquet(quarantine or f"{path.rstrip('/')}-refused")


def write_raw_jdbc(raw: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """K01 to a database the caller runs."""
    raw.write.mode("append").jdbc(url, table, properties=properties)


def snapshot_rows(run: DataFrame, seen: DataFrame) -> DataFrame:
    """First-seen rows only, without bodies or scoring prose."""
    return new_postings(run, seen).drop(*[c for c in SNAPSHOT_DROPPED if c in run.columns])


def write_snapshot(rows: DataFrame, path: str, run_stamp: str) -> None:
    rows.withColumn("run_stamp", F.lit(run_stamp)).write.mode("append").partitionBy("run_stamp").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> None:
    """A whole new version beside the old one, then a pointer row. Readers
    see the old version until the pointer is written."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{root}-pointer")


def current_version(spark: SparkSession, root: str) -> int:
    row = spark.read.parquet(f"{root}-pointer").agg(F.max("version").alias("v")).first()
    return row["v"]


def read_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version={current_version(spark, root)}")


def chips(remote: Column, location: Column, low: Column, high: Column, family: Column, flags: Column) -> Column:
    """The scannable row: place, pay, family, then the flags worth a chip."""
    place = F.when(remote | F.lower(location).contains("remote"), F.lit("Remote")).otherwise(
        F.nullif(location, F.lit(""))
    )
    kind = F.when(~family.isin("", "unclassified", "other-field"), family)
    marks = [F.when(F.array_contains(flags, f), F.lit(label)) for f, label in CHIP_FLAGS]
    return F.array_compact(F.array(place, F.nullif(salary_text(low, high), F.lit("")), kind, *marks))


def digest_rows(new: DataFrame) -> DataFrame:
    """One rendered row per new posting of tier A to D, with what orders
    them: tier, then score."""
    df = new.filter(F.col("tier").isin("A", "B", "C", "D"))
    chip = chips(F.col("remote"), F.col("location"), F.col("salary_min"), F.col("salary_max"),
                 F.col("job_family"), F.col("flags"))
    pay = salary_text(F.col("salary_min"), F.col("salary_max"))
    meta = F.array_join(
        F.filter(F.array(F.col("company"), F.coalesce(F.nullif("location", F.lit("")), F.lit("location n/a")),
                         pay, F.col("source")), lambda x: x != ""), " - ",
    )
    text = F.concat(
        F.lit("### ["), F.col("score").cast("string"), F.lit("] ["), "title", F.lit("]("), "url", F.lit(")\n*"),
        meta, F.lit("*\n"), F.array_join(F.col("chips"), " | "), F.lit("\n"),
        F.array_join(F.transform(F.slice("reasons", 1, 6), lambda r: F.concat(F.lit("- "), r)), "\n"),
    )
    return df.withColumn("chips", chip).select("uid", "tier", "score", "company", "title", text.alias("text"))


def digest_sources(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def write_digest(rows: DataFrame, path: str) -> None:
    """The rendered lines in order, written in parallel."""
    rows.repartitionByRange("tier", F.desc("score")).sortWithinPartitions("tier", F.desc("score"), "uid").select(
        "text"
    ).write.mode("overwrite").text(path)


def valid_link(url: Column | str) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return c.rlike(r"^https?://[^/?#]*\.[^/?#]*")


def notifications(new: DataFrame) -> DataFrame:
    """The twenty best of tiers A to C in batches of ten. The cap is the
    feature; ranking happens on the capped rows."""
    worth = new.filter(F.col("tier").isin(*NOTIFY_TIERS)).orderBy(F.desc("score"), "uid").limit(NOTIFY_TOP)
    ranked = worth.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "uid")))
    return ranked.select(
        F.floor((F.col("place") - 1) / NOTIFY_BATCH).cast("int").alias("batch"), "place", "uid", "tier", "score",
        F.concat(F.lit("["), F.col("score").cast("string"), F.lit("] "), "title").alias("heading"),
        F.when(valid_link("url"), F.col("url")).alias("link"),
    )


def notification_batches(new: DataFrame) -> DataFrame:
    item = F.struct("place", "heading", "link")
    return notifications(new).groupBy("batch").agg(F.sort_array(F.collect_list(item)).alias("items"))


def notification_header(pulled: DataFrame, kept: DataFrame, new: DataFrame) -> DataFrame:
    """The counts that lead the message."""
    worth = F.least(F.count_if(F.col("tier").isin(*NOTIFY_TIERS)), F.lit(NOTIFY_TOP))
    n = new.agg(F.count("*").alias("new"), worth.alias("worth"))
    return pulled.agg(F.count("*").alias("pulled")).join(kept.agg(F.count("*").alias("kept")), F.lit(True)).join(n, F.lit(True))


def one_per_board(employers: DataFrame, position: str = "pos") -> DataFrame:
    """Entries pointing at one board keep the first name it was filed under."""
    board = [c for c in employers.columns if c not in (*ROW_BOOKKEEPING, position)]
    whole = [c for c in employers.columns if c != position]
    first = F.min(F.struct(position, *[c for c in whole if c not in board])).alias("f")
    rest = [c for c in whole if c not in board]
    return employers.groupBy(*board).agg(first).select(*board, *[F.col(f"f.{c}").alias(c) for c in rest],
                                                       F.col(f"f.{position}").alias(position))


def upsert_misses(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One miss per name, the newest try."""
    return stored.unionByName(new).groupBy(F.lower("name").alias("_k")).agg(
        F.max(F.struct("tried_on", "name", "note")).alias("m")
    ).select("m.name", "m.tried_on", "m.note")


def corpus_rows(parsed: DataFrame, fetched) -> DataFrame:
    """A parsed description with its raw text and digest, to be read again
    when the vocabulary grows."""
    return parsed.select("company", "title", "raw", "digest", "terms", "years_required",
                         F.lit(str(fetched)).cast("date").alias("fetched"))


def evidence_state(events: DataFrame) -> DataFrame:
    """Kept skills and certificates from (at, on, term, word, text, source)
    events: one row per key, the first keep since the last forget."""
    key = (
        F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("c:"), F.trim(F.regexp_replace("text", r"\s+", " "))))
        .when(F.coalesce("term", F.lit("")) != "", F.concat(F.lit("t:"), "term"))
        .otherwise(F.concat(F.lit("w:"), F.lower(F.coalesce("word", F.lit("")))))
    )
    e = events.withColumn("key", key).filter(F.col("key") != "w:")
    gone = e.filter(~F.col("on")).groupBy("key").agg(F.max("at").alias("_gone"))
    live = e.filter("on").join(gone, "key", "left").filter(F.col("_gone").isNull() | (F.col("at") > F.col("_gone")))
    return live.groupBy("key").agg(F.min(F.struct("at", "source")).alias("k")).select(
        "key", F.col("k.at").alias("added"), "k.source"
    )


def append_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)
