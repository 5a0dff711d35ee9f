"""Registered queries for the streaming forms (X): each reads a table as a file
stream, runs it to the end of what is there, and reads the written result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import applications, history
from ..session import scratch
from ..streaming import landing, monthly, state
from .registry import query
from .views import AS_OF, SIGHTINGS_SQL, sightings, table

#: Micro-batches of the queries whose rows must not depend on how the events come.
FILES = 4
#: Documents of a landed file, which one task writes.
LANDED_ROWS = 250_000

_E = """WITH e AS (SELECT user_id || '|' || event_type AS uid, ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS run_ts, CAST(floor(value) AS INT) AS score FROM events)"""


def event_stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events table as a stream of sightings, a run per day; dealt out over so many
    files, each a micro-batch of all times, where ``files`` is given."""
    events = table(spark, sf_dir, "events")
    reader = spark.readStream.schema(events.schema)
    if files:
        path = scratch(spark, "events")
        events.repartition(files).write.parquet(path)
        e = reader.option("maxFilesPerTrigger", 1).parquet(path)
    else:
        e = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("uid"), F.date_trunc("day", ts).alias("run_ts"),
        (ts + F.expr("interval 2 days")).alias("posted_at"), F.floor("value").cast("int").alias("score"),
        F.col("event_id").alias("arrival"), F.col("event_type").alias("title"), F.lit("c").alias("company"), ts.alias("ts"),
    )


def finish(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into a table and read the table."""
    out = scratch(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (
        df.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, name + "-ckpt"))
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("X01_seen_stream", _E + """ SELECT uid, min(run_ts) AS first_seen, max(run_ts) AS last_seen, CAST(count(DISTINCT run_ts) AS INT) AS times_seen, min(run_ts) AS posted_at FROM e GROUP BY uid""")
def x01(spark, sf_dir):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = finish(state.seen_stream(event_stream(spark, sf_dir, FILES)), spark, "x01", "update")
    finally:
        if old:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = rows.groupBy("uid").agg(F.max(F.struct("times_seen", "first_seen", "last_seen", "posted_at")).alias("r")).select("uid", "r.*")
    n = "timestamp_ntz"
    return last.select("uid", F.col("first_seen").cast(n).alias("first_seen"), F.col("last_seen").cast(n).alias("last_seen"), "times_seen", F.col("posted_at").cast(n).alias("posted_at"))


@query("X01_seen_batches", _E + """ SELECT uid, min(run_ts) AS first_seen, max(run_ts) AS last_seen, count(DISTINCT run_ts) AS times_seen FROM e GROUP BY uid""")
def x01_batches(spark, sf_dir):
    """The merge form: every micro-batch folded into the stored table."""
    out = scratch(spark, "x01b")
    done: list[int] = []

    def read():
        return spark.read.parquet(f"{out}/v={done[-1]}") if done else None

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        done.append(batch_id)

    q = (event_stream(spark, sf_dir).writeStream.option("checkpointLocation", scratch(spark, "x01b-ckpt"))
         .trigger(availableNow=True).foreachBatch(state.seen_batches(read, write)).start())
    q.awaitTermination()
    n = "timestamp_ntz"
    return read().select("uid", F.col("first_seen").cast(n).alias("first_seen"), F.col("last_seen").cast(n).alias("last_seen"), "times_seen")


@query("X02_copies_dropped", _E + " SELECT DISTINCT uid AS dedupe_key FROM e")
def x02(spark, sf_dir):
    s = state.exact_copies_dropped(event_stream(spark, sf_dir).withColumn("dedupe_key", F.col("uid")), "ts", "400 days")
    return finish(s, spark, "x02").select("dedupe_key")


@query("X02_collapse_batches", """WITH e AS (SELECT regexp_replace(lower('c|' || event_type), '[^a-z0-9]+', '', 'g') AS k, event_id, CASE user_id % 3 WHEN 0 THEN 'workday' WHEN 1 THEN 'adzuna' ELSE 'hackernews' END AS source FROM events)
    SELECT k AS dedupe_key, 'workday' AS source, count(*) - 1 AS collapsed FROM e GROUP BY k""")
def x02_collapse(spark, sf_dir):
    out = scratch(spark, "x02c")
    done: list[int] = []

    def read(batch_id):
        before = [i for i in done if i < batch_id]
        return spark.read.parquet(f"{out}/v={max(before)}") if before else None

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        done.append(batch_id)

    e = event_stream(spark, sf_dir, FILES).withColumns({
        "source": F.when(F.split("uid", r"\|")[0].cast("int") % 3 == 0, "workday").when(F.split("uid", r"\|")[0].cast("int") % 3 == 1, "adzuna").otherwise("hackernews"),
        "description": F.lit(""), "partial": F.lit(False)})
    q = (e.writeStream.option("checkpointLocation", scratch(spark, "x02c-ckpt")).trigger(availableNow=True)
         .foreachBatch(state.collapse_batches(read, write)).start())
    q.awaitTermination()
    return history.settled(spark.read.parquet(f"{out}/v={max(done)}")).select("dedupe_key", "source", "collapsed")


@query("X03_late_dates", _E + " SELECT uid, ts, CASE WHEN ts + INTERVAL 2 DAY > f THEN f ELSE ts + INTERVAL 2 DAY END AS posted_at FROM e JOIN (SELECT uid, min(run_ts) AS f FROM e GROUP BY uid) USING (uid)")
def x03(spark, sf_dir):
    """Every late date clamped to the first sighting, none dropped."""
    seen = x01_batches(spark, sf_dir).withColumn("first_seen", F.col("first_seen").cast("timestamp"))
    rows = finish(event_stream(spark, sf_dir), spark, "x03")
    out = history.settle_posted(rows, seen)
    return out.select("uid", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("X04_follow_up_once", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) + 7 AS follow_up_due FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) + 7 <= DATE '2024-02-01'""")
def x04(spark, sf_dir):
    log = event_stream(spark, sf_dir).select(
        F.split("uid", r"\|")[0].alias("id"), F.when(F.col("title") == "click", "applied").otherwise("prepared").alias("status"),
        applications.follow_up_date(F.to_date("ts")).alias("follow_up_due"), "ts")
    return finish(state.follow_up_stream(log, "2024-02-01 00:00:00").select("id", "follow_up_due"), spark, "x04")


@query("X05_change_probe", "SELECT max(ts) AS newest, max(ts) > TIMESTAMP '2024-01-15' AS changed FROM events")
def x05(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.changed_since(e, "ts", "2024-01-15 00:00:00").select(F.col("newest").cast("timestamp_ntz").alias("newest"), "changed")


def _landing_lines(s: DataFrame) -> DataFrame:
    """A landed document for each sighting: mostly whole ones of three sources, some cut
    short, some of a source that nobody knows, some without the list of postings."""
    ext, iso = F.col("arrival").cast("string"), F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    jobs = F.array(F.struct("title", F.col("url").alias("absolute_url"), F.struct(F.col("place").alias("name")).alias("location"),
                            iso.alias("updated_at"), ext.alias("id")))
    listed = F.array(F.struct(F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.unix_millis(F.col("posted_at").cast("timestamp")).alias("createdAt"), ext.alias("id")))
    offers = F.array(F.struct("title", F.col("url").alias("careers_apply_url"), F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), ext.alias("id")))
    head = (ext.alias("doc_id"), "company", F.lit("acme").alias("slug"))
    kinds = [("greenhouse", F.struct(jobs.alias("jobs"))), ("lever", listed), ("recruitee", F.struct(offers.alias("offers")))]
    lines = [F.to_json(F.struct(*head, F.lit(name).alias("source"), body.alias("payload"))) for name, body in kinds]
    stray = F.to_json(F.struct(*head, F.lit("carrier-pigeon").alias("source"), jobs.alias("payload")))
    bare = F.to_json(F.struct(*head, F.lit("greenhouse").alias("source"), F.struct(F.lit(0).alias("total")).alias("payload")))
    line = F.when(F.col("line") % 3 == 0, lines[0]).when(F.col("line") % 3 == 1, lines[1]).otherwise(lines[2])
    fault = F.col("ord") % 50
    return s.select(F.when(fault == 7, F.substring(line, F.lit(1), F.length(line) - 9)).when(fault == 8, stray).when(fault == 9, bare).otherwise(line).alias("value"))


def _land_files(lines: DataFrame, folder: str, files: int) -> None:
    """Landed lines as files, compressed: as they are, they take six times the disk. No file
    has more than some LANDED_ROWS lines, so that one that can't be split is a small task."""
    lines.repartition(files).write.option("compression", "gzip").text(folder)


@query("S20_landing_stream", f"""WITH s AS ({SIGHTINGS_SQL}), d AS (SELECT *, CASE ord % 50 WHEN 7 THEN 'not JSON' WHEN 8 THEN 'unknown source' WHEN 9 THEN 'no list of postings' END AS reason FROM s)
    SELECT CASE ord % 50 WHEN 7 THEN NULL ELSE CAST(arrival AS VARCHAR) END AS id, CASE ord % 50 WHEN 7 THEN NULL WHEN 8 THEN 'carrier-pigeon' WHEN 9 THEN 'greenhouse' ELSE CASE line % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'recruitee' END END AS source,
    CASE WHEN reason IS NULL THEN title END AS title, CASE WHEN reason IS NULL THEN company END AS company, CASE WHEN reason IS NULL THEN posted_at END AS posted_at, reason FROM d""")
def s20_landing(spark, sf_dir):
    """Every sighting as a landed document in four micro-batches of files of bounded size; the
    last batch is then handed over again, as after a lost driver. Both tables, as one."""
    folder, out = scratch(spark, "landing"), scratch(spark, "landed")
    s = sightings(spark, sf_dir)
    files = max(1, -(-s.count() // LANDED_ROWS // FILES))  # of a micro-batch
    _land_files(_landing_lines(s), folder, FILES * files)
    paths, handed = (f"{out}/postings", f"{out}/unreadable"), {}
    landing.land_all(spark, folder, *paths, f"{out}/checkpoint", files_per_batch=files, handed=handed)
    if handed:
        last = max(handed)
        landing.land(*paths)(landing.landed(spark, handed[last], stream=False), last)
    postings, unreadable = (spark.read.parquet(p) for p in paths)
    none, when = F.lit(None).cast("string"), F.col("posted_at").cast("timestamp_ntz").alias("posted_at")
    good = postings.select(F.col("external_id").alias("id"), "source", "title", "company", when, none.alias("reason"))
    bad = unreadable.select(F.col("doc_id").alias("id"), "source", none.alias("title"), none.alias("company"),
                            F.lit(None).cast("timestamp_ntz").alias("posted_at"), "reason")
    return good.unionByName(bad)


def _seen_months(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The monthly table of all sightings, by company and title, from four shuffled files,
    and the sightings' schema of it."""
    folder, path = scratch(spark, "sightings"), scratch(spark, "seen-months")
    s = sightings(spark, sf_dir).select(
        F.concat_ws("|", "company", "title").alias("uid"), F.col("run_ts").cast("timestamp").alias("run_ts"), "score", "arrival", "title", "company")
    s.repartition(FILES).write.parquet(folder)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (stream.writeStream.option("checkpointLocation", scratch(spark, "seen-months-ckpt")).trigger(availableNow=True)
         .foreachBatch(monthly.merge_batches(path, buckets=2, days=None)).start())
    q.awaitTermination()
    return path, spark.read.parquet(path)


_MONTHLY = f"""WITH s AS ({SIGHTINGS_SQL}), f AS (SELECT company || '|' || title AS uid, CAST(min(run_ts) AS TIMESTAMP) AS first_seen, CAST(max(run_ts) AS TIMESTAMP) AS last_seen,
    count(DISTINCT run_ts) AS times_seen FROM s GROUP BY 1) SELECT uid, first_seen, last_seen, times_seen, strftime(first_seen, '%Y-%m') AS month FROM f"""


def _seen_columns(seen: DataFrame) -> DataFrame:
    n = "timestamp_ntz"
    return seen.select("uid", F.col("first_seen").cast(n).alias("first_seen"), F.col("last_seen").cast(n).alias("last_seen"), "times_seen", "month")


@query("H03_monthly_state", _MONTHLY)
def h03_monthly(spark, sf_dir):
    """Each micro-batch writes the months and hashes it touches; every posting has one home."""
    path, seen = _seen_months(spark, sf_dir)
    return _seen_columns(seen)


@query("H07_forget_months", _MONTHLY + " WHERE first_seen >= TIMESTAMP '2001-12-01' - INTERVAL 1500 DAY")
def h07_monthly(spark, sf_dir):
    """Folders of forgotten months removed, the bound's month pruned when read."""
    path, seen = _seen_months(spark, sf_dir)
    monthly.forget(spark, path, AS_OF, 1500)
    return _seen_columns(monthly.read_seen(spark, path, seen.schema, AS_OF, 1500))
