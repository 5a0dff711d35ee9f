"""Landed documents as a stream, in several files, into two tables.

A landing folder holds JSON lines: one line for each fetched document, with its source,
the employer it was fetched for, and the document under ``payload`` (an object or list
for JSON sources, a text for feeds). Spark's JSON source splits large files over tasks
and puts a line that is no JSON into a column of its own, so a broken document costs
only itself. Each micro-batch writes postings and unreadable documents, each into a
folder named by the batch; a replayed batch overwrites its own folders and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POSTING, conform, struct
from ..sources import payloads

CORRUPT = "_corrupt_record"
ENVELOPE = {
    "doc_id": "string", "source": "string", "company": "string", "slug": "string", "host": "string",
    "site": "string", "payload": "string", CORRUPT: "string",
}
#: Each JSON source's document, and where its list of postings is.
SHAPES = {
    "greenhouse": (payloads.GREENHOUSE, "jobs"), "lever": (payloads.LEVER, ""), "ashby": (payloads.ASHBY, "jobs"),
    "smartrecruiters": (payloads.SMART, "content"), "workable": (payloads.WORKABLE, "jobs"),
    "recruitee": (payloads.RECRUITEE, "offers"), "workday": (payloads.WORKDAY, "jobPostings"),
    "remoteok": (payloads.REMOTEOK, ""), "remotive": (payloads.REMOTIVE, "jobs"),
    "himalayas": (payloads.HIMALAYAS, "jobs"), "adzuna": (payloads.ADZUNA, "results"),
    "themuse": (payloads.THEMUSE, "results"), "jobicy": (payloads.JOBICY, "jobs"),
}
#: Why a document is unreadable, the first reason that holds.
BROKEN, UNKNOWN, EMPTY, SHAPE = "not JSON", "unknown source", "no payload", "no list of postings"

Normaliser = Callable[[DataFrame], DataFrame]


def landed(spark: SparkSession, folder: str | list[str], stream: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """The documents of a landing folder (or, but for a stream, of files), one row for each line, with the file it is from."""
    reader = (spark.readStream if stream else spark.read).schema(struct(ENVELOPE)).option("columnNameOfCorruptRecord", CORRUPT)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).select("*", F.col("_metadata.file_path").alias("file"))


def normalisers(as_of=None) -> dict[str, Normaliser]:
    """Every source by name; the one that tells ages in days needs a day to count from."""
    own = {} if as_of is None else {"workday": partial(payloads.workday, as_of=as_of)}
    return payloads.REGISTRY | own


def reason(known: list[str]) -> Column:
    """Why a landed document can't be read, or null."""
    out = F.when(F.col(CORRUPT).isNotNull(), BROKEN).when(~F.coalesce(F.col("source").isin(known), F.lit(False)), UNKNOWN).when(
        F.coalesce(F.trim("payload"), F.lit("")) == "", EMPTY)
    for name, (schema, path) in SHAPES.items():
        document = F.from_json("payload", schema)
        out = out.when((F.col("source") == name) & (document[path] if path else document).isNull(), SHAPE)
    return out


def judged(documents: DataFrame, as_of=None) -> DataFrame:
    """Documents with the reason why each can't be read, which takes parsing it; a frame
    that has the reason passes through."""
    if "reason" in documents.columns:
        return documents
    return documents.withColumn("reason", reason(list(normalisers(as_of))))


def read_documents(documents: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Postings, and the documents that can't be read with the reason.

    Only the sources that are present become part of the plan; their names, at most one
    for each normaliser, are all that comes to the driver.
    """
    known = normalisers(as_of)
    told = judged(documents, as_of)
    good = told.filter("reason IS NULL")
    present = [r.source for r in good.select("source").distinct().collect()]
    parts = [known[name](good.filter(F.col("source") == name)) for name in sorted(present)]
    empty = conform(good.filter("false").select("source"), POSTING)
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else empty
    raw = F.coalesce(CORRUPT, "payload").alias("raw")
    return conform(rows, POSTING), told.filter("reason IS NOT NULL").select("doc_id", "source", "reason", raw, "file")


def land(postings: str, unreadable: str, as_of=None, handed: dict[int, list[str]] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes both tables. The batch is kept while it is read several
    times, with its reasons, as each reading would parse every document for them.
    ``handed`` is told the files of each batch, for a batch that must be handed over again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = judged(batch, as_of).persist()
        try:
            for rows, path in zip(read_documents(batch, as_of), (postings, unreadable), strict=True):
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            if handed is not None:
                handed[batch_id] = sorted(r.file for r in batch.select("file").distinct().collect())
        finally:
            batch.unpersist()

    return step


def land_all(spark: SparkSession, folder: str, postings: str, unreadable: str, checkpoint: str, as_of=None,
             files_per_batch: int | None = None, handed: dict[int, list[str]] | None = None) -> None:
    """Land what is in the folder and not yet landed, then end. Called again, it goes on from its checkpoint."""
    query = (
        landed(spark, folder, files_per_batch=files_per_batch).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(land(postings, unreadable, as_of, handed)).start()
    )
    query.awaitTermination()


def land_report(postings: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Postings and unreadable documents by batch and source."""
    good = postings.groupBy("batch", "source").agg(F.count("*").alias("postings"))
    bad = unreadable.groupBy("batch", F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("unreadable"))
    return good.join(bad, ["batch", "source"], "full_outer").na.fill(0, ["postings", "unreadable"])
