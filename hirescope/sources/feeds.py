"""Feeds and sitemaps read element by element.

The text source cuts a file after each end tag, in as many splits as the file has, so a
feed of any size is read by many tasks and never held as one value; an element may span
lines. (Spark's own XML files are split only where every element is a line.) Each
element is then parsed by ``from_xml``, which decodes entities and CDATA. One that
doesn't parse is kept as it is, and costs only itself. An end tag inside CDATA is taken
for one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import struct
from . import payloads

CORRUPT = "_corrupt_record"
RSS = ("title", "link", "region", "description", "pubDate")
SITEMAP = ("loc", "lastmod")


def elements(spark: SparkSession, path: str, tag: str, fields: Sequence[str], stream: bool = False) -> DataFrame:
    """One row for each element ``tag`` of the files at ``path``: its fields as text, the
    file, and the element itself where it is broken."""
    schema = struct({f: "string" for f in fields} | {CORRUPT: "string"})
    reader = (spark.readStream if stream else spark.read).option("lineSep", f"</{tag}>")
    cut = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    # What stands before the end tag, from the last start tag on; the rest is between elements.
    starts = [F.when(F.contains("value", F.lit(s)), F.concat(F.lit(s), F.substring_index("value", s, -1))) for s in (f"<{tag}>", f"<{tag} ")]
    one = cut.select("file", F.concat(F.coalesce(*starts), F.lit(f"</{tag}>")).alias("_raw")).filter("_raw IS NOT NULL")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreSurroundingSpaces": "true"}
    return one.select(F.from_xml("_raw", schema, options).alias("_x"), "file").select("_x.*", "file")


def broken(rows: DataFrame) -> DataFrame:
    """The elements that don't parse, for the side table: raw, file."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw"), "file")


def whole(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNull())


def feed_postings(rows: DataFrame) -> DataFrame:
    """Postings of a feed's items."""
    return payloads.feed_postings(whole(rows).na.fill(""))


def sitemap_postings(rows: DataFrame, company: str = "", job_path: str = "/job", local_terms: Sequence[str] = (),
                     keywords: Sequence[str] = ()) -> DataFrame:
    """Postings of a sitemap's job links."""
    links = whole(rows).select(F.lit(company).alias("company"), F.trim(F.coalesce("loc", F.lit(""))).alias("url"),
                               F.trim(F.coalesce("lastmod", F.lit(""))).alias("lastmod"))
    return payloads.link_postings(links, job_path, local_terms, keywords)
