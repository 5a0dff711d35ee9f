"""Registered queries for payload sources (S), sinks (K) and snippet upgrades.

The payload documents are written from the sightings table with to_json, one
document per sighting, so every query's work grows with the tables and its
right answer is known from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import history
from ..session import scratch
from ..sources import feeds
from ..sources import payloads as src
from ..sources import sinks
from .market_queries import ARCHIVE_SQL, keyed
from .registry import query
from .views import AS_OF, SIGHTINGS_SQL, adverts, sightings, spread, table

_S = f"WITH s AS ({SIGHTINGS_SQL})"


def docs(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    s = sightings(spark, sf_dir).withColumn("ext", F.col("arrival").cast("string"))
    return s.withColumn("payload", F.to_json(body) if not isinstance(body, str) else F.expr(body)).select("payload", "company", F.lit("acme").alias("slug"))


def iso() -> Column:
    return F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shown(df: DataFrame, *cols: str) -> DataFrame:
    out = [F.col("external_id").alias("id"), "title", "company", "location", F.col("posted_at").cast("timestamp_ntz").alias("posted_at")]
    return df.select(*out, *cols)


_BASE = "SELECT CAST(arrival AS VARCHAR) AS id, title, company"


@query("S01_greenhouse", _S + f"{_BASE.replace('SELECT', ' SELECT')}, place AS location, posted_at, brand || ', ' || flag AS department, title || ':' || chr(10) || '• a' AS description FROM s")
def s01(spark, sf_dir):
    body = F.struct(F.array(F.struct("title", F.col("url").alias("absolute_url"), F.struct(F.col("place").alias("name")).alias("location"),
                                     F.concat(F.lit("<h2>"), "title", F.lit("</h2><li>a</li>")).alias("content"), iso().alias("updated_at"),
                                     F.array(F.struct(F.col("brand").alias("name")), F.struct(F.col("flag").alias("name"))).alias("departments"),
                                     F.col("ext").alias("id"), F.lit(1).alias("unknown"))).alias("jobs"))
    return shown(src.greenhouse(docs(spark, sf_dir, body)), "department", "description")


@query("S02_lever", _S + f" {_BASE}, place AS location, posted_at, line % 2 = 0 AS remote, CASE WHEN line = 1 THEN 'ops' ELSE brand END AS department FROM s")
def s02(spark, sf_dir):
    body = F.array(F.struct(F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.struct(
        F.col("place").alias("location"), F.when(F.col("line") != 1, F.col("brand")).otherwise(F.lit("")).alias("team"), F.lit("ops").alias("department"),
        F.when(F.col("line") % 2 == 0, F.lit("Remote")).alias("commitment")).alias("categories"), F.unix_millis(F.col("posted_at").cast("timestamp")).alias("createdAt"), F.col("ext").alias("id")))
    return shown(src.lever(docs(spark, sf_dir, body)), "remote", "department")


@query("S03_ashby", _S + f""" {_BASE}, place AS location, posted_at, CASE line WHEN 1 THEN 52000e0 + qty * 2080 WHEN 2 THEN 80000e0 WHEN 4 THEN 60000e0 END AS salary_min,
    CASE line WHEN 1 THEN 72800e0 + qty * 2080 WHEN 2 THEN 90000e0 WHEN 4 THEN 90000e0 END AS salary_max FROM s""")
def s03(spark, sf_dir):
    def part(kind, cur, unit, lo, hi):
        return F.struct(F.lit(kind).alias("compensationType"), F.lit(cur).alias("currencyCode"), F.lit(unit).alias("interval"), lo.cast("double").alias("minValue"), hi.cast("double").alias("maxValue"))
    n = F.lit
    comp = (F.when(F.col("line") == 1, F.array(part("Salary", "USD", "1 HOUR", 25 + F.col("qty"), 35 + F.col("qty")), part("Equity", "USD", "1 YEAR", n(20000), n(800000))))
            .when(F.col("line") == 2, F.array(part("Salary", "USD", "1 YEAR", n(90000), n(80000)), part("Salary", "EUR", "1 YEAR", n(20000), n(200000))))
            .when(F.col("line") == 3, F.array(part("Salary", "USD", "1 DECADE", n(90000), n(80000))))
            .when(F.col("line") == 4, F.array(part("Salary", "usd", "YEARS", n(60000), n(70000)), part("Salary", "USD", "1 YEAR", n(1), n(90000)))))
    body = F.struct(F.array(F.struct("title", F.col("url").alias("jobUrl"), F.col("place").alias("location"), iso().alias("publishedAt"), F.col("ext").alias("id"),
                                     F.struct(comp.alias("summaryComponents")).alias("compensation"))).alias("jobs"))
    return shown(src.ashby(docs(spark, sf_dir, body)), "salary_min", "salary_max")


@query("S04_smartrecruiters", _S + f""" {_BASE}, place || ', US' AS location, CASE WHEN line % 2 = 0 THEN run_ts ELSE posted_at END AS posted_at,
    CASE WHEN line % 2 = 0 THEN 'Job:' || chr(10) || 'do ' || title || chr(10) || 'Who:' || chr(10) || 'you' ELSE '' END AS description, CASE WHEN line % 4 = 0 THEN 60000e0 END AS salary_min FROM s""")
def s04(spark, sf_dir):
    body = F.struct(F.array(F.struct(F.col("title").alias("name"), F.col("ext").alias("id"), F.struct(F.col("place").alias("city"), F.lit("US").alias("country")).alias("location"),
                                     iso().alias("releasedDate"))).alias("content"))
    listed = docs(spark, sf_dir, body)
    sec = F.struct(F.struct(F.lit("Job").alias("title"), F.concat(F.lit("<p>do "), "title", F.lit("</p>")).alias("text")).alias("jobDescription"),
                   F.struct(F.lit("Who").alias("title"), F.lit("you").alias("text")).alias("qualifications"))
    pay = F.struct(F.when(F.col("line") == 4, F.lit("YEARLY")).otherwise(F.lit("HOURLY")).alias("period"), F.lit("USD").alias("currency"), F.lit(60000).alias("min"), F.lit(70000).alias("max"))
    detail = sightings(spark, sf_dir).filter("line % 2 = 0").select(F.to_json(F.struct(
        F.col("arrival").cast("string").alias("id"), F.date_format("run_ts", "yyyy-MM-dd").alias("releasedDate"), pay.alias("compensation"), F.struct(sec.alias("sections")).alias("jobAd"))).alias("payload"))
    return shown(src.smartrecruiters(listed, detail), "description", "salary_min")


@query("S05_workable", _S + f" {_BASE}, place || ', OH, US' AS location, posted_at, remote FROM s")
def s05(spark, sf_dir):
    body = F.struct(F.array(F.struct("title", "url", F.col("place").alias("city"), F.lit("OH").alias("state"), F.lit("US").alias("country"), F.date_format("posted_at", "yyyy-MM-dd").alias("published_on"),
                                     F.col("ext").alias("shortcode"), F.col("remote").alias("telecommuting"))).alias("jobs"))
    return shown(src.workable(docs(spark, sf_dir, body)), "remote")


@query("S06_recruitee", _S + f" {_BASE}, place || ', US' AS location, posted_at, brand AS department FROM s")
def s06(spark, sf_dir):
    body = F.struct(F.array(F.struct("title", F.lit("").alias("careers_url"), F.col("url").alias("careers_apply_url"), F.col("place").alias("city"), F.lit("").alias("state_name"), F.lit("US").alias("country"),
                                     F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.col("brand").alias("department"), F.col("ext").alias("id"))).alias("offers"))
    return shown(src.recruitee(docs(spark, sf_dir, body)), "department")


@query("S07_workday", _S + f""" {_BASE}, place AS location, CASE WHEN line = 1 THEN posted_at WHEN line = 2 THEN TIMESTAMP '2001-12-01' WHEN line = 3 THEN TIMESTAMP '2001-11-30'
    ELSE TIMESTAMP '2001-12-01' - to_days(CAST(qty AS INT)) END AS posted_at, CASE WHEN line = 1 THEN 'Body ' || title ELSE '' END AS description, line = 1 AS remote FROM s""")
def s07(spark, sf_dir):
    posted = F.when(F.col("line") == 2, F.lit("Posted Today")).when(F.col("line") == 3, F.lit("Posted Yesterday")).otherwise(F.concat(F.lit("Posted "), F.col("qty").cast("int").cast("string"), F.lit("+ Days Ago")))
    body = F.struct(F.array_repeat(F.struct("title", F.concat(F.lit("/job/"), "ext").alias("externalPath"), F.col("place").alias("locationsText"), posted.alias("postedOn"), F.array("ext").alias("bulletFields")), 2).alias("jobPostings"))
    listed = docs(spark, sf_dir, body).withColumns({"host": F.lit("x.wd1.myworkdayjobs.com"), "site": F.lit("Jobs")})
    detail = sightings(spark, sf_dir).filter("line = 1").select(F.concat(F.lit("/job/"), F.col("arrival").cast("string")).alias("path"), F.to_json(F.struct(F.struct(
        F.concat(F.lit("<p>Body "), "title", F.lit("</p>")).alias("jobDescription"), F.date_format("posted_at", "yyyy-MM-dd").alias("startDate"), F.lit("Fully Remote").alias("remoteType")).alias("jobPostingInfo"))).alias("payload"))
    return shown(src.workday(listed, AS_OF, detail), "description", "remote")


@query("S08_sitemap", _S + """ SELECT 'x' || arrival AS id, 'Data Analyst ' || line AS title, company, CASE line WHEN 1 THEN 'Columbus, Ohio, United States' ELSE 'News, West Virginia, United States' END AS location,
    posted_at FROM s WHERE line IN (1, 2)""")
def s08(spark, sf_dir):
    slug = F.concat(F.lit("data-analyst-"), "line", F.when(F.col("line") == 1, F.lit("-columbus-ohio-united-states")).otherwise(F.lit("-news-west-virginia-united-states")),
                    F.lit("-0a1b2c3d-0000-1111-2222-0123456789ab/"))
    title = F.when(F.col("line") >= 3, F.lit("cook-boise-idaho-united-states")).otherwise(slug)
    text = F.concat(F.lit("<urlset><url><loc> https://j.org/about </loc></url><url><loc>https://j.org/jobs/"), title, F.when(F.col("line") >= 3, F.lit("/")).otherwise(F.lit("")), F.lit("x"), "ext",
                    F.lit("</loc><lastmod>"), F.date_format("posted_at", "yyyy-MM-dd"), F.lit("</lastmod></url></urlset>"))
    s = sightings(spark, sf_dir).withColumn("ext", F.col("arrival").cast("string"))
    # The id follows the slug as its own path part; the slug is read up to it.
    p = s.withColumn("payload", F.regexp_replace(text, "ab/x", "ab/x")).select("payload", "company")
    rows = src.sitemap(p.withColumn("payload", F.regexp_replace("payload", r"(-0a1b[^/]*)/(x\d+)", "$1?/$2")), "/jobs/", ("columbus",), ("analyst 2",))
    return shown(rows.withColumn("title", F.regexp_extract("title", r"(?i)^(data analyst \d)", 1)).withColumn(
        "location", F.when(F.col("title").endswith("1"), F.lit("Columbus, Ohio, United States")).otherwise(F.lit("News, West Virginia, United States"))))


def marked_pages(spark, sf_dir):
    s = sightings(spark, sf_dir)
    pay = F.expr("""case line when 1 then '{"@type":"MonetaryAmount","value":{"minValue":"30","maxValue":"25","unitText":"HOUR"}}'
        when 2 then '[{"value":[{"value":"$5,000","unitText":"MONTH"}]}]' when 3 then '{"value":70000}' else '{"value":{"minValue":1,"maxValue":2}}' end""")
    node = F.concat(F.lit('{"@type":["Thing","JobPosting"],"title":"'), "title", F.lit('","description":"<p>Do &amp; learn</p>","datePosted":"'), F.date_format("run_ts", "yyyy-MM-dd"),
                    F.lit('","jobLocation":[{"address":{"addressLocality":"'), "place", F.lit('","addressRegion":"OH"}}],"baseSalary":'), pay, F.lit("}"))
    doc = F.when(F.col("line") == 2, F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), node, F.lit("]}"))).when(F.col("line") == 3, F.concat(F.lit("["), node, F.lit("]"))).otherwise(node)
    html = F.concat(F.lit('<html><script type="application/ld+json">{bad</script><script type="application/ld+json">'), doc, F.lit("</script></html>"))
    return s.select(F.col("arrival").alias("page_id"), "url", html.alias("html"))


@query("S09_jsonld_postings", _S + """ SELECT arrival AS page_id, title, 'Do & learn' AS description, run_ts AS posted_at, place || ', OH' AS location,
    CASE line WHEN 1 THEN 52000e0 WHEN 2 THEN 60000e0 WHEN 3 THEN 70000e0 END AS lo, CASE line WHEN 1 THEN 62400e0 WHEN 2 THEN 60000e0 WHEN 3 THEN 70000e0 END AS hi FROM s""")
def s09(spark, sf_dir):
    n = src.postings_from_nodes(src.job_nodes(marked_pages(spark, sf_dir)))
    return n.select("page_id", "title", "description", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "location", "pay.lo", "pay.hi")


@query("S09_apply_pages", _S + """ SELECT url, run_ts AS posted_at, CASE line WHEN 1 THEN 52000e0 WHEN 2 THEN 60000e0 WHEN 3 THEN 70000e0 ELSE 1e0 END AS salary_min FROM s""")
def s09_apply(spark, sf_dir):
    rows = sightings(spark, sf_dir).select("url", F.lit("old").alias("title"), F.lit("").alias("description"), F.lit(None).cast("timestamp").alias("posted_at"),
                                                            F.lit("").alias("location"), F.lit(1.0).alias("salary_min"), F.lit(None).cast("double").alias("salary_max"))
    out = src.apply_pages(rows, src.postings_from_nodes(src.job_nodes(marked_pages(spark, sf_dir))))
    return out.select("url", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "salary_min")


@query("S10_remoteok", _S + f" {_BASE}, CASE WHEN line = 1 THEN 'Remote' ELSE place END AS location, posted_at, CASE WHEN line <> 3 THEN price END AS salary_min FROM s WHERE line <> 7")
def s10(spark, sf_dir):
    body = F.array(F.struct(F.when(F.col("line") != 7, F.col("title")).alias("position"), "company", "url", F.when(F.col("line") == 1, F.lit("")).otherwise(F.col("place")).alias("location"),
                            F.when(F.col("line") % 2 == 0, iso()).alias("date"), F.unix_seconds(F.col("posted_at").cast("timestamp")).alias("epoch"),
                            F.when(F.col("line") == 3, F.lit(0.0)).otherwise(F.col("price")).alias("salary_min"), F.col("ext").alias("id")))
    return shown(src.remoteok(docs(spark, sf_dir, body)), "salary_min")


@query("S11_remotive", _S + f" {_BASE}, CASE WHEN line = 1 THEN 'Remote' ELSE place END AS location, posted_at, true AS remote FROM s")
def s11(spark, sf_dir):
    body = F.struct(F.array(F.struct("title", F.col("company").alias("company_name"), "url", F.when(F.col("line") != 1, F.col("place")).alias("candidate_required_location"),
                                     F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("publication_date"), F.col("ext").alias("id"))).alias("jobs"))
    return shown(src.remotive(docs(spark, sf_dir, body)), "remote")


@query("S12_himalayas", _S + """ SELECT CAST(arrival AS VARCHAR) AS id, title, CASE WHEN line = 1 THEN 'One Call' ELSE company END AS company, CASE WHEN line = 2 THEN 'Remote' ELSE place || ', US' END AS location, posted_at FROM s""")
def s12(spark, sf_dir):
    body = F.struct(F.array(F.struct("title", F.when(F.col("line") == 1, F.lit("Name")).otherwise(F.col("company")).alias("companyName"), F.lit("one_call").alias("companySlug"), F.col("ext").alias("guid"),
                                     F.when(F.col("line") != 2, F.array(F.col("place"), F.lit("US"))).alias("locationRestrictions"),
                                     F.unix_seconds(F.col("posted_at").cast("timestamp")).cast("string").alias("pubDate"))).alias("jobs"))
    return shown(src.himalayas(docs(spark, sf_dir, body)))


@query("S13_weworkremotely", _S + """ SELECT url, CASE WHEN line = 1 THEN title ELSE 'Lead: ' || title END AS title, CASE WHEN line = 1 THEN '' ELSE company END AS company,
    CASE WHEN line = 2 THEN 'Remote' ELSE place END AS location, posted_at FROM s""")
def s13(spark, sf_dir):
    title = F.when(F.col("line") == 1, F.col("title")).otherwise(F.concat("company", F.lit(": Lead: "), "title"))
    text = F.concat(F.lit("<rss><channel><item><title><![CDATA["), title, F.lit("]]></title><link>"), "url", F.lit("</link>"),
                    F.when(F.col("line") != 2, F.concat(F.lit("<region>"), "place", F.lit("</region>"))).otherwise(F.lit("")),
                    F.lit("<description>&lt;p&gt;x&lt;/p&gt;</description><pubDate>"), F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item></channel></rss>"))
    p = sightings(spark, sf_dir).withColumn("payload", text).select("payload")
    return src.weworkremotely(p).select("url", "title", "company", "location", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("S13_feed_items", _S + """, d AS (SELECT *, ord % 50 = 7 AS bad FROM s) SELECT url, CASE WHEN line = 1 THEN title ELSE 'Lead: ' || title END AS title, CASE WHEN line = 1 THEN '' ELSE company END AS company,
    CASE WHEN line = 2 THEN 'Remote' ELSE place END AS location, posted_at, 'x & y' AS description FROM d WHERE NOT bad
    UNION ALL SELECT url, NULL, NULL, NULL, NULL, NULL FROM d WHERE bad""")
def s13_items(spark, sf_dir):
    """Feeds read item by item, in several splits; broken items stand beside the postings."""
    title = F.when(F.col("line") == 1, F.col("title")).otherwise(F.concat("company", F.lit(": Lead: "), "title"))
    end = F.when(F.col("ord") % 50 == 7, F.lit("</desc></item>")).otherwise(F.lit("</description></item>"))
    item = F.concat(F.lit("<item><link>"), "url", F.lit("</link><title><![CDATA["), title, F.lit("]]></title>"),
                    F.when(F.col("line") != 2, F.concat(F.lit("<region>"), "place", F.lit("</region>"))).otherwise(F.lit("")),
                    F.lit("<pubDate>"), F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><description>&lt;p&gt;x &amp;amp; y&lt;/p&gt;"), end)
    path = scratch(spark, "feeds")
    sightings(spark, sf_dir).select(item.alias("value")).write.text(path)
    rows = feeds.elements(spark, path, "item", feeds.RSS)
    good = feeds.feed_postings(rows).select("url", "title", "company", "location", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "description")
    none = F.lit(None).cast("string")
    bad = feeds.broken(rows).select(F.regexp_extract("raw", "<link>([^<]+)</link>", 1).alias("url"), none, none, none, F.lit(None).cast("timestamp_ntz"), none)
    return good.union(bad)


@query("S14_adzuna", _S + f" {_BASE}, place AS location, posted_at, CASE WHEN line % 2 = 0 THEN price END AS salary_min, true AS partial FROM s")
def s14(spark, sf_dir):
    body = F.struct(F.array(F.struct("title", F.struct(F.col("company").alias("display_name")).alias("company"), F.col("url").alias("redirect_url"), F.struct(F.col("place").alias("display_name")).alias("location"),
                                     iso().alias("created"), F.col("price").alias("salary_min"), F.when(F.col("line") % 2 == 1, F.lit("1")).otherwise(F.lit("0")).alias("salary_is_predicted"), F.col("ext").alias("id"))).alias("results"))
    return shown(src.adzuna(docs(spark, sf_dir, body)), "salary_min", "partial")


@query("S15_themuse", _S + f" {_BASE}, place || '; ' || CASE WHEN line = 1 THEN 'Flexible / Remote' ELSE 'Flexible' END AS location, posted_at, line = 1 AS remote FROM s")
def s15(spark, sf_dir):
    body = F.struct(F.array(F.struct(F.col("title").alias("name"), F.struct(F.col("company").alias("name")).alias("company"), F.struct(F.col("url").alias("landing_page")).alias("refs"),
                                     F.array(F.struct(F.col("place").alias("name")), F.struct(F.when(F.col("line") == 1, F.lit("Flexible / Remote")).otherwise(F.lit("Flexible")).alias("name"))).alias("locations"),
                                     iso().alias("publication_date"), F.col("ext").alias("id"))).alias("results"))
    return shown(src.themuse(docs(spark, sf_dir, body)), "remote")


@query("S16_jobicy", _S + f" {_BASE}, place AS location, posted_at, CASE WHEN line = 1 THEN price END AS salary_min FROM s")
def s16(spark, sf_dir):
    body = F.struct(F.array(F.struct(F.col("title").alias("jobTitle"), F.col("company").alias("companyName"), "url", F.col("place").alias("jobGeo"), F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("pubDate"),
                                     F.col("price").alias("salaryMin"), F.when(F.col("line") <= 2, F.lit("Yearly")).otherwise(F.lit("hourly")).alias("salaryPeriod"),
                                     F.when(F.col("line") == 2, F.lit("EUR")).otherwise(F.lit("usd")).alias("salaryCurrency"), F.col("ext").alias("id"))).alias("jobs"))
    return shown(src.jobicy(docs(spark, sf_dir, body)), "salary_min")


@query("S17_usajobs", _S + f" {_BASE}, place || ', B, C' AS location, posted_at, price AS salary_min, 'Sum ' || brand || CASE WHEN line = 1 THEN '' ELSE ' Qual' END AS description FROM s")
def s17(spark, sf_dir):
    d = F.struct(F.col("title").alias("PositionTitle"), F.col("company").alias("OrganizationName"), F.col("url").alias("PositionURI"), F.col("ext").alias("PositionID"),
                 F.array(*[F.struct(x.alias("LocationName")) for x in (F.col("place"), F.lit("B"), F.lit("C"), F.lit("D"))]).alias("PositionLocation"),
                 F.when(F.col("line") != 1, F.lit("Qual")).alias("QualificationSummary"), F.struct(F.struct(F.concat(F.lit("Sum "), "brand").alias("JobSummary")).alias("Details")).alias("UserArea"),
                 F.date_format("posted_at", "yyyy-MM-dd").alias("PublicationStartDate"), F.array(F.struct(F.col("price").cast("string").alias("MinimumRange"))).alias("PositionRemuneration"))
    body = F.struct(F.struct(F.array(F.struct(d.alias("MatchedObjectDescriptor"))).alias("SearchResultItems")).alias("SearchResult"))
    return shown(src.usajobs(docs(spark, sf_dir, body)), "salary_min", "description")


@query("S18_hackernews", _S + """ SELECT CAST(arrival AS VARCHAR) AS id, title, company, CASE WHEN line = 2 THEN '' ELSE place END AS location, posted_at, line = 1 AS remote FROM s WHERE line <= 4""")
def s18(spark, sf_dir):
    text = F.concat("company", F.lit(" | "), "title", F.when(F.col("line") != 2, F.concat(F.lit(" | "), "place")).otherwise(F.lit("")), F.lit(". More text<p>second line "), F.when(F.col("line") == 1, F.lit("REMOTE ok")).otherwise(F.lit("on site")))
    body = F.struct(F.col("arrival").alias("id"), text.alias("text"), F.unix_seconds(F.col("posted_at").cast("timestamp")).alias("time"), (F.col("line") == 5).alias("deleted"), (F.col("line") >= 6).alias("dead"))
    return shown(src.hackernews(docs(spark, sf_dir, body)), "remote")


@query("S19_hiringcafe", _S + """ SELECT url, title, company, place AS location, posted_at FROM s""")
def s19(spark, sf_dir):
    info = F.struct("title", "company", F.col("place").alias("location"), iso().alias("posted_at"))
    nested = F.struct(F.array(F.struct(info.alias("job_information"), F.col("url").alias("apply_url"))).alias("results"))
    flat = F.struct(F.array(F.struct("title", F.struct(F.col("company").alias("name")).alias("company"), "url", iso().alias("created_at"), F.col("place").alias("location"))).alias("hits"))
    s = sightings(spark, sf_dir).withColumn("payload", F.when(F.col("line") % 2 == 0, F.to_json(nested)).otherwise(F.to_json(flat))).select("payload")
    return src.hiringcafe(s).select("url", "title", "company", "location", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("S20_collect_stats", _S + " SELECT 'remotive' AS source, count(*) AS n FROM s UNION ALL SELECT 'workable', count(*) FROM s WHERE line <> 2")
def s20(spark, sf_dir):
    a = docs(spark, sf_dir, F.struct(F.array(F.struct("title", F.col("company").alias("company_name"))).alias("jobs")))
    b = sightings(spark, sf_dir).select(F.when(F.col("line") == 2, F.lit("<html>oops")).otherwise(F.to_json(F.struct(F.array(F.struct("title")).alias("jobs")))).alias("payload"), "company")
    return src.source_stats(src.collect({"remotive": a, "workable": b}))


@query("S21_watch_list", """SELECT s_name AS name, 'curated' AS origin FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 4 <> 2
    UNION ALL SELECT s_name, 'learned' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0""")
def s21(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cur = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 == 2, 3).alias("tier"), F.lit("curated").alias("origin"))
    lea = s.filter("s_suppkey % 3 = 0").select(F.upper("s_name").alias("name"), F.lit("learned").alias("origin"))
    return src.watch_list(cur, lea).select(F.concat(F.lit("S"), F.lower(F.substring("name", 2, 100))).alias("name"), "origin")


@query("S22_snapshot_reader", _S + """ SELECT company, title, count(*) AS n, min(salary_min) AS low FROM s WHERE title <> '' GROUP BY company, title""")
def s22(spark, sf_dir):
    """Snapshots written as JSON lists and read back; one broken file among them."""
    path = scratch(spark, "snapshots")
    s = sightings(spark, sf_dir)
    rows = s.select(F.to_json(F.array(F.struct("title", "company", "salary_min", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"), F.lit("x").alias("extra")))).alias("value"))
    # A list per row stands for a file; a broken document is skipped.
    rows.union(spark.createDataFrame([("[{broken",)], "value string")).write.text(path)
    files = spark.read.text(path)
    schema = ", ".join(f"{k}:{'string' if v == 'timestamp' else v}" for k, v in src.POSTING.items())
    out = files.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).select("r.*").filter("title <> '' and company <> ''")
    return out.groupBy("company", "title").agg(F.count("*").alias("n"), F.min("salary_min").alias("low"))


@query("S23_digest_read_back", _S + """ SELECT arrival AS doc, score, title, url, CASE WHEN score >= 50 THEN 'A' ELSE 'B' END AS tier, company, place AS location, CASE WHEN line = 1 THEN 'digest' ELSE source END AS source FROM s WHERE line <> 2""")
def s23(spark, sf_dir):
    s = sightings(spark, sf_dir)
    meta = F.when(F.col("line") == 2, F.lit("no meta")).otherwise(F.concat(F.lit("*"), "company", F.lit(" - "), "place", F.lit(" - "), F.when(F.col("line") == 1, F.col("company")).otherwise(F.col("source")), F.lit("*")))
    lines = F.array(F.concat(F.lit("## "), F.when(F.col("score") >= 50, F.lit("A")).otherwise(F.lit("B")), F.lit(" - today")),
                    F.concat(F.lit("### ["), F.col("score").cast("string"), F.lit("] ["), "title", F.lit("]("), "url", F.lit(")")), F.lit(""), meta, F.lit("- reason"))
    d = s.select(F.col("arrival").alias("doc"), F.posexplode(lines).alias("pos", "line"))
    return src.read_digest(d).drop("pos")


@query("S24_board_of_url", _S + """ SELECT arrival, CASE WHEN line = 1 THEN company WHEN line = 2 THEN company END AS employer FROM s""")
def s24(spark, sf_dir):
    n = F.regexp_extract("company", r"#(\d+)", 1)
    s = sightings(spark, sf_dir).select(
        "arrival", F.concat("company", F.lit("|"), F.col("arrival").cast("string")).alias("uid"), "company", "line",
        F.when(F.col("line") == 1, "workday").when(F.col("line") == 2, "smartrecruiters").otherwise("lever").alias("source"),
        F.when(F.col("line") == 1, F.concat(F.lit("https://T"), n, F.lit(".wd1.myworkdayjobs.com/JOBS/job/x"), "arrival"))
        .when(F.col("line") == 2, F.concat(F.lit("https://jobs.smartrecruiters.com/s"), n, F.lit("/"), "arrival")).otherwise(F.col("url")).alias("url"))
    b = table(spark, sf_dir, "supplier")
    k = F.regexp_extract("s_name", r"#(\d+)", 1)
    wd = b.select(F.col("s_name").alias("name"), F.lit("workday").alias("ats"), F.concat(F.lit("t"), k, F.lit(".wd1.myworkdayjobs.com")).alias("host"), F.lit("jobs").alias("site"), F.lit("").alias("slug"), F.col("s_suppkey").alias("pos"))
    sr = b.select(F.col("s_name").alias("name"), F.lit("smartrecruiters").alias("ats"), F.lit("").alias("host"), F.lit("").alias("site"), F.concat(F.lit("S"), k).alias("slug"), F.col("s_suppkey").alias("pos"))
    return src.board_of_url(s, wd.union(sr)).select("arrival", "employer")


@query("S25_aggregator_pages", _S + """ SELECT arrival AS page_id, title, 'Body of ' || company AS description FROM s WHERE line = 3""")
def s25(spark, sf_dir):
    s = sightings(spark, sf_dir)
    html = F.concat(F.lit("<h1>"), "title", F.lit("</h1><section class='adp-body x'> Job Description <p>Body of "), "company", F.lit("</p></section>"))
    pages = s.select(F.col("arrival").alias("page_id"), F.when(F.col("line") == 3, F.concat(F.lit("https://www.adzuna.com/details/"), "arrival")).otherwise(F.col("url")).alias("url"), html.alias("html"))
    return src.aggregator_pages(pages).drop("url")


@query("H10_snippet_upgrade", _S + """ SELECT arrival AS uid, CASE WHEN line IN (1, 3, 6, 7) THEN 1000 WHEN line = 5 THEN 150 ELSE 60 + 2 * 21 END AS body, line NOT IN (1, 3, 5, 6, 7) AS partial, CASE WHEN line IN (1, 3, 6, 7) THEN 60000e0 END AS salary_min FROM s""")
def h10(spark, sf_dir):
    """Long pages replace snippets; short ones only when they hold the snippet."""
    s = sightings(spark, sf_dir)
    snippet = F.concat(F.repeat(F.lit("word "), F.lit(20)), F.lit("cu"))
    rows = s.select(F.col("arrival").alias("uid"), F.when(F.col("line") == 3, F.concat(F.lit("https://www.adzuna.com/land/ad/"), "arrival")).otherwise(F.concat("url", F.lit("/"), "arrival")).alias("url"),
                    F.concat(F.lit("Great "), "title").alias("title"), snippet.alias("description"), F.lit(True).alias("partial"), F.lit(None).cast("double").alias("salary_min"), F.lit(None).cast("double").alias("salary_max"))
    body = F.when(F.col("line") == 5, F.concat(F.repeat(F.lit("word "), F.lit(20)), F.lit("cut off later with an honest ending of the posting"))).when(F.col("line") == 4, F.repeat(F.lit("other "), F.lit(40))).otherwise(F.repeat(F.lit("x"), F.lit(1000)))
    bodies = s.select(F.when(F.col("line") == 3, F.concat(F.lit("https://www.adzuna.com/details/"), "arrival")).otherwise(F.concat("url", F.lit("/"), "arrival")).alias("url"), F.lit(0).alias("pos"),
                      F.when(F.col("line") == 2, F.lit("Unrelated Careers")).otherwise(F.concat(F.lit("Great "), "title")).alias("title"), body.alias("description"),
                      F.struct(F.when(F.col("line") != 5, F.lit(60000.0)).alias("lo"), F.lit(None).cast("double").alias("hi")).alias("pay"))
    return src.upgrade_snippets(rows, bodies).select("uid", F.length("description").alias("body"), "partial", "salary_min")


# -- sinks ---------------------------------------------------------------------------------------


@query("K01_raw_postings", _S + """ SELECT source, count(*) AS n, max(length(title)) AS widest, min(length(uid)) AS uid_len FROM (SELECT source, substring(title || repeat('x', 500), 1, 500) AS title, repeat('u', 16) AS uid FROM s WHERE line <> 3) GROUP BY source""")
def k01(spark, sf_dir):
    path = scratch(spark, "raw")
    s = sightings(spark, sf_dir).withColumns({"title": F.when(F.col("line") == 3, F.lit("")).otherwise(F.concat("title", F.repeat(F.lit("x"), F.lit(500)))),
                                              "company": F.when(F.col("line") == 3, F.lit("")).otherwise(F.col("company"))})
    sinks.write_raw(sinks.raw_rows(s, "20011201", AS_OF), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("title")).alias("widest"), F.min(F.length("uid")).alias("uid_len"))


@query("K02_snapshot_rows", ARCHIVE_SQL + """SELECT url, score FROM keyed WHERE run_ts >= TIMESTAMP '2001-01-01' AND uid NOT IN (SELECT uid FROM keyed WHERE run_ts < TIMESTAMP '2001-01-01')""")
def k02(spark, sf_dir):
    k = keyed(spark, sf_dir).withColumns({"description": F.lit("x"), "reasons": F.array(F.lit("y"))})
    seen = k.filter("run_ts < timestamp '2001-01-01'").select("uid").distinct()
    out = sinks.snapshot_rows(k.filter("run_ts >= timestamp '2001-01-01'"), seen)
    return out.select("url", "score")


@query("K03_versioned_write", ARCHIVE_SQL + "SELECT uid, score FROM a WHERE score >= 60")
def k03(spark, sf_dir):
    root = scratch(spark, "candidates")
    a = history.fold_sightings(keyed(spark, sf_dir)).select("uid", "score")
    sinks.write_version(a.filter("score >= 80"), root, 1)
    sinks.write_version(a.filter("score >= 60"), root, 2)
    return sinks.read_version(spark, root).select("uid", "score")


_TIERED = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END"


def digest_input(spark, sf_dir):
    return sightings(spark, sf_dir).withColumns({
        "tier": F.expr(_TIERED), "location": F.col("place"), "uid": F.col("url"),
        "flags": F.when(F.col("line") == 1, F.array(F.lit("hybrid"), F.lit("entry-level"), F.lit("other"))).otherwise(F.array().cast("array<string>")),
        "reasons": F.array(*[F.lit(f"r{i}") for i in range(8)]), "salary_max": F.lit(None).cast("double"), "salary_min": F.lit(None).cast("double")})


@query("K04_digest_rows", _S + f""" SELECT url AS uid, {_TIERED} AS tier, '### [' || score || '] [' || title || '](' || url || ')' || chr(10) || '*' || company || ' - ' || place || ' - ' || source || '*' || chr(10)
    || CASE WHEN remote THEN 'Remote' ELSE place END || ' | ' || job_family || CASE WHEN line = 1 THEN ' | Entry level | Hybrid' ELSE '' END || chr(10) || '- r0' || chr(10) || '- r1' || chr(10) || '- r2' || chr(10) || '- r3' || chr(10) || '- r4' || chr(10) || '- r5' AS text
    FROM s WHERE score >= 45""")
def k04(spark, sf_dir):
    return sinks.digest_rows(digest_input(spark, sf_dir)).select("uid", "tier", "text")


@query("K05_notifications", _S + f""", t AS (SELECT *, {_TIERED} AS tier FROM s WHERE score >= 60 ORDER BY score DESC, url LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, url) AS place_no FROM t)
    SELECT CAST((place_no - 1) // 10 AS INT) AS batch, place_no AS place, url AS uid, tier, score, '[' || score || '] ' || title AS heading, url AS link FROM r""")
def k05(spark, sf_dir):
    return sinks.notifications(digest_input(spark, sf_dir))


@query("K07_one_per_board", """SELECT 'workday' AS ats, 'h' || (s_suppkey // 2) AS host, min_by(s_name, s_suppkey) AS name FROM supplier GROUP BY s_suppkey // 2""")
def k07(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit(2).alias("tier"), F.lit("workday").alias("ats"), F.concat(F.lit("h"), F.floor(F.col("s_suppkey") / 2)).alias("host"), F.col("s_suppkey").alias("pos"))
    return sinks.one_per_board(e).select("ats", "host", "name")


@query("K08_corpus_reread", """SELECT doc_id, substring(sha1(trim(t, ' ')), 1, 12) AS digest FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS t FROM documents)""")
def k08(spark, sf_dir):
    from ..operators import skills
    from .text_queries import TERMS
    path = scratch(spark, "corpus")
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.regexp_replace("text", "[^A-Za-z]+", " ").alias("raw"), F.lit("c").alias("company"), F.lit("t").alias("title"))
    sinks.corpus_rows(skills.parse_jds(d, TERMS), "2001-12-01").join(d.select("doc_id", "raw"), "raw").write.parquet(path)
    again = skills.parse_jds(spark.read.parquet(path).select("doc_id", "raw", "company", "title").distinct(), TERMS)
    return again.select("doc_id", "digest")


@query("K09_evidence_state", """WITH e AS (SELECT 't:' || event_type AS key, ts, user_id % 7 <> 0 AS is_on, user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'w:u' || user_id, ts, event_type <> 'error', user_id FROM events WHERE event_id % 2 = 1),
    g AS (SELECT key, max(ts) AS gone FROM e WHERE NOT is_on GROUP BY key)
    SELECT e.key, min(ts) AS added FROM e LEFT JOIN g USING (key) WHERE is_on AND (gone IS NULL OR ts > gone) GROUP BY e.key""")
def k09(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    e = ev.select(F.col("ts").alias("at"), F.when(even, F.col("user_id") % 7 != 0).otherwise(F.col("event_type") != "error").alias("on"),
                  F.when(even, F.col("event_type")).alias("term"), F.when(~even, F.concat(F.lit("U"), "user_id")).alias("word"), F.lit("").alias("text"), F.lit("f").alias("source"))
    return sinks.evidence_state(e).select("key", "added")
