"""Registered queries for cleaning, identity and companies (P, H16, H17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import dates, geo, html, keys, labels, pay, places
from ..functions.text import alnum, squash
from ..operators import companies, score, segment
from ..operators.history import wants_body
from ..operators.market import stamp
from ..profile import SAMPLE
from .registry import query
from .views import ADVERTS_SQL, AS_OF, SIGHTINGS_SQL, adverts, sightings, spread, table

_S = f"WITH s AS ({SIGHTINGS_SQL})"


@query("P01_clean_text")
def p01(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages"))
    return p.select("page_id", html.clean_text("html").alias("text"))


@query("P01_clean_text_templated", _S + """ SELECT arrival, 'About ' || company || ':' || chr(10) || '• ' || title || chr(10) || '• 5+ years & <more>' || chr(10) || 'Bye' AS text FROM s""")
def p01_templated(spark, sf_dir):
    raw = F.concat(F.lit("<h2>About <em>"), "company", F.lit("</em> </h2><ul><li>"), "title",
                   F.lit("</li><li><p>5&#43; years &amp;  &lt;more&gt;</p></li></ul><div>Bye</div>"))
    return sightings(spark, sf_dir).select("arrival", html.clean_text(raw).alias("text"))


@query("P02_parse_date", """SELECT l_orderkey AS ord, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
    CASE l_linenumber WHEN 7 THEN NULL WHEN 2 THEN l_shipdate + INTERVAL 5 HOUR ELSE l_shipdate END AS posted_at, l_shipdate AS d FROM lineitem""")
def p02(spark, sf_dir):
    d = F.col("l_shipdate").cast("timestamp")
    f = lambda p: F.date_format(d, p)
    text = (F.when(F.col("l_linenumber") == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .when(F.col("l_linenumber") == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
            .when(F.col("l_linenumber") == 3, f("EEE, dd MMM yyyy HH:mm:ss +0000"))
            .when(F.col("l_linenumber") == 4, f("yyyy-MM-dd"))
            .when(F.col("l_linenumber") == 5, f("MM/dd/yyyy")).when(F.col("l_linenumber") == 7, F.lit("soon")))
    epoch = dates.parse_epoch(F.unix_millis(d))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.when(F.col("l_linenumber") == 6, epoch).otherwise(dates.parse_date(text)).cast("timestamp_ntz").alias("posted_at"),
        F.col("l_shipdate").alias("d"))


@query("P03_field_normalization", """SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM documents""")
def p03(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", squash("text").alias("text"))


@query("P04_P05_identity", _S + """ SELECT arrival, regexp_replace(lower(company || '|' || title), '[^a-z0-9]+', '', 'g') AS dedupe_key,
    substring(sha1(regexp_replace(lower(company || '|' || title), '[^a-z0-9]+', '', 'g')), 1, 16) AS uid FROM s""")
def p04(spark, sf_dir):
    return sightings(spark, sf_dir).withColumn("dedupe_key", keys.dedupe_key()).select("arrival", "dedupe_key", keys.uid().alias("uid"))


@query("P06_elapsed_age", _S + """ SELECT arrival, epoch_us(TIMESTAMP '2001-12-01' - posted_at) / 86400e6 AS age, CASE WHEN line = 1 THEN 0e0 WHEN line = 2 THEN NULL ELSE CAST(CAST(qty AS INT) AS DOUBLE) END AS found FROM s""")
def p06(spark, sf_dir):
    s = sightings(spark, sf_dir).withColumns({"p": F.col("posted_at").cast("timestamp"), "r": F.col("run_ts").cast("timestamp")})
    posted = F.when(F.col("line") == 1, F.col("r") + F.expr("interval 3 days")).when(F.col("line") != 2, F.col("p"))
    return s.select("arrival", dates.elapsed_age(F.col("p"), stamp(AS_OF)).alias("age"), dates.age_when_found(posted, F.col("r"), stamp(AS_OF)).alias("found"))


@query("P07_calendar_age", _S + """ SELECT arrival, CASE line WHEN 1 THEN NULL WHEN 2 THEN date_diff('day', CAST(run_ts AS DATE), DATE '2001-11-30')
    WHEN 3 THEN date_diff('day', CAST(posted_at + INTERVAL 22 HOUR AS DATE), DATE '2001-11-30') WHEN 4 THEN date_diff('day', CAST(posted_at + INTERVAL 3 HOUR - INTERVAL 5 HOUR AS DATE), DATE '2001-11-30')
    ELSE date_diff('day', CAST(posted_at AS DATE), DATE '2001-11-30') END AS age FROM s""")
def p07(spark, sf_dir):
    s = sightings(spark, sf_dir)
    p, r = F.col("posted_at").cast("timestamp"), F.col("run_ts").cast("timestamp")
    posted = (F.when(F.col("line") == 2, r + F.expr("interval 3 days")).when(F.col("line") == 3, p + F.expr("interval 27 hours"))
              .when(F.col("line") == 4, p + F.expr("interval 3 hours")).when(F.col("line") != 1, p))
    first = F.when(F.col("line") == 3, p + F.expr("interval 300 days")).otherwise(r)
    return s.select("arrival", dates.calendar_age(posted, first, F.lit("2001-12-01 02:00:00").cast("timestamp"), "America/New_York").alias("age"))


@query("P08_salary_text", _S + """ SELECT arrival, CASE line WHEN 1 THEN '$' || format('{:,}', CAST(round_even(price, 0) AS BIGINT)) || '-$' || format('{:,}', CAST(round_even(price * 2, 0) AS BIGINT))
    WHEN 2 THEN '$' || format('{:,}', CAST(round_even(price, 0) AS BIGINT)) || '+' WHEN 3 THEN 'up to $' || format('{:,}', CAST(round_even(price * 2, 0) AS BIGINT)) ELSE '' END AS salary FROM s""")
def p08(spark, sf_dir):
    lo = F.when(F.col("line").isin(1, 2), F.col("price")).otherwise(F.lit(0.0))
    hi = F.when(F.col("line").isin(1, 3), F.col("price") * 2)
    return sightings(spark, sf_dir).select("arrival", pay.salary_text(lo, hi).alias("salary"))


@query("P09_schema_round_trip", _S + " SELECT title, company, '' AS department, posted_at, salary_min, remote, score, arrival FROM s")
def p09(spark, sf_dir):
    s = sightings(spark, sf_dir).withColumn("posted_at", F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    doc = F.to_json(F.struct("title", "company", "posted_at", "salary_min", "remote", "score", F.lit(1).alias("unknown_key")))
    back = s.select("arrival", F.from_json(doc, schema.ddl(schema.STORED)).alias("j")).select("arrival", "j.*")
    c = schema.conform(back.withColumn("posted_at", dates.parse_date("posted_at")), schema.POSTING | {"arrival": "bigint"})
    return c.select("title", "company", "department", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "salary_min", "remote", "score", "arrival")


@query("P10_division_in", _S + """ SELECT arrival, CASE line WHEN 1 THEN company WHEN 2 THEN 'Dept of Prof & Occup Reg' ELSE '' END AS division FROM s""")
def p10(spark, sf_dir):
    text = (F.when(F.col("line") == 1, F.concat(F.lit("Title: Clerk Agency: "), F.regexp_replace("company", "#", "-"), F.lit(" Location: Main Office Salary: 1")))
            .when(F.col("line") == 2, F.lit("Pay Band: 4 Agency: Dept of Prof & Occup Reg Location: DPOR Agency Website: x"))
            .when(F.col("line") == 3, F.lit("Department: Engineering Location: x")).when(F.col("line") == 4, F.lit("the agency: irrelevant here. We are hiring."))
            .otherwise(F.concat(F.repeat(F.lit("x"), F.lit(1600)), F.lit(" Agency: Late Name Location: y"))))
    return sightings(spark, sf_dir).select("arrival", F.regexp_replace(labels.division_in(text), "^(Supplier)-", "$1#").alias("division"))


@query("P12_title_keys", _S + """ SELECT arrival, lower(p_plain) AS market_role, lower(p_plain) AS repost, 'senior ' || lower(p_plain) || ' ii remote' AS discovery FROM (SELECT *, title AS p_plain FROM s)""")
def p12(spark, sf_dir):
    decorated = F.concat(F.lit("SCC - "), "title", F.lit(" (Hybrid) | W2/1099 - Applicant Must Be Current Resident"))
    return sightings(spark, sf_dir).select(
        "arrival", keys.market_role(F.concat(F.lit("Senior "), "title", F.lit(", II"))).alias("market_role"),
        keys.repost_title(decorated).alias("repost"),
        keys.discovery_title(F.concat(F.lit("Senior: "), "title", F.lit(" II (Remote)"))).alias("discovery"))


@query("P13_region", _S + """ SELECT arrival, CASE line WHEN 1 THEN 'OH' WHEN 2 THEN 'Remote' WHEN 3 THEN 'CA' WHEN 4 THEN 'WA' WHEN 5 THEN 'Elsewhere' WHEN 6 THEN 'NY' ELSE 'Remote' END AS region FROM s""")
def p13(spark, sf_dir):
    loc = F.expr("case line when 1 then 'Columbus, Ohio (Main), USA' when 2 then 'San Francisco (Remote)' when 3 then 'San Francisco' "
                 "when 4 then 'Seattle, washington' when 5 then place when 6 then 'NYC, Earth' else 'Boise, ID' end")
    return sightings(spark, sf_dir).select("arrival", places.region(loc, F.col("line") == 7).alias("region"))


@query("P14_job_family", f"WITH a AS ({ADVERTS_SQL}) " + """SELECT arrival, CASE ord % 8 WHEN 4 THEN 'other-field' WHEN 5 THEN 'engineering' WHEN 6 THEN 'clerical' ELSE 'analyst' END AS family FROM a""")
def p14(spark, sf_dir):
    return adverts(spark, sf_dir).select("arrival", score.job_family(F.col("title"), SAMPLE).alias("family"))


@query("P15_places", _S + """ SELECT arrival, CASE line WHEN 1 THEN 'oh' WHEN 2 THEN 'wv' WHEN 3 THEN '' WHEN 4 THEN 'ga' ELSE '' END AS state, CASE WHEN line IN (1, 3) THEN 'columbus' END AS place FROM s""")
def p15(spark, sf_dir):
    loc = F.expr("case line when 1 then 'Columbus, OH 43004' when 2 then 'Charleston, West Virginia' when 3 then 'Columbus' when 4 then 'Columbus, Ga.' else concat('New Columbusville ', place) end")
    return sightings(spark, sf_dir).select("arrival", geo.state_named(loc).alias("state"), geo.place_named(loc, ("columbus", "new kent"), "oh").alias("place"))


@query("P16_domain_of", """SELECT page_id, regexp_replace(regexp_extract(url, '//([^/?#:]*)', 1), '^www\\.', '') AS host, CASE page_id % 3 WHEN 0 THEN 'x.com' WHEN 1 THEN 'school.edu' ELSE '' END AS other FROM pages""")
def p16(spark, sf_dir):
    other = F.expr("case page_id % 3 when 0 then 'www.careers.x.com/a?b' when 1 then 'https://maps.deep.school.edu:80/x' else 'nowhere' end")
    return table(spark, sf_dir, "pages").select("page_id", companies.domain_of("url").alias("host"), companies.domain_of(other).alias("other"))


@query("P17_same_company", """SELECT s_suppkey AS id, s_suppkey % 3 <> 1 AS same FROM supplier""")
def p17(spark, sf_dir):
    other = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, F.lit(" Financial Group, Inc.")).when(F.col("s_suppkey") % 3 == 1, F.lit(" Advanced Materials")).otherwise(F.lit(" Bank")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (keys.same_company_key("s_name") == keys.same_company_key(other)).alias("same"))


@query("P18_slugs_and_domains", """SELECT s_suppkey AS id, lower(replace(s_name, '#', '')) || ',' || lower(replace(s_name, '#', '-')) AS slugs,
    lower(replace(s_name, '#', '')) || '.com,supplier.com' AS domains, 8 - 2 AS guesses FROM supplier""")
def p18(spark, sf_dir):
    name = F.concat("s_name", F.lit(" Inc"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array_join(companies.board_slugs(name), ",").alias("slugs"),
        F.array_join(companies.likely_domains(name), ",").alias("domains"), F.size(companies.site_guesses(name)).alias("guesses"))


@query("P19_hosting", """SELECT page_id, ['greenhouse', 'workday', 'lever', ''][page_id % 4 + 1] AS ats, CASE page_id % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'gnw' WHEN 2 THEN 'foo-' || page_id ELSE '' END AS tenant,
    CASE WHEN page_id % 4 = 1 THEN 'GNW' END AS site FROM pages""")
def p19(spark, sf_dir):
    link = F.expr("case page_id % 4 when 0 then '<a href=\"https://boards.greenhouse.io/acme/jobs\">' when 1 then '<a href=\"https://gnw.wd1.myworkdayjobs.com/en-US/GNW/job\">' "
                  "when 2 then concat('https://jobs.lever.co/foo-', page_id, '/') else '' end")
    page = F.concat("html", link)
    h = companies.hosting("url", page)
    return spread(table(spark, sf_dir, "pages")).select("page_id", h["ats"].alias("ats"), h["tenant"].alias("tenant"), companies.workday_board("url", page)["site"].alias("site"))


@query("P20_anchors", """SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href FROM pages""")
def p20(spark, sf_dir):
    return companies.anchors(spread(table(spark, sf_dir, "pages"))).select("page_id", "href")


@query("P20_roster", """SELECT page_id, 'partner' || page_id || '.org' AS site, 'Partner ' || page_id AS name FROM pages""")
def p20_roster(spark, sf_dir):
    extra = F.concat(F.lit('<a href="http://www.partner'), "page_id", F.lit('.org/x">Partner '), "page_id", F.lit(' Holdings</a><a href="http://partner'),
                     "page_id", F.lit('.org">Partner '), "page_id", F.lit('</a><a href="https://www.facebook.com/x">Our page</a><a href="http://q.org">Home</a>'))
    pages = spread(table(spark, sf_dir, "pages")).withColumn("html", F.concat("html", extra))
    return companies.roster(pages)


@query("P20_careers_links", """SELECT page_id, 'https://jobs.x' || page_id || '.com/' AS link, -3 AS rank, 1 AS place FROM pages
    UNION ALL SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/careers', 0, 2 FROM pages""")
def p20_careers(spark, sf_dir):
    extra = F.concat(F.lit('<a href="/careers">Work with us</a><a href="https://jobs.x'), "page_id", F.lit('.com/">Open roles</a>'))
    pages = table(spark, sf_dir, "pages").withColumn("html", extra)
    return companies.careers_links(pages)


@query("P21_four_places", _S + """ SELECT arrival, ['HYBRID', 'Columbus', 'REMOTE', 'ON-SITE'][line % 4 + 1] AS place, CASE WHEN line % 2 = 0 THEN 95000e0 + ord END AS pay FROM s""")
def p21(spark, sf_dir):
    loc = F.expr("case line % 4 when 0 then 'Hybrid - Columbus, OH' when 1 then 'columbus' when 2 then 'Remote-USA' else place end")
    text = F.when(F.col("line") % 2 == 0, F.concat(F.lit("$ "), F.format_number(F.lit(95000) + F.col("ord"), 0), F.lit(" - $115,000 a year"))).otherwise(F.lit("competitive"))
    return sightings(spark, sf_dir).select("arrival", companies.four_places(loc, "Columbus").alias("place"), companies.first_number(text).alias("pay"))


@query("P22_plain_text", _S + """ SELECT arrival, title || chr(10) || chr(10) || '- ' || company || chr(10) || chr(10) || 'A & B' AS page, title || chr(10) || chr(10) || '- ' || company || chr(10) || chr(10) || 'A & B' AS jd FROM s""")
def p22(spark, sf_dir):
    page = F.concat(F.lit("<script>x</script><p>"), "title", F.lit("</p><li>"), "company", F.lit("</li><br/><br>A &amp; B"))
    jd = F.concat("title", F.lit("\n•  "), "company", F.lit("\n\n\n\nA &amp;\tB"))
    return sightings(spark, sf_dir).select("arrival", F.regexp_replace(html.html_to_text(page), "\n- ", "\n- ").alias("page"), segment.jd_clean(jd).alias("jd"))


@query("P23_company_repair", _S + """ SELECT arrival, CASE line WHEN 1 THEN 'Starrez Two' ELSE company END AS company, line = 1 AS repaired, line = 2 AS stuck FROM (SELECT * REPLACE (CASE WHEN line = 2 THEN 'name' ELSE company END AS company) FROM s)""")
def p23(spark, sf_dir):
    s = sightings(spark, sf_dir).withColumns({"company": F.when(F.col("line") <= 2, F.lit("name")).otherwise(F.col("company")),
                                              "url": F.when(F.col("line") == 1, F.lit("https://himalayas.app/companies/starRez_two/jobs/x")).otherwise(F.col("url"))})
    return companies.repair_companies(s).select("arrival", "company", "repaired", "stuck")


@query("P24_confirm_sites", """SELECT 'Acme Widgets unit' || (page_id + 100000) AS name, regexp_replace(regexp_extract(url, '//([^/?#:]*)', 1), '^www\\.', '') AS host FROM pages WHERE page_id % 2 = 0
    UNION SELECT 'Solo' , regexp_replace(regexp_extract(url, '//([^/?#:]*)', 1), '^www\\.', '') FROM pages WHERE page_id % 4 = 0""")
def p24(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("ACME Widgets unit"), F.col("page_id") + 100000, F.lit(" - solo"))).otherwise(F.lit("Other"))
    pages = p.withColumn("html", F.concat(F.lit("<title>"), title, F.lit("</title>"), F.when(F.col("page_id") % 4 == 0, F.lit("in Columbus, Ohio")).otherwise(F.lit(""))))
    names = p.select(F.concat(F.lit("Acme Widgets unit"), F.col("page_id") + 100000).alias("name"), F.col("url").alias("site")).union(p.select(F.lit("Solo"), "url"))
    return companies.confirm_sites(names.distinct(), pages, ("columbus", "ohio", "oh"))


@query("P25_usable_body", _S + " SELECT arrival, CAST(qty AS INT) * 10 >= 400 AND line NOT IN (2, 3) AS usable FROM s")
def p25(spark, sf_dir):
    from ..operators.queue import usable_body
    flags = F.when(F.col("line") == 3, F.array(F.lit("partial-description"))).otherwise(F.array().cast("array<string>"))
    return sightings(spark, sf_dir).select("arrival", usable_body(F.expr("repeat('x', cast(qty as int) * 10)"), F.col("line") == 2, flags).alias("usable"))


# -- companies ---------------------------------------------------------------------------------

_PINS = """WITH p AS (SELECT s_name AS supp, p_name, l_linenumber AS line, CASE WHEN l_linenumber = 1 THEN s_name ELSE 'Cafe ' || p_name END AS name,
    lower(replace(s_name, '#', '')) || '.com' AS site FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def pins(spark, sf_dir):
    l, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    j = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    tags = F.when(F.col("l_linenumber") == 2, F.create_map(F.lit("brand"), F.lit("x"))).when(
        F.col("l_linenumber") == 3, F.create_map(F.lit("amenity"), F.lit("hospital"))).otherwise(F.create_map(F.lit("shop"), F.lit("yes")))
    return j.select(F.when(F.col("l_linenumber") == 1, F.col("s_name")).otherwise(F.concat(F.lit("Cafe "), "p_name")).alias("name"),
                    F.concat(F.lit("https://www."), F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), F.lit(".com/visit")).alias("website"), tags.alias("tags"))


@query("H16_collapse_pins", _PINS + " SELECT site, coalesce(max(CASE WHEN line = 1 THEN name END), '?') AS name, count(*) AS pins, bool_or(line = 2) AS branded, bool_or(line = 3) AS employer_tag FROM p GROUP BY site")
def h16(spark, sf_dir):
    return companies.collapse_pins(pins(spark, sf_dir))


@query("H17_merge_companies", _PINS + """, m AS (SELECT site, count(*) AS pins, bool_or(line = 2) AS branded, bool_or(line = 3) AS employer_tag FROM p GROUP BY site),
    x AS (SELECT lower(replace(s_name, '#', '')) || '.com' AS site, s_suppkey % 2 = 0 AS listed, s_suppkey % 3 = 0 AS wiki FROM supplier)
    SELECT x.site AS company_key, CASE WHEN listed THEN 1 ELSE 0 END * 100 + CASE WHEN wiki THEN 40 ELSE 0 END + CASE WHEN listed OR wiki THEN 30 ELSE 0 END + 10
    + CASE WHEN employer_tag THEN 4 ELSE 0 END + least(pins, 6) * 3 AS score, pins FROM m JOIN x USING (site)""")
def h17(spark, sf_dir):
    from functools import reduce
    m = companies.collapse_pins(pins(spark, sf_dir)).select("name", "site", F.lit("map").alias("source"), "pins", "branded", "employer_tag", F.lit(False).alias("listed"), F.lit(0).alias("pos"))
    s = table(spark, sf_dir, "supplier")
    site = F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), F.lit(".com"))
    def src(cond, source, listed):
        return s.filter(cond).select(F.col("s_name").alias("name"), site.alias("site"), F.lit(source).alias("source"), F.lit(0).cast("long").alias("pins"),
                                     F.lit(False).alias("branded"), F.lit(False).alias("employer_tag"), F.lit(listed).alias("listed"), F.lit(1).alias("pos"))
    every = reduce(lambda a, b: a.unionByName(b), [m, src("s_suppkey % 2 = 0", "listed", True), src("s_suppkey % 3 = 0", "wikidata", False)])
    return companies.merge_companies(every).select("company_key", "score", "pins")
