"""Registered queries for scoring (R) over postings with a templated body."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages, pay, years
from ..operators import score
from ..operators.market import annual
from ..operators.skills import jd_years
from ..profile import SAMPLE
from .registry import query
from .views import ADVERTS_SQL, AS_OF, adverts

_A = f"WITH a AS ({ADVERTS_SQL}), b AS (SELECT *, CAST(qty AS INT) AS q FROM a)"

# What each rule must say, from the columns the body was written from.
_FACTS = _A + """, f AS (SELECT *, ord % 8 AS t,
    CASE q % 4 WHEN 0 THEN line WHEN 1 THEN line END AS lo_years,
    CASE q % 4 WHEN 0 THEN line + 2 WHEN 1 THEN line END AS hi_years,
    CASE ord % 4 WHEN 0 THEN (40 + q) * 1000e0 WHEN 1 THEN (20 + q % 20 + 0.5e0) * 2080 WHEN 3 THEN (30 + q) * 1000e0 END AS pay_lo,
    CASE ord % 4 WHEN 0 THEN (60 + q) * 1000e0 WHEN 1 THEN (20 + q % 20 + 0.5e0) * 2080 END AS pay_hi,
    CASE line % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS missing FROM b),
r AS (SELECT *, coalesce(pay_hi, pay_lo) AS pay_top,
    CASE t WHEN 0 THEN 30 WHEN 2 THEN 30 WHEN 3 THEN 21 WHEN 7 THEN 18 ELSE 0 END AS title_pts,
    CASE WHEN line % 4 IN (0, 1) THEN 5 ELSE -100 END AS geo_pts,
    CASE WHEN lo_years IS NULL THEN 10 WHEN lo_years > 4 THEN -15 WHEN lo_years > 2 AND hi_years > 4 THEN 0
        WHEN lo_years > 2 THEN 2 WHEN hi_years > 4 THEN 7 WHEN hi_years > 2 THEN 12 ELSE 16 END AS years_pts,
    CASE WHEN q % 4 = 0 AND line > 2 THEN -12 ELSE 0 END AS tool_pts,
    CASE WHEN ord % 3 = 1 THEN -8 ELSE 0 END AS degree_pts,
    CASE WHEN q <= 7 THEN 5 WHEN q <= 14 THEN 2 WHEN q <= 45 THEN 0 ELSE -10 END AS fresh_pts,
    CASE WHEN q % 4 = 0 OR line % 3 = 1 THEN 4 ELSE 0 END + CASE WHEN q % 4 = 0 THEN 4 ELSE 0 END
        + CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END AS raw_stack FROM f),
p AS (SELECT *, greatest(0e0, least(1e0, ((pay_lo + pay_top) / 2 - 55000) / 25000)) AS share,
    CASE WHEN lo_years > 2 THEN years_pts ELSE least(20, years_pts + CASE WHEN t IN (2, 4) THEN 4 ELSE 0 END
        + CASE WHEN q % 4 = 2 THEN 6 ELSE 0 END) END AS exp_pts,
    greatest(0, 18 + least(7, raw_stack // 2) - 5 * missing) AS stack_pts FROM r),
s AS (SELECT *, CASE WHEN pay_top IS NULL THEN 5 WHEN pay_top < 55000 THEN -8
        ELSE 3 + CAST(round_even(share * 12, 0) AS INT) END AS pay_pts FROM p),
u AS (SELECT *, title_pts + geo_pts + exp_pts + tool_pts + degree_pts + fresh_pts + pay_pts + stack_pts AS total,
    t IN (1, 5) OR coalesce(lo_years > 4, false) AS blocked FROM s),
v AS (SELECT *, greatest(0, least(100, CASE WHEN title_pts = 0 THEN least(total, 40) ELSE total END)) AS capped FROM u),
w AS (SELECT *, CASE WHEN blocked THEN 0 WHEN capped > 84 AND (coalesce(lo_years > 2, false) OR missing >= 2) THEN 84
    ELSE capped END AS final FROM v)
"""
_TIER = "CASE WHEN final >= 85 THEN 'A' WHEN final >= 75 THEN 'B' WHEN final >= 60 THEN 'C' WHEN final >= 45 THEN 'D' ELSE 'F' END"


def facts(spark, sf_dir):
    return score.read_facts(adverts(spark, sf_dir), SAMPLE, AS_OF)


def scored(spark, sf_dir):
    return score.score_postings(adverts(spark, sf_dir), SAMPLE, AS_OF)


def _row(df):
    return {c: F.col(c) for c in df.columns}


@query("R01_year_bands", _A + """ SELECT arrival, CASE q % 4 WHEN 0 THEN concat(line, '-', line + 2) WHEN 1 THEN concat(line, '-', line)
    WHEN 3 THEN CASE WHEN q <= 20 THEN concat(q, '-', q, 'h') ELSE '' END ELSE '' END AS bands FROM b""")
def r01(spark, sf_dir):
    b = years.year_bands(years.numerals(F.col("description")))
    return adverts(spark, sf_dir).select("arrival", F.array_join(F.transform(b, lambda x: F.concat(
        x["low"].cast("string"), F.lit("-"), x["high"].cast("string"), F.when(x["history"], F.lit("h")).otherwise(F.lit("")))), ",").alias("bands"))


@query("R02_required_band", _FACTS + "SELECT arrival, lo_years AS low, hi_years AS high FROM f")
def r02(spark, sf_dir):
    return facts(spark, sf_dir).select("arrival", F.col("_band.low").alias("low"), F.col("_band.high").alias("high"))


@query("R03_jd_required_years", _A + """ SELECT arrival, CASE q % 4 WHEN 0 THEN line + 2 WHEN 1 THEN line WHEN 3 THEN CASE WHEN q <= 20 THEN q END END AS top FROM b""")
def r03(spark, sf_dir):
    return adverts(spark, sf_dir).select("arrival", F.array_max(jd_years(F.col("description"))).alias("top"))


@query("R04_blocking_years", _FACTS + "SELECT arrival, lo_years AS years FROM f")
def r04(spark, sf_dir):
    return facts(spark, sf_dir).select("arrival", F.col("_blocking").alias("years"))


@query("R05_parse_salary", _FACTS + "SELECT arrival, pay_lo AS lo, pay_hi AS hi FROM f")
def r05(spark, sf_dir):
    p = pay.parse_salary(F.col("description"), F.col("salary_min"), F.col("salary_max"))
    return adverts(spark, sf_dir).select("arrival", p.alias("p")).select("arrival", "p.lo", "p.hi")


@query("R06_annual", """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_quantity * 30 <= 0 THEN NULL WHEN l_quantity * 30 < 1000
    THEN l_quantity * 30 * 2080 ELSE l_quantity * 30 END AS pay FROM lineitem""")
def r06(spark, sf_dir):
    from .views import table
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                                                   F.col("l_partkey").alias("part"), annual(F.col("l_quantity") * 30).alias("pay"))


@query("R07_entry_level", _FACTS + "SELECT arrival, CASE t WHEN 2 THEN 'junior' WHEN 4 THEN 'associate' END AS marker FROM f")
def r07(spark, sf_dir):
    return adverts(spark, sf_dir).select("arrival", score.entry_level_marker(F.col("title"), SAMPLE).alias("marker"))


@query("R08_seniority_block", _FACTS + "SELECT arrival, CASE WHEN t IN (1, 5) THEN 'senior' END AS word FROM f")
def r08(spark, sf_dir):
    return adverts(spark, sf_dir).select("arrival", score.seniority_block(F.col("title"), SAMPLE).alias("word"))


@query("R09_title_tier", _FACTS + """SELECT arrival, CASE t WHEN 1 THEN 30 WHEN 5 THEN 10 ELSE title_pts END AS points FROM r""")
def r09(spark, sf_dir):
    return adverts(spark, sf_dir).select("arrival", score.title_tier(F.col("title"), SAMPLE)["points"].alias("points"))


@query("R10_geography", _FACTS + """SELECT arrival, geo_pts AS points, CASE line % 4 WHEN 0 THEN 'Columbus, OH metro' WHEN 1 THEN 'remote'
    WHEN 2 THEN 'onsite, outside commute range, not remote (no relocation planned)' ELSE 'located outside the US (canada)' END AS why FROM r""")
def r10(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.withColumn("g", score.geography(_row(f), SAMPLE)).select("arrival", "g.points", F.array_join("g.reasons", "; ").alias("why"))


@query("R11_stack", _FACTS + "SELECT arrival, stack_pts AS points FROM p")
def r11(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.withColumn("g", score.stack_rule(_row(f), SAMPLE)).select("arrival", "g.points")


@query("R12_missing_tools", _A + """ SELECT arrival, CASE line % 3 WHEN 0 THEN 'Terraform' WHEN 1 THEN 'Terraform,Kubernetes' ELSE '' END AS missing FROM b""")
def r12(spark, sf_dir):
    return facts(spark, sf_dir).select("arrival", F.array_join("_missing", ",").alias("missing"))


@query("R13_tool_years", _A + """ SELECT arrival, CASE WHEN q % 4 = 0 THEN concat('python:', line, ',sql:', line) ELSE '' END AS asked FROM b""")
def r13(spark, sf_dir):
    return facts(spark, sf_dir).select("arrival", F.array_join(F.array_sort(F.transform("_tool_years", lambda x: F.concat(
        x["product"], F.lit(":"), x["years"].cast("string")))), ",").alias("asked"))


@query("R14_experience", _FACTS + "SELECT arrival, exp_pts AS points FROM p")
def r14(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.withColumn("g", score.experience_rule(_row(f), SAMPLE)).select("arrival", "g.points")


@query("R15_degree", _FACTS + """SELECT arrival, degree_pts AS points, CASE ord % 3 WHEN 0 THEN 'bachelor''s in statistics - your degree'
    WHEN 1 THEN 'asks for a master''s degree - not held' ELSE '' END AS why FROM r""")
def r15(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.withColumn("g", score.education_rule(_row(f), SAMPLE)).select("arrival", "g.points", F.array_join("g.reasons", "; ").alias("why"))


@query("R16_agency", _A + """ SELECT arrival, CASE WHEN right(company, 1) = '3' THEN 'Apex Contract Staffing' WHEN right(company, 1) = '4'
    THEN 'agency repost (our client is seeking)' END AS firm FROM b""")
def r16(spark, sf_dir):
    a = adverts(spark, sf_dir)
    company = F.when(F.col("company").endswith("3"), F.lit("Apex Contract Staffing")).otherwise(F.col("company"))
    hay = F.concat(F.when(F.col("company").endswith("4"), F.lit("our client is seeking ")).otherwise(F.lit("")), F.lower("description"))
    return a.select("arrival", score.staffing_agency(company, hay, SAMPLE).alias("firm"))


@query("R17_dealbreakers", _A + """ SELECT arrival, CASE WHEN line = 2 THEN -14 WHEN line = 3 THEN -8 ELSE 0 END AS points,
    CASE WHEN line = 2 THEN 'off-hours-availability,heavy-travel' WHEN line = 3 THEN 'off-hours-availability' ELSE '' END AS flags FROM b""")
def r17(spark, sf_dir):
    a = adverts(spark, sf_dir)
    hay = F.concat(F.lower("description"), F.when(F.col("line") == 2, F.lit(" night shift, 50% travel")).when(
        F.col("line") == 3, F.lit(" weekend availability, night shift, fluent in x")).otherwise(F.lit("")))
    return a.withColumn("g", score.dealbreaker_rule({"_hay": hay}, SAMPLE)).select(
        "arrival", "g.points", F.array_join("g.flags", ",").alias("flags"))


@query("R18_syndication", _A + """ SELECT arrival, CASE WHEN line >= 5 THEN -5 WHEN line >= 3 THEN -2 ELSE 0 END AS points,
    line = 1 AND source IN ('greenhouse', 'lever', 'workday') AS low_competition FROM b""")
def r18(spark, sf_dir):
    a = adverts(spark, sf_dir)
    n = F.array_repeat(F.lit("x"), F.col("line") - 1)
    return a.withColumn("g", score.syndication_rule(F.col("source"), n)).select(
        "arrival", "g.points", F.array_contains("g.flags", "low-competition").alias("low_competition"))


@query("R19_freshness", _FACTS + "SELECT arrival, fresh_pts AS points, concat(q, 'd old when found') AS said FROM r")
def r19(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.withColumn("g", score.freshness_rule(F.col("_age"), SAMPLE)).select(
        "arrival", "g.points", F.regexp_extract(F.col("g.reasons")[0], r"^\d+d old when found", 0).alias("said"))


@query("R20_pay", _FACTS + "SELECT arrival, pay_pts AS points FROM s")
def r20(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.withColumn("g", score.pay_rule(F.col("_pay.lo"), F.col("_pay.hi"), SAMPLE)).select("arrival", "g.points")


@query("R21_disqualifiers", _A + """ SELECT arrival, CASE WHEN line = 4 THEN 'security clearance,commission only' ELSE '' END AS hits FROM b""")
def r21(spark, sf_dir):
    a = adverts(spark, sf_dir).withColumn("description", F.concat("description", F.when(
        F.col("line") == 4, F.lit("Commission only. Security Clearance.")).otherwise(F.lit(""))))
    return score.read_facts(a, SAMPLE, AS_OF).select("arrival", F.array_join("_blockers", ",").alias("hits"))


@query("R22_languages", _A + """ SELECT arrival, CASE WHEN line = 1 THEN 'spanish' WHEN line = 3 THEN 'bilingual' ELSE '' END AS must,
    CASE WHEN line = 2 THEN 'german' WHEN line = 5 THEN 'french' ELSE '' END AS nice FROM b""")
def r22(spark, sf_dir):
    body = F.concat("description", F.when(F.col("line") == 1, F.lit("Must be fluent in Spanish.")).when(
        F.col("line") == 2, F.lit("German language is a plus.")).when(F.col("line") == 3, F.lit("Bilingual required.")).when(
        F.col("line") == 4, F.lit("Polish the deck. Spanish Fork office.")).otherwise(F.lit("")))
    tail = F.when(F.col("line") == 5, F.lit("French speaking")).otherwise(F.lit(""))
    x = languages.language_asks(F.col("title"), body, tail)
    return adverts(spark, sf_dir).select("arrival", x.alias("x")).select(
        "arrival", F.array_join("x.must", ",").alias("must"), F.array_join("x.nice", ",").alias("nice"))


@query("R23_score", _FACTS + f"""SELECT arrival, final AS score, CASE WHEN blocked THEN 'F' ELSE {_TIER} END AS tier,
    lo_years AS required_years, CASE WHEN blocked THEN NULL ELSE pay_lo END AS salary_min,
    CASE WHEN blocked THEN NULL ELSE pay_hi END AS salary_max FROM w""")
def r23(spark, sf_dir):
    return scored(spark, sf_dir).select("arrival", "score", "tier", "required_years", "salary_min", "salary_max")


@query("R24_score_order", _FACTS + "SELECT arrival, final AS score FROM w ORDER BY final DESC, company, role_title, arrival LIMIT 200")
def r24(spark, sf_dir):
    df = scored(spark, sf_dir)
    return df.orderBy(F.desc("score"), "company", "title", "arrival").limit(200).select("arrival", "score")


@query("R25_rescore_report", _FACTS + f""", z AS (SELECT *, CASE WHEN blocked THEN 'F' ELSE {_TIER} END AS tier, CAST(q * 2 AS INT) AS was FROM w)
    SELECT tier, count(*) AS rows, count(*) FILTER (final <> was) AS moved FROM z GROUP BY tier""")
def r25(spark, sf_dir):
    return score.rescore_report(score.rescore(adverts(spark, sf_dir), SAMPLE, AS_OF))
