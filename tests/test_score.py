"""The scorer, against invented postings with known verdicts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirescope.functions import pay, years
from hirescope.operators import score
from hirescope.profile import SAMPLE

AS_OF = "2026-06-01 00:00:00"
FIELDS = ("title string, company string, source string, location string, description string, "
          "remote boolean, partial boolean")


def post(title, desc="", source="greenhouse", location="Columbus, OH", company="Test Co",
         remote=False, partial=False):
    return (title, company, source, location, desc, remote, partial)


CASES = {
    "good": (post("Data Analyst", "You bring 1-2 years of experience with SQL, Excel and "
                  "Tableau. $65,000 - $80,000."), "A", 85, 100, (), ("disqualified",)),
    "senior": (post("Senior Data Manager", "8+ years required."), "F", 0, 0, ("seniority-mismatch",), ()),
    "stretch": (post("Data Analyst", "3-5 years in reporting operations with SQL and Excel.",
                     "remoteok", "Remote"), None, 30, 75, ("stretch-experience",), ("disqualified",)),
    "clearance": (post("Reporting Analyst", "Two years experience. Requires an active security "
                       "clearance."), "F", 0, 0, ("disqualified",), ()),
    "canada": (post("Operations Analyst", "2 years experience.", "lever", "Remote (Canada)"),
               "F", 0, 0, ("remote-but-not-US",), ()),
    "slash": (post("Operations/Data Analyst II", "SQL. 2 years experience.", "workday"), None, 60, 100, (), ()),
    "equivalent": (post("Data Analyst", "Bachelor of Science and 5 years of experience, or an equivalent "
                        "combination of education and experience. SQL."), None, 20, 70,
                   ("equivalency-accepted",), ("disqualified",)),
    "ten": (post("Business Analyst", "Minimum 10 years of experience required, or an equivalent combination "
                 "of education and experience."), "F", 0, 0, ("over-experienced-req",), ()),
    "calendar": (post("Data Analyst", "Revenue has grown since 2014 year over year. Own the dashboards in "
                      "Excel. Bachelor of Science required."), None, 50, 100, (), ("disqualified",)),
    "agency": (post("Data Analyst", "Our client is seeking an analyst. SQL. 2 years experience. Weekend "
                    "availability is required.", "remoteok", "Remote", "Apex Contract Staffing", True),
               None, 40, 84, ("staffing-agency", "off-hours-availability"), ()),
    "offtarget": (post("Safety Compliance Coordinator", "2 years experience.", "himalayas", "Remote",
                       remote=True), None, 0, 45, (), ()),
    "volunteer": (post("Data Analyst", "This is a volunteer position.", "himalayas", "Remote"),
                  "F", 0, 0, ("disqualified",), ()),
    "rich": (post("Data Analyst", "Salary: $250,000 - $310,000 per year."), "F", 0, 0, ("salary-above-level",), ()),
    "spanish": (post("Data Analyst", "Must be fluent in Spanish and English. SQL."), "F", 0, 0,
                ("language-required",), ()),
    "nice": (post("Data Analyst", "SQL and Excel. Spanish speaking is a plus."), None, 40, 100,
             ("language-preferred",), ()),
    "away": (post("Data Analyst", "SQL", location="Boise, ID"), "F", 0, 0, ("out-of-area",), ()),
    "snippet": (post("Data Analyst", "SQL, Excel, Tableau, Python", partial=True), None, 40, 84,
                ("partial-description", "unverified-experience"), ()),
    "entry": (post("Junior Data Analyst", "SQL. We will train. No prior experience."), None, 60, 100,
              ("entry-level", "no-experience-required"), ()),
}


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(k, *c[0]) for k, c in CASES.items()], "k string, " + FIELDS)
    return {r["k"]: r for r in score.score_postings(df, SAMPLE, AS_OF).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_verdict(scored, name):
    _, tier, low, high, need, ban = CASES[name]
    r = scored[name]
    said = f"{r['score']} {r['tier']} {r['flags']} {r['reasons']}"
    assert tier is None or r["tier"] == tier, said
    assert low <= r["score"] <= high, said
    for f in need:
        assert f in r["flags"], said
    for f in ban:
        assert f not in r["flags"], said


def test_points_add_up(scored):
    for r in scored.values():
        if r["points"]:
            assert sum(p["points"] for p in r["points"]) == r["score"], r


def test_required_years(scored):
    assert scored["calendar"]["required_years"] is None
    assert scored["ten"]["required_years"] == 10
    assert scored["good"]["required_years"] == 1


YEARS = [
    ("5+ years of experience", (5, 5)), ("3-5 years of experience", (3, 5)),
    ("Two (2) to four (4) years of experience", (2, 4)), ("0-2 years of experience", (0, 2)),
    ("0 years", None), ("Four (4) or more years", (4, 4)), ("in business for 15 years", None),
    ("25 years of service", None), ("6-12 months' experience", (0, 1)),
    ("within 6 months of experience", None), ("since 2014 year over year", None),
    ("1+ years of SQL and at least five years of Python", (5, 5)),
    ("Bachelor's and 2 years, or a high school diploma and 4 years", (2, 2)),
    ("x" * 220 + " Preferred qualifications: 7 years of cooking", None),
    ("x" * 220 + " Preferred qualifications. Minimum 5 years required", (5, 5)),
]


def test_required_band(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(YEARS)], "i int, t string")
    b, tail = years.binding_text(F.col("t")), years.preferred_tail(F.col("t"))
    band = years.required_band(years.year_bands(years.numerals(b)), years.month_bands(years.numerals(b)),
                               years.year_bands(years.numerals(tail)))
    got = {r["i"]: r["b"] for r in df.select("i", band.alias("b")).collect()}
    for i, (text, want) in enumerate(YEARS):
        assert (tuple(got[i]) if got[i] else None) == want, text


PAY = [
    ("Salary range: $65,000 - $80,000", (65000, 80000)), ("$95k to $120k", (95000, 120000)),
    ("Pay: $18.50/hr", (38480, 38480)), ("$200B in annualized spend", (None, None)),
    ("tuition up to $2,500", (None, None)), ("$1.00 - $1.00", (None, None)),
    ("Compensation $40,000 to start", (40000, None)),
    ("Salary. Minimum Pay Range: 65000 Maximum Pay Range: 90000", (65000, 90000)),
    ("CI$60,000 - CI$70,000", (None, None)), ("Salary US$70,000 – US$90,000", (70000, 90000)),
    ("$18/hr to $95,000", (37440, 95000)), ("$18/hr to $295,000", (37440, 37440)), ("hourly rate $20 - $25 per hour", (41600, 52000)),
    ("minimum 3 years, pay range posted, maximum 40 hours", (None, None)),
]


def test_parse_salary(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAY)], "i int, t string")
    none = F.lit(None).cast("double")
    got = {r["i"]: r["p"] for r in df.select("i", pay.parse_salary(F.col("t"), none, none).alias("p")).collect()}
    for i, (text, want) in enumerate(PAY):
        assert (got[i]["lo"], got[i]["hi"]) == want, text


def test_titles(spark):
    rows = [("Associate Director", None), ("Associate Analyst", "associate"), ("Data Analyst I", "level 1"),
            ("Lead Budget Analyst 00151", None), ("Associate Director / Associate Analyst", "associate"),
            ("Senior Associate", None)]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.withColumn("got", score.entry_level_marker(F.col("t"), SAMPLE)).collect():
        assert r["got"] == r["want"], r
    rows = [("Management Analyst", None), ("Project Manager", "manager"),
            ("Associate Data Engineer / Senior Data Engineer", None), ("Senior / Lead Analyst", "senior")]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.withColumn("got", score.seniority_block(F.col("t"), SAMPLE)).collect():
        assert r["got"] == r["want"], r


def test_missing_and_tool_years(spark):
    rows = [
        ("Requirements: Terraform and Kubernetes. SQL.", "X", ["Terraform", "Kubernetes"]),
        ("Requirements: Terraform preferred.", "X", []), ("Requirements: SQL, Terraform / other", "X", []),
        ("We integrate with Salesforce. Requirements: SQL", "X", []),
        ("Requirements: Salesforce administration", "Salesforce Inc", []),
    ]
    df = spark.createDataFrame(rows, "t string, c string, want array<string>")
    for r in df.withColumn("got", score.missing_tools(F.col("t"), F.col("c"), F.lit(False), SAMPLE)).collect():
        assert r["got"] == r["want"], r
    rows = [("4+ years of professional experience developing with Power BI and SQL Server", 4,
             {"power bi", "sql", "sql server"}), ("3+ years of experience. Tools: Excel", 0, set())]
    df = spark.createDataFrame([(a, b, list(c)) for a, b, c in rows], "t string, y int, p array<string>")
    for r in df.withColumn("got", score.tool_years(years.year_bands(years.numerals(F.col("t"))), SAMPLE)).collect():
        assert {x["product"] for x in r["got"]} == set(r["p"]), r
        assert all(x["years"] == r["y"] for x in r["got"])
