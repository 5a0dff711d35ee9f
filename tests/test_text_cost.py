"""Work that must not grow with what the answer leaves out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hirescope.functions import keys, languages, pay, text
from hirescope.operators import market, score, segment, skills
from hirescope.plans import market_queries
from hirescope.profile import SAMPLE
from hirescope.sources import payloads


def test_amounts_are_read_once(spark):
    """The pattern of a pay range ran for every use of the amount it reads."""
    df = spark.createDataFrame(
        [("Salary range: $90k - $110,000. ",), ("Pay: $30.50/hr.",), ("Compensation $80k to start.",),
         ("Salary minimum 50,000 and maximum 70,000",), ("wage \x01 $40k-$50k",), ("no pay named",)], "t string")
    read = pay.parse_salary(F.col("t"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    got = [(r.p.lo, r.p.hi) for r in df.select(read.alias("p")).collect()]
    assert got == [(90000.0, 110000.0), (63440.0, 63440.0), (80000.0, None), (50000.0, 70000.0),
                   (40000.0, 50000.0), (None, None)]
    plan = df.select(read.alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 60


def test_pieces_are_those_of_split(spark):
    rows = ["", ";", "a;b", ";a;;b;", "a\x01b;c", "no cut"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(text.pieces(F.col("t"), "[;.]").alias("mine"), F.split("t", "[;.]", -1).alias("theirs")).collect()
    assert [r.mine for r in got] == [r.theirs for r in got]


def test_spans_come_of_one_reading(spark):
    """A pattern ran three times over a text to tell where it matches."""
    rows = ["", "none", "ab12cd3", "7", "\x015 and 6", "x\x01", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    found = df.select(text.spans(F.col("t"), r"\d+").alias("s"))
    got = [None if r.s is None else [tuple(s) for s in r.s] for r in found.collect()]
    assert got == [[], [], [(2, 4, "12"), (6, 7, "3")], [(0, 1, "7")], [(1, 2, "5"), (7, 8, "6")], [], None]
    assert "$0" in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_words_need_no_pattern(spark):
    df = spark.createDataFrame([("a night shift",), ("a day",), (None,)], "t string")
    out = df.select(text.mentions(F.col("t"), ("night", "late shift")).alias("m"))
    assert [r.m for r in out.collect()] == [True, False, None]
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_blocked_postings_need_no_rules(spark):
    """Every rule ran for postings whose score is 0 for their block alone."""
    rows = [("Senior Data Analyst", "Pay: $20/hr. Requirements: Terraform."), ("Data Analyst", "5 years required. SQL"), ("Data Analyst", "SQL")]
    df = spark.createDataFrame(rows, "title string, description string")
    scored = score.score_postings(df, SAMPLE, "2001-12-01 00:00:00")
    out = scored.select("score", "tier", "reasons", "points").collect()
    assert [(r.score, r.tier) for r in out[:2]] == [(0, "F"), (0, "F")] and out[0].reasons == ["title is out of band (senior)"]
    assert [r.points for r in out[:2]] == [[], []] and out[2].points
    wide = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", wide)
    assert plan.count("CASE WHEN isnull(_gate#") >= 10


def test_languages_are_told_from_where_words_start(spark):
    """Sixty names were tried at every letter, and each pattern at every text with a name."""
    rows = [("Office clerk", "Must speak French.", "", ["french"], []),
            ("Analyste", "", "", ["french"], []), ("x", "bespanish required", "", [], []),
            ("x", "Italian a\tmust", "hindi speaking", ["italian"], ["hindi"]),
            ("\x01Polish speaker", "bilingual required", "", ["polish", "bilingual"], [])]
    df = spark.createDataFrame([r[:3] for r in rows], "t string, b string, w string")
    asked = df.select(languages.language_asks(F.col("t"), F.col("b"), F.col("w")).alias("x"))
    assert [(list(r.x.must), list(r.x.nice)) for r in asked.collect()] == [r[3:] for r in rows]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z](?=[abc" in plan


def test_plain_ends_are_not_trimmed(spark):
    """Trimming by a set of spaces took every line apart, character by character."""
    rows = ["a", "", " a", "a ", " a b\n", "a\u0085", "é", " é ", "~", "\x7f", "\n", "a\u0085b"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    out = df.select(segment.strip(F.col("t")).alias("s"))
    assert [r.s for r in out.collect()] == ["a", "", "a", "a", "a b", "a\u0085", "é", "é", "~", "\x7f", "", "a\u0085b"]
    assert ">= !" in out._jdf.queryExecution().optimizedPlan().toString()


def test_headings_are_lowered_once_and_blocks_appended(spark):
    """Each list of needles lowered the line anew, and each block copied its list through a lazy one."""
    df = spark.createDataFrame([("What you’ll need:",), ("Nice to have",), ("Work experience",), ("We sell.",), ("",)], "t string")
    out = df.select(segment.section_of("t").alias("s"))
    assert [r.s for r in out.collect()] == ["required", "preferred", "required", None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(lambda") == 2  # the needles' and the subjects'
    blocks = df.select(segment._fold_blocks(segment._moves(F.array("t"))).alias("b"))
    assert "concat(namedlambda" not in blocks._jdf.queryExecution().optimizedPlan().toString()


def test_title_keys_split_without_patterns(spark):
    """Split compiled its pattern for every title, and each trailing word was tested twice."""
    rows = ["SCC - Data Analyst (Hybrid) | W2/1099 - Applicant Must Be Current Resident", "a\x01b (Remote) [x y] c",
            "(Hybrid)", "", "Analyst - Remote 12345", "Senior  Data-Analyst, II"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    out = df.select(keys.repost_title("t").alias("r"), keys.market_role("t").alias("m"), keys.discovery_title("t").alias("d"))
    assert [r.r for r in out.collect()] == ["data analyst", "a b x y c", "", "", "analyst", "senior data analyst ii"]
    assert [r.m for r in out.collect()][5] == "data analyst" and [r.d for r in out.collect()][5] == "senior data analyst ii"
    plan = df.select(text.word_list("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9]+" not in plan
    last = df.select(text.trailing_dropped(F.split("t", " "), lambda w: w.rlike("QQ")))._jdf.queryExecution().optimizedPlan().toString()
    assert last.count("RLIKE(lambda") == 1


def test_slugs_are_read_once(spark):
    """The filter on places read every slug anew, and what is left of a slug was cut off for each use."""
    slugs = ["data-analyst-columbus-ohio-united-states", "lead-dev-west-virginia", "x", "dev-x-north-carolina-united-states"]
    df = spark.createDataFrame([(f"<url><loc>https://j.org/jobs/{s}</loc></url>", "Acme") for s in slugs], "payload string, company string")
    out = payloads.sitemap(df, "/jobs/", ("columbus", "carolina"), ("lead",)).select("title", "location")
    assert sorted(tuple(r) for r in out.collect()) == [
        ("Data Analyst", "Columbus, Ohio, United States"), ("Dev", "X, North Carolina, United States"), ("Lead", "Dev, West Virginia")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9a-f]{12}") == 1


def test_bullets_are_chosen_once(spark):
    """The choice, a Python loop over parsed descriptions, ran once for the rows and once for their counts."""
    rows = [("a", [("sql", 3), ("python", 1)]), ("b", [("sql", 1)]), (None, [("sql", 1)]), ("c", [])]
    parsed = spark.createDataFrame(rows, "jd string, terms array<struct<term:string,weight:int>>")
    bullets = [{"id": i, "parent": p, "tags": (t,), "priority": n} for i, p, t, n in (("x", "job", "sql", 2), ("y", "job", "python", 1), ("z", "side", "r", 1))]
    entries = [{"id": "job", "min": 1, "max": 2}, {"id": "side", "min": 1, "max": 1}]
    chosen = skills.select_bullets(parsed, bullets, entries, ("sql", "python", "r"), 3)
    out = skills.drop_weakest(chosen, spark.createDataFrame([("job", 1), ("side", 1)], "entry string, floor int"))
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", "job", "y", 1.0, 1.0), ("b", "job", "y", 0.0, 0.0), ("c", "job", "x", 0.0, 0.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_value_counts_are_made_once(spark):
    """Values were counted once for the buckets' totals and once more for the ranks, each with its shuffle."""
    rows = [("f", "p", 10.0 * i, 1.0, 1, None) for i in range(4)] + [("f", "p", None, 2.0, 2, None)]
    df = spark.createDataFrame(rows, "job_family string, place string, pay double, age double, reach int, crowd double")
    peers = df.withColumn("role", F.lit("analyst"))
    ranks = market.factor_ranks(df, peers)
    got = {(r.factor, r.value): r.percentile for r in ranks.collect()}
    assert got[("pay", 0.0)] == 12.5 and got[("pay", 30.0)] == 87.5 and got[("fresh", 2.0)] == 90.0 and got[("reach", 1.0)] == 40.0
    assert "Union" not in ranks._jdf.queryExecution().optimizedPlan().toString()


def test_only_last_columns_may_be_left_out(spark):
    with pytest.raises(ValueError):
        market_queries._peers(spark, "/nowhere", without=("brand",))


def test_fields_of_a_node_are_read_together(spark):
    """Every field was a path of its own, and one that leads nowhere ends in an exception."""
    node = ('{"@type":"JobPosting","title":"A","datePosted":"2024-01-02","jobLocation":%s,"baseSalary":%s}')
    rows = [('[{"address":{"addressLocality":"Akron","addressRegion":"OH"}}]', '{"value":[{"value":"$5,000","unitText":"MONTH"}]}'),
            ('{"address":{"addressRegion":"OH"}}', '[{"value":{"minValue":30,"maxValue":"25","unitText":"HOUR"}}]'), ('"x"', "70000"), ("null", '{"value":"60000"}')]
    pages = spark.createDataFrame(
        [(i, f"u{i}", f'<script type="application/ld+json">{{"@graph":[{node % r}]}}</script>') for i, r in enumerate(rows)],
        "page_id int, url string, html string")
    out = payloads.postings_from_nodes(payloads.job_nodes(pages))
    got = [(r.title, r.location, r.pay.lo, r.pay.hi) for r in out.orderBy("page_id").collect()]
    assert got == [("A", "Akron, OH", 60000.0, 60000.0), ("A", "", 52000.0, 62400.0), ("A", "", None, None), ("A", "", 60000.0, 60000.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "$.jobLocation" not in plan and "$.value" not in plan
