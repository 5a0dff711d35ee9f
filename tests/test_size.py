"""Steps whose work must follow the rows: cases in which they did not."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirescope.functions import keys, text
from hirescope.operators import companies, segment, skills
from hirescope.plans import market_queries, skill_queries, views
from hirescope.sources import payloads, sinks
from hirescope.streaming import landing


def test_phrasings_of_one_id_meet_by_their_numbers(spark):
    """an id with many bullets and phrasings; every pair is still told."""
    bullets = spark.createDataFrame(
        [("a", "p", ["t"], f"Cut {n} of 1,200.") for n in (5, 5, 6)], "id string, parent string, tags array<string>, text string")
    variants = spark.createDataFrame([("a", "Saved 777 of 1200"), ("a", "Saved 777 of 1200"), ("a", "Cut 5 of 1200")], "bullet string, text string")
    entries, terms = spark.createDataFrame([("p",)], "id string"), spark.createDataFrame([("t",)], "term string")
    out = skills.content_violations(bullets, entries, terms, variants).filter("rule = 'invented-number'")
    assert sorted(r.detail for r in out.collect()) == ["5"] + ["777"] * 6
    joined = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert joined.count("Aggregate [") == 2


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    """a file of many splits whose rows are in one row group is one task's work."""
    path = str(tmp_path / "one.parquet")
    spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores

        def most(d):
            return d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        assert most(df) == 60_000
        assert most(views.spread(df)) < 60_000 / cores * 1.5
        assert most(views.spread(df, 1_000)) < 1_500
        assert sorted(r.id for r in views.spread(df, 1_000).select("id").collect()) == list(range(60_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert views.spread(spark.read.parquet(path).limit(0)).count() == 0


def test_raw_rows_are_made_once(spark, tmp_path):
    """good and refused rows come from one pass over the postings."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        made.add(1)
        return x

    raw = spark.createDataFrame([("a", "k"), ("", "k"), ("b", None)], "uid string, dedupe_key string").select(
        told("uid").alias("uid"), "dedupe_key", F.lit("2001-12-01 00:00:00").cast("timestamp").alias("collected_at"))
    sinks.write_raw(raw, str(tmp_path / "raw"))
    assert made.value == 3
    assert [r.uid for r in spark.read.parquet(str(tmp_path / "raw")).collect()] == ["a"]
    assert spark.read.parquet(str(tmp_path / "raw-refused")).count() == 2


def test_dedupe_key_needs_no_squashing(spark):
    """the key of every kind of white space, nulls and letters of more than one byte."""
    rows = [("Acme\u00a0 Inc", " Data\t\u2003Analyst II"), (None, "\u0130stanbul \u03a3 desk"), ("A|B", None), (None, None)]
    got = spark.createDataFrame(rows, "company string, title string").select(keys.dedupe_key().alias("k")).collect()
    assert [r.k for r in got] == ["acmeincdataanalystii", "istanbuldesk", "ab", ""]


def test_sites_are_confirmed_by_word(spark):
    """F8: one host with many pages and names; names meet titles by their rarest word."""
    pages = spark.createDataFrame(
        [(f"https://www.widgetworks.org/{i}", f"<title>ACME Widgets unit{i} - Solo_x</title>{'Columbus, Ohio' if i == 3 else ''}") for i in range(40)]
        + [("https://other.org/", "<title>Acme internationalisation</title>"), ("https://plain.org/", "no title, Ohio")],
        "url string, html string")
    names = spark.createDataFrame(
        [(f"Acme Widgets unit{i}", "https://widgetworks.org/x") for i in range(30, 50)]
        + [("Solo", "http://widgetworks.org"), ("Gone", "http://widgetworks.org"), ("Acme nationalisation", "https://other.org/a"), ("Ohio", "https://plain.org"),
           ("Acme Widgets unit3", "https://other.org"), (None, "https://widgetworks.org"), ("Solo", None)], "name string, site string")
    out = companies.confirm_sites(names, pages, ("columbus", "ohio", "oh"))
    assert sorted(map(tuple, out.collect())) == sorted(
        [(f"Acme Widgets unit{i}", "widgetworks.org") for i in range(30, 40)] + [("Solo", "widgetworks.org"), ("Acme nationalisation", "other.org")])
    last = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, ")[1]
    assert "_word" in last.split("\n")[0]


def test_the_files_of_a_batch_are_told(spark, tmp_path):
    """F16: a batch of several files can be handed over again as a whole."""
    folder, paths = str(tmp_path / "landing"), [str(tmp_path / p) for p in ("postings", "unreadable")]
    jobs = '{"jobs": [{"title": "Analyst", "absolute_url": "https://x.org/1", "id": "1"}]}'
    spark.range(30).selectExpr(f"""concat('{{"doc_id": "', id, '", "source": "greenhouse", "slug": "acme", "company": "Acme", "payload": {jobs}}}') AS value""").repartition(3).write.text(folder)
    handed = {}
    landing.land_all(spark, folder, *paths, str(tmp_path / "ckpt"), files_per_batch=2, handed=handed)
    assert {k: len(v) for k, v in handed.items()} == {0: 2, 1: 1}
    before = [spark.read.parquet(p).groupBy("batch").count().orderBy("batch").collect() for p in paths[:1]]
    landing.land(*paths)(landing.landed(spark, handed[0], stream=False), 0)
    assert before == [spark.read.parquet(p).groupBy("batch").count().orderBy("batch").collect() for p in paths[:1]]
    assert spark.read.parquet(paths[0]).count() == 30


def test_barriers_read_sections_once(spark, monkeypatch):
    read, own = [], segment.requirement_lines
    monkeypatch.setattr(segment, "requirement_lines", lambda *a: read.append(a) or own(*a))
    rows = [(str(i), "Acme", "Analyst", 50, i % 2 == 0, "Requirements:\n- 9 years of SQL\n- Excel") for i in range(6)]
    posts = spark.createDataFrame(rows, "uid string, company string, title string, score int, applied boolean, description string")
    monkeypatch.setattr(skill_queries, "jds", lambda *a: posts)
    out = skill_queries.g05_barriers(spark, "").collect()
    assert len(read) == 1
    assert {(r["set"], r["label"], r["count"], r["pct"]) for r in out} == {
        ("listed", "9+ years of experience", 6, 100.0), ("applied", "9+ years of experience", 3, 100.0)}


def test_a_test_for_words_finds_what_the_words_find(spark):
    words = ["what you need", "what you'll need", "you have", "a", "ab", "c++", ".net", "x-y", "[z", "eeo"]
    texts = ["", "what you", "what you'll need", "we have", "you have it", "zab", "c+", "c++", "net", ".net", "x-", "x-y", "[z", "z", "see eeo"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for some in (words, [w for w in words if w != "a"], ["c++", "x-y"]):
        got = {r.t for r in df.filter(F.col("t").rlike(text.anywhere(some))).collect()}
        assert got == {t for t in texts if any(w in t for w in some)}


def test_trimming_takes_what_the_pattern_takes(spark):
    ends = ["", " ", "\n", "\r\n", "\t", "\u0085", " \u0085", "\u0085 ", " ", " ", " 　", "​", "\x1c", ":", ": ", "::\u0085"]
    df = spark.createDataFrame([(a + b + c,) for a in ends for b in ("", "x", "x  y") for c in ends], "t string")
    old = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    c = F.col("t")
    bad = df.filter((segment.strip(c) != old(c)) | (segment.bare_title(c) != old(F.regexp_replace(old(c), ":+$", ""))))
    assert bad.collect() == []


def test_pages_are_read_once(spark):
    """a document is parsed once, its pay's texts are taken once, whatever the shape of the pay."""
    pay = {
        "mark": ('{"value":{"minValue":"30","maxValue":"25","unitText":"hour"}}', (52_000.0, 62_400.0)),
        "list": ('[{"value":[{"value":"$5,000","unitText":"MONTH"}]},{"value":1}]', (60_000.0, 60_000.0)),
        "plain": ('{"value":70000}', (70_000.0, 70_000.0)),
        "unit": ('{"unitText":"HOUR","value":{"maxValue":30}}', (None, 62_400.0)),
        "small": ('{"value":{"minValue":1,"maxValue":2}}', (None, None)),
        "none": ("null", (None, None)),
        "odd": ("[]", (None, None)),
        "word": ('"much"', (None, None)),
    }
    head, foot = '<script type="application/ld+json">', "</script>"
    pages = spark.createDataFrame(
        [(i, k, f'{head}{{bad{foot}{head}{{"@type":"JobPosting","title":"{k}","baseSalary":{v}}}{foot}') for i, (k, (v, _)) in enumerate(pay.items())]
        + [(90, "no", f'{head}null{foot}{head}{{"@type":"WebPage"}}{foot}'), (91, "none at all", None)], "page_id int, url string, html string")
    out = payloads.postings_from_nodes(payloads.job_nodes(pages))
    assert {r.url: r.pay and (r.pay.lo, r.pay.hi) for r in out.collect()} == {k: v for k, (_, v) in pay.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("baseSalary") == 2


def test_list_by_pay_folds_sightings_once(spark, tmp_path):
    """the index, the estimates and the list read one fold of the sightings."""
    rows = lambda sql, name: spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows("SELECT id AS n_nationkey, concat('N', id) AS n_name FROM range(2)", "nation")
    rows("SELECT id AS s_suppkey, concat('S', id) AS s_name, id % 2 AS s_nationkey FROM range(40)", "supplier")
    rows("SELECT id AS p_partkey, 'bolt' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type FROM range(1)", "part")
    rows("""SELECT id AS l_orderkey, 0L AS l_partkey, id % 40 AS l_suppkey, 1 AS l_linenumber, 5D AS l_quantity, 40000D + id AS l_extendedprice,
        0D AS l_discount, 0D AS l_tax, IF(id % 40 < 10, 'N', 'R') AS l_returnflag, 'O' AS l_linestatus,
        CAST('2001-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(id DIV 40 AS INT)) AS l_shipdate FROM range(80)""", "lineitem")
    out = market_queries.a13(spark, str(tmp_path))
    assert "lineitem" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.posting_key, r.sort_key, r.pos) for r in out.orderBy("pos").collect()]
    # Suppliers 10 to 39 state what they paid last; the others take the median of all thirty or of their nation's fifteen.
    assert len(got) == 40 and got[0] == ("s39|small bolt", 40079.0, 1)
    assert {k: v for k, v, _ in got if int(k[1:].split("|")[0]) >= 10} == {f"s{i}|small bolt": 40040.0 + i for i in range(10, 40)}
    assert {k: v for k, v, _ in got if int(k[1:].split("|")[0]) < 10} == {f"s{i}|small bolt": 40064.0 + i % 2 for i in range(10)}
