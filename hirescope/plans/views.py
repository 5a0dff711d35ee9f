"""Views over the driver tables in the shape of the posting model.

Each view exists twice, as the same SQL in both dialects: once for Spark and
once as the common table expression the check queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-01 00:00:00"

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOURCE = """CASE l_linenumber WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever'
    WHEN 3 THEN 'adzuna' WHEN 4 THEN 'remoteok' WHEN 5 THEN 'usajobs'
    WHEN 6 THEN 'workday' ELSE 'hackernews' END"""

# One row per sighting of a posting. {days} is the dialect's day interval.
_SIGHTINGS = """
SELECT s_name AS company, concat(p_type, ' ', p_name) AS title, p_type AS job_family,
    p_brand AS brand, n_name AS place, {source} AS source,
    l_shipdate AS run_ts, l_shipdate - {days} AS posted_at,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE round(l_extendedprice, 2) END AS salary_min,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE round(l_extendedprice * 1.2e0, 2) END AS salary_max,
    l_linestatus = 'O' AS remote, CAST(l_quantity * 2 AS INT) AS score,
    concat('https://', {source}, '.example.com/', CAST(l_orderkey AS {text}), '/',
           CAST(l_partkey AS {text}), '/', CAST(l_suppkey AS {text}), '/',
           CAST(l_linenumber AS {text})) AS url,
    CAST({epoch_days} AS BIGINT) * 1000000000000000 + (l_orderkey * 10 + l_linenumber) * 100000000
        + (l_partkey % 100000) * 1000 + l_suppkey % 1000 AS arrival,
    l_orderkey AS ord, l_linenumber AS line, l_quantity AS qty, l_extendedprice AS price,
    l_discount AS disc, l_tax AS tax, l_returnflag AS flag
FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""


def _render(sql: str, days: str, text: str) -> str:
    epoch = "datediff(l_shipdate, DATE '1995-01-01')" if text == "STRING" else (
        "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"
    )
    return (
        sql.replace("{source}", _SOURCE).replace("{days}", days)
        .replace("{text}", text).replace("{epoch_days}", epoch)
    )


SIGHTINGS_SQL = _render(_SIGHTINGS, "to_days(CAST(l_quantity AS INT))", "VARCHAR")


#: Rows of a task that reads text: rules take about a millisecond a row.
TEXT_ROWS = 50_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table whose rows sit in fewer tasks than there are cores, or most of them in
    a few, is dealt out over the cores; another one is left where it is. Splits say
    little of it, as a file of one row group is read by one task however many splits it
    has: rows are counted, from the footers. ``rows`` is how many a task may have at most."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    total = held.n or 0
    parts = max(cores, -(-total // rows) if rows else 0)
    return df.repartition(parts) if held.most is None or held.most > 2 * total / parts else df


def _register(spark: SparkSession, sf_dir: str, *names: str, spread_first: str = "", rows: int | None = None) -> None:
    for name in names:
        df = table(spark, sf_dir, name)
        (spread(df, rows) if name == spread_first else df).createOrReplaceTempView(name)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir, "lineitem", "part", "supplier", "nation", spread_first="lineitem")
    return spark.sql(
        _render(_SIGHTINGS, "make_dt_interval(CAST(l_quantity AS INT))", "STRING")
    )


_APPLICATIONS = """
SELECT CAST(o_orderkey AS {text}) AS id, c_name AS company, o_orderpriority AS role,
    c_mktsegment AS source, CAST(o_orderdate AS DATE) AS applied_on,
    CASE o_orderkey % 9 WHEN 0 THEN 'prepared' WHEN 1 THEN 'applied' WHEN 2 THEN 'followed-up'
        WHEN 3 THEN 'screening' WHEN 4 THEN 'interview' WHEN 5 THEN 'offer'
        WHEN 6 THEN 'rejected' WHEN 7 THEN 'ghosted' ELSE 'withdrawn' END AS status,
    o_totalprice AS worth, o_orderkey AS okey, o_custkey AS ckey, o_orderstatus AS ostatus
FROM orders JOIN customer ON o_custkey = c_custkey
"""
APPLICATIONS_SQL = _render(_APPLICATIONS, "", "VARCHAR")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir, "orders", "customer")
    return spark.sql(_render(_APPLICATIONS, "", "STRING"))


# A templated posting body over every sighting, so that text rules fire on data
# whose right answer follows from the columns.
_ADVERTS = """
SELECT s.*, concat(
    CASE CAST(qty AS INT) % 4
        WHEN 0 THEN concat('You bring ', CAST(line AS {text}), '-', CAST(line + 2 AS {text}), ' years of experience with SQL and Python. ')
        WHEN 1 THEN concat('Minimum ', CAST(line AS {text}), '+ years required. ')
        WHEN 2 THEN 'Entry level. We will train. '
        ELSE concat('Celebrating ', CAST(CAST(qty AS INT) AS {text}), ' years in business. ') END,
    CASE line % 3 WHEN 0 THEN 'Requirements: Terraform. '
        WHEN 1 THEN 'Requirements: SQL, Terraform and Kubernetes. ' ELSE '' END,
    CASE ord % 3 WHEN 0 THEN 'Bachelor''s degree in statistics. '
        WHEN 1 THEN 'Master''s degree required. ' ELSE '' END,
    CASE ord % 4 WHEN 0 THEN concat('Salary range: $', CAST(40 + CAST(qty AS INT) AS {text}), 'k - $', CAST(60 + CAST(qty AS INT) AS {text}), 'k. ')
        WHEN 1 THEN concat('Pay: $', CAST(20 + CAST(qty AS INT) % 20 AS {text}), '.50/hr. ')
        WHEN 2 THEN '' ELSE concat('Compensation $', CAST(30 + CAST(qty AS INT) AS {text}), 'k to start. ') END
    ) AS description,
    CASE ord % 8 WHEN 0 THEN 'Data Analyst' WHEN 1 THEN 'Senior Data Analyst'
        WHEN 2 THEN 'Junior Reporting Analyst' WHEN 3 THEN 'Business Analyst'
        WHEN 4 THEN 'Warehouse Associate' WHEN 5 THEN 'Data Engineer / Senior Data Engineer'
        WHEN 6 THEN 'Receptionist' ELSE 'Ops Analyst' END AS role_title,
    CASE line % 4 WHEN 0 THEN 'Columbus, OH' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Boise, ID'
        ELSE 'Toronto, Canada' END AS location
FROM ({sightings}) s
"""


def _adverts(days: str, text: str) -> str:
    return _render(_ADVERTS.replace("{sightings}", _SIGHTINGS), days, text)


ADVERTS_SQL = _adverts("to_days(CAST(l_quantity AS INT))", "VARCHAR")


def adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with a body, a scoring title and a location; no stated pay."""
    _register(spark, sf_dir, "lineitem", "part", "supplier", "nation", spread_first="lineitem", rows=TEXT_ROWS)
    df = spark.sql(_adverts("make_dt_interval(CAST(l_quantity AS INT))", "STRING"))
    none = F.lit(None).cast("double")
    return df.withColumns({
        "title": F.col("role_title"), "salary_min": none, "salary_max": none, "remote": F.lit(False),
        "first_seen": F.col("run_ts").cast("timestamp"), "posted_at": F.col("posted_at").cast("timestamp"),
    }).drop("role_title")


# Job descriptions in the four shapes boards send, over every order: markup,
# plain lines, one flattened line, and flattened markdown.
_JDS = """
SELECT o_orderkey AS jd, CAST(o_orderkey AS {text}) AS uid, c_name AS company, c_mktsegment AS segment,
    o_orderpriority AS priority, o_orderkey % 9 + 1 AS y, o_orderkey % 4 AS shape,
    CASE o_orderkey % 5 WHEN 0 THEN 'Senior Data Analyst II - Remote' WHEN 1 THEN 'Analyst, Supply Chain'
        WHEN 2 THEN 'Help Desk Technician' WHEN 3 THEN 'Data Engineers (Hybrid)' ELSE 'Chief of Staff' END AS title,
    CASE o_orderkey % 4
    WHEN 0 THEN concat('<h2>Requirements</h2><ul><li>SQL and Excel</li><li>', CAST(o_orderkey % 9 + 1 AS {text}),
        '+ years of Python</li><li>Tableau preferred</li></ul><p><b>Benefits</b></p><p>Dental and vision</p>')
    WHEN 1 THEN concat('About us{nl}We make things for ', c_mktsegment, '.{nl}Requirements:{nl}- SQL{nl}- ',
        CAST(o_orderkey % 9 + 1 AS {text}), ' years of Excel{nl}Nice to have:{nl}- Power BI{nl}#LI-AB{nl}We are hiring.')
    WHEN 2 THEN concat('We do ', lower(c_mktsegment), '. Required Qualifications ', CAST(o_orderkey % 9 + 1 AS {text}),
        '+ years of SQL. Preferred Qualifications Tableau and Python.')
    ELSE concat('**Primary Responsibilities** - Own the reports. - Build dashboards. **Qualifications** + Bachelor''s degree + ',
        CAST(o_orderkey % 9 + 1 AS {text}), ' years of SQL + Kubernetes') END AS description,
    CAST(floor(o_totalprice) AS INT) % 101 AS score, o_orderkey % 3 = 0 AS applied
FROM orders JOIN customer ON o_custkey = c_custkey
"""
JDS_SQL = _render(_JDS, "", "VARCHAR").replace("'{nl}", "chr(10) || '").replace("{nl}", "' || chr(10) || '")


def jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir, "orders", "customer", spread_first="orders", rows=TEXT_ROWS)
    return spark.sql(_render(_JDS, "", "STRING").replace("{nl}", "\\n"))
