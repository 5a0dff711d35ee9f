"""Registered queries for skill demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import segment, skills, vocab
from ..session import written
from .registry import query
from .text_queries import LINES_SQL, TERMS, lines
from .views import JDS_SQL, jds, spread, table

_J = f"WITH j AS ({JDS_SQL})"
YEARS, LEVEL = 2, 1
_HAVE = "('sql', 'excel')"

# What each line asks, from the template.
ASKED_SQL = LINES_SQL + """, asked AS (SELECT l.jd, l.uid, pos, section, t.term FROM lines l JOIN (VALUES ('sql', 'sql'), ('excel', 'excel'),
    ('python', 'python'), ('tableau', 'tableau'), ('power-bi', 'power bi'), ('kubernetes', 'kubernetes')) t(term, word)
    ON contains(lower(l.text), t.word)),
    per AS (SELECT uid, jd, term, bool_or(section = 'required') AS required, term IN """ + _HAVE + """ AS have FROM asked GROUP BY uid, jd, term)
"""


def have(spark):
    return spark.createDataFrame([("sql",), ("excel",)], "term string")


def kinds(spark):
    return spark.createDataFrame([(t.id, t.kind) for t in TERMS], "term string, kind string")


def parsed(spark, sf_dir):
    return skills.parse_jds(jds(spark, sf_dir).withColumnRenamed("description", "raw"), TERMS)


def jd_terms(spark, sf_dir):
    return skills.jd_terms(parsed(spark, sf_dir))


@query("G01_asked_terms", ASKED_SQL + "SELECT uid, pos, section, term FROM asked")
def g01(spark, sf_dir):
    return skills.asked_terms(lines(spark, sf_dir), TERMS)


@query("G01_line_flags", LINES_SQL + f"""SELECT uid, pos, concat_ws(',', CASE WHEN contains(text, 'years') AND y > {YEARS} THEN y || '+ years of experience' END,
    CASE WHEN contains(text, 'Bachelor') THEN 'Bachelor''s degree' END) AS flags, contains(text, 'years') OR contains(text, 'Bachelor') AS checked FROM lines JOIN j USING (uid)""")
def g01_flags(spark, sf_dir):
    f = lines(spark, sf_dir).withColumn("f", skills.line_flags("text", YEARS, LEVEL))
    return f.select("uid", "pos", F.array_join(F.transform("f.flags", lambda x: x["label"]), ",").alias("flags"), "f.checked")


@query("G02_gap_report", ASKED_SQL + f""", a AS (SELECT uid, count(*) AS asked, count(*) FILTER (required) AS required, count(*) FILTER (have) AS have,
    string_agg(term, ',' ORDER BY NOT required, term) FILTER (NOT have) AS missing FROM per GROUP BY uid),
    l AS (SELECT l.uid, count(*) AS lines, count(*) FILTER (NOT contains(text, 'years') AND NOT contains(text, 'Bachelor') AND a.uid IS NULL) AS unread,
    string_agg(CASE WHEN contains(text, 'years') AND y > {YEARS} THEN y || '+ years of experience' END, '') AS yf, bool_or(contains(text, 'Bachelor')) AS bach
    FROM lines l JOIN j ON j.uid = l.uid LEFT JOIN (SELECT DISTINCT uid, pos FROM asked) a ON a.uid = l.uid AND a.pos = l.pos GROUP BY l.uid)
    SELECT l.uid, lines, asked, required, have, coalesce(missing, '') AS missing, concat_ws(',', yf, CASE WHEN bach THEN 'Bachelor''s degree' END) AS flags, unread FROM l JOIN a USING (uid)""")
def g02(spark, sf_dir):
    # The report reads the lines twice.
    r = skills.gap_report(written(lines(spark, sf_dir), "lines"), TERMS, have(spark), YEARS, LEVEL)
    return r.select("uid", "lines", "asked", "required", "have", F.array_join("missing", ",").alias("missing"),
                    F.array_join("flags", ",").alias("flags"), "unread")


@query("G03_posting_terms", ASKED_SQL + "SELECT uid, term, required FROM per")
def g03(spark, sf_dir):
    return skills.posting_terms(jds(spark, sf_dir), TERMS)


@query("G04_title_families", _J + """, f AS (SELECT CASE okey WHEN 0 THEN 'data analyst' WHEN 1 THEN 'supply chain analyst' WHEN 2 THEN 'help desk technician' WHEN 3 THEN 'data engineer' END AS family, applied
    FROM (SELECT jd % 5 AS okey, applied FROM j))
    SELECT family, count(*) AS listed, count(*) FILTER (applied) AS applied FROM f WHERE family IS NOT NULL GROUP BY family ORDER BY count(*) + count(*) FILTER (applied) DESC, family LIMIT 12""")
def g04(spark, sf_dir):
    j = jds(spark, sf_dir)
    return skills.title_families(j, j.filter("applied"))


def growth_inputs(spark, sf_dir, read=None):
    """Listed is every description, applied a third of them again. ``read`` are the
    descriptions' lines, where the caller has them."""
    j = jds(spark, sf_dir).select("uid", "company", "title", "score", "applied")
    posts = j.withColumn("set", F.lit("listed")).union(j.filter("applied").withColumn("set", F.lit("applied")))
    # Read by several reports: written once to the shared checkpoint folder.
    asked = skills.posting_terms(jds(spark, sf_dir), TERMS) if read is None else skills.terms_read(read, TERMS)
    terms = written(asked, "asked")
    return terms.join(posts.select("set", "uid"), "uid"), posts


_GROWTH = ASKED_SQL + """, sets AS (SELECT 'listed' AS set, uid FROM j UNION ALL SELECT 'applied', uid FROM j WHERE applied),
    n AS (SELECT set, count(*) AS n FROM sets GROUP BY set),
    sp AS (SELECT s.set, per.* FROM per JOIN sets s USING (uid)),
    lack AS (SELECT set, uid, count(*) FILTER (required) AS req, count(*) FILTER (required AND NOT have) AS lacking, max(term) FILTER (required AND NOT have) AS one FROM sp GROUP BY set, uid)
"""


@query("G05_growth_terms", _GROWTH + """SELECT term, bool_or(have) AS have,
    round_even(1e2 * count(*) FILTER (set = 'listed' AND required) / (SELECT n FROM n WHERE set = 'listed'), 1) AS listed_required,
    round_even(1e2 * count(*) FILTER (set = 'applied' AND required) / (SELECT n FROM n WHERE set = 'applied'), 1) AS applied_required,
    round_even(1e2 * count(*) FILTER (set = 'listed') / (SELECT n FROM n WHERE set = 'listed'), 1) AS listed_any,
    round_even(1e2 * count(*) FILTER (set = 'applied') / (SELECT n FROM n WHERE set = 'applied'), 1) AS applied_any,
    count(*) FILTER (set = 'listed') AS listed_count, count(*) FILTER (set = 'applied') AS applied_count,
    (SELECT count(*) FROM lack WHERE lacking = 1 AND one = sp.term AND set = 'listed') AS unlocks_listed,
    (SELECT count(*) FROM lack WHERE lacking = 1 AND one = sp.term AND set = 'applied') AS unlocks_applied FROM sp GROUP BY term""")
def g05(spark, sf_dir):
    asked, posts = growth_inputs(spark, sf_dir)
    return skills.growth_terms(asked, posts, have(spark))


@query("G05_growth_summary", _GROWTH + """SELECT n.set, n, count(*) FILTER (req > 0) AS with_requirements, count(*) FILTER (req > 0 AND lacking = 0) AS clear,
    round_even(100 * avg(1 - lacking / CAST(req AS DOUBLE)) FILTER (req > 0), 1) AS coverage FROM n JOIN lack USING (set) GROUP BY n.set, n""")
def g05_summary(spark, sf_dir):
    asked, posts = growth_inputs(spark, sf_dir)
    return skills.growth_summary(asked, posts, have(spark))


@query("G05_growth_examples", _GROWTH + """, nm AS (SELECT term, company, title, max(score) AS score FROM sp JOIN j USING (uid) WHERE NOT have GROUP BY term, company, title),
    r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, company, title) AS place FROM nm)
    SELECT term, place, company, title, score FROM r WHERE place <= 4""")
def g05_examples(spark, sf_dir):
    asked, posts = growth_inputs(spark, sf_dir)
    return skills.growth_examples(asked, posts, have(spark)).drop("uid")


@query("G05_barriers", _GROWTH + f""", f AS (SELECT DISTINCT s.set, uid, y || '+ years of experience' AS label FROM j JOIN sets s USING (uid) WHERE y > {YEARS}
    UNION SELECT DISTINCT s.set, uid, 'Bachelor''s degree' FROM j JOIN sets s USING (uid) WHERE shape = 3),
    c AS (SELECT set, label, count(*) AS count FROM f GROUP BY set, label HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY set ORDER BY count DESC, label) AS place FROM c)
    SELECT r.set, place, label, count, round_even(1e2 * count / n, 1) AS pct FROM r JOIN n USING (set) WHERE place <= 8""")
def g05_barriers(spark, sf_dir):
    # Sections are read once, for the terms and the barriers.
    read = written(segment.read_lines(jds(spark, sf_dir).select("uid", "company", "description")).drop("description"), "read")
    posts = growth_inputs(spark, sf_dir, read)[1]
    f = segment.lines_of(read).withColumn("f", skills.line_flags("text", YEARS, LEVEL))
    labels = f.select("uid", F.explode("f.flags").alias("x")).select("uid", F.col("x.label").alias("label")).join(posts.select("set", "uid"), "uid")
    return skills.top_labels(labels, posts)


@query("G06_learn_next", _GROWTH + """, g AS (SELECT term, round_even(1e2 * count(*) FILTER (set = 'listed' AND required) / (SELECT n FROM n WHERE set = 'listed'), 1) AS r,
    round_even(1e2 * count(*) FILTER (set = 'listed') / (SELECT n FROM n WHERE set = 'listed'), 1) AS a,
    (SELECT count(*) FROM lack WHERE lacking = 1 AND one = sp.term AND set = 'listed') AS u FROM sp WHERE NOT have GROUP BY term)
    SELECT term, 'tool' AS kind, a + 2 * r + 1e2 * u / (SELECT n FROM n WHERE set = 'listed') AS rank FROM g ORDER BY rank DESC, term LIMIT 12""")
def g06(spark, sf_dir):
    asked, posts = growth_inputs(spark, sf_dir)
    n = posts.filter("set = 'listed'").agg(F.count("*").alias("n_listed"))
    terms = skills.growth_terms(asked, posts, have(spark)).join(n, F.lit(True))
    return skills.learn_next(terms, kinds(spark), F.col("n_listed"))


@query("G07_applied_set", _J + """, k AS (SELECT DISTINCT lower(company) || '|' || lower(title) AS name FROM j WHERE applied)
    SELECT uid, lower(company) || '|' || lower(title) AS name FROM j WHERE applied
    UNION ALL SELECT DISTINCT '', lower(company) || '|' || lower(title) FROM j WHERE shape = 1 AND lower(company) || '|' || lower(title) NOT IN (SELECT name FROM k)""")
def g07(spark, sf_dir):
    j = jds(spark, sf_dir)
    stored = j.filter("shape = 1").select("company", "title", F.col("description").alias("raw"), F.lit("2001-01-01").alias("fetched"))
    return skills.applied_set(j.filter("applied").select("uid"), j, stored).select("uid", "name")


# Sections of a stored description: only the line-broken shape has headings.
_PARSED = _J + """, t AS (SELECT jd, 'sql' AS term, CASE WHEN shape = 1 THEN 3 WHEN shape = 0 THEN 3 WHEN shape = 2 THEN 1 ELSE 1 END AS weight, 1 AS n, shape IN (0, 1) AS required FROM j
    UNION ALL SELECT jd, 'excel', 3, 1, true FROM j WHERE shape IN (0, 1)
    UNION ALL SELECT jd, 'power-bi', 1, 1, false FROM j WHERE shape = 1
    UNION ALL SELECT jd, 'python', 3, 1, true FROM j WHERE shape = 0
    UNION ALL SELECT jd, 'python', 1, 1, false FROM j WHERE shape = 2
    UNION ALL SELECT jd, 'tableau', 1, 1, false FROM j WHERE shape = 2
    UNION ALL SELECT jd, 'building', 0, 1, false FROM j WHERE shape = 1 AND segment = 'BUILDING'
    UNION ALL SELECT jd, 'building', 1, 1, false FROM j WHERE shape = 2 AND segment = 'BUILDING'
    UNION ALL SELECT jd, 'dashboards', 1, 2, false FROM j WHERE shape = 3
    UNION ALL SELECT jd, 'kubernetes', 1, 1, false FROM j WHERE shape = 3)
"""


@query("G08_parse_terms", _PARSED + " SELECT jd, term, weight, n, required FROM t")
def g08(spark, sf_dir):
    return jd_terms(spark, sf_dir)


@query("G08_parse_years", _J + " SELECT jd, CASE WHEN shape IN (0, 1) THEN y END AS years_required FROM j")
def g08_years(spark, sf_dir):
    return parsed(spark, sf_dir).select("jd", "years_required")


@query("G09_domain_and_family", _J + """ SELECT jd, CASE WHEN segment = 'BUILDING' THEN 'building' END AS domain,
    CASE jd % 5 WHEN 2 THEN 'support' WHEN 3 THEN 'engineering' WHEN 4 THEN 'general' ELSE 'analysis' END AS family FROM j""")
def g09(spark, sf_dir):
    j = jds(spark, sf_dir)
    f = F.explode(vocab.find_terms(F.concat("description", F.lit(" "), F.repeat(F.concat("segment", F.lit(" ")), F.lit(3))), TERMS))
    d = skills.jd_domain(j.select("jd", f.alias("t")).select("jd", "t.*"), kinds(spark))
    fam = skills.summary_family("title", (("analysis", ("analyst",)), ("support", ("desk",)), ("engineering", ("engineer",)), ("general", ())))
    return j.select("jd", fam.alias("family")).join(d, "jd", "left")


@query("G10_keyword_gaps", _PARSED + f""" SELECT term, count(*) FILTER (required) AS required_in, count(*) AS mentioned_in, term IN {_HAVE} AS covered,
    count(*) FILTER (required) / CAST((SELECT count(*) FROM j) AS DOUBLE) AS rate,
    term IN {_HAVE} AND count(*) FILTER (required) = 0 AND count(*) <= greatest(1, (SELECT count(*) FROM j) // 10) AS rarely_asked FROM t GROUP BY term""")
def g10(spark, sf_dir):
    return skills.keyword_gaps(jd_terms(spark, sf_dir), have(spark))


_SELECTABLE = " AND term NOT IN ('building')"


@query("G11_coverage", _PARSED + f""", m AS (SELECT *, term IN ('sql', 'excel', 'dashboards') AS hit FROM t WHERE true{_SELECTABLE}),
    c AS (SELECT jd, count(*) FILTER (required AND hit) AS required_hit, count(*) FILTER (required AND NOT hit) AS required_missed,
    count(*) FILTER (NOT required AND hit) AS wanted_hit, count(*) FILTER (NOT required AND NOT hit) AS wanted_missed FROM m GROUP BY jd)
    SELECT *, CASE WHEN required_hit + required_missed > 0 THEN required_hit / CAST(required_hit + required_missed AS DOUBLE) ELSE 1 END AS required_rate FROM c""")
def g11(spark, sf_dir):
    t = jd_terms(spark, sf_dir)
    said = jds(spark, sf_dir).select("jd", F.explode(F.array(F.lit("sql"), F.lit("excel"), F.lit("dashboards"))).alias("term"))
    return skills.coverage(t, said, kinds(spark))


_TAGS = [("b1", "b1", 0, "sql"), ("b1", "b1", 0, "excel"), ("b1", "b1v", 1, "python"), ("b1", "b1v", 1, "sql"),
         ("b2", "b2", 0, "dashboards"), ("b2", "b2", 0, "power-bi"), ("b3", "b3", 0, "kubernetes"), ("b4", "b4", 0, "tableau")]
_TAGS_SQL = ", tags AS (SELECT * FROM (VALUES " + ", ".join(str(t) for t in _TAGS) + ") v(bullet, phrasing, pos, term))"


def tags(spark):
    return spark.createDataFrame(_TAGS, "bullet string, phrasing string, pos int, term string")


@query("G11_draft_help", _PARSED + _TAGS_SQL + f""" SELECT jd, bullet, string_agg(DISTINCT term, ',' ORDER BY term) AS helps FROM t JOIN tags USING (term)
    WHERE term NOT IN ('sql'){_SELECTABLE} GROUP BY jd, bullet""")
def g11_drafts(spark, sf_dir):
    said = jds(spark, sf_dir).select("jd", F.lit("sql").alias("term"))
    d = skills.draft_help(jd_terms(spark, sf_dir), said, kinds(spark), tags(spark).select("bullet", "term").distinct())
    return d.select("jd", "bullet", F.array_join("helps", ",").alias("helps"))


@query("G12_best_phrasing", _PARSED + _TAGS_SQL + """, v AS (SELECT jd, bullet, phrasing, pos, CAST(sum(weight) AS DOUBLE) AS value FROM t JOIN tags USING (term) GROUP BY ALL),
    r AS (SELECT *, value + CASE WHEN pos = 0 THEN 0.5e0 ELSE 0e0 END AS score, row_number() OVER (PARTITION BY jd, bullet ORDER BY value + CASE WHEN pos = 0 THEN 0.5e0 ELSE 0e0 END DESC, pos) AS rn FROM v)
    SELECT jd, bullet, phrasing, value, score FROM r WHERE rn = 1""")
def g12(spark, sf_dir):
    return skills.best_phrasing(skills.bullet_values(jd_terms(spark, sf_dir), tags(spark)))


BULLETS = ({"id": "b1", "parent": "job", "tags": ("sql", "excel"), "priority": 5}, {"id": "b2", "parent": "job", "tags": ("dashboards", "power-bi"), "priority": 4},
           {"id": "b3", "parent": "job", "tags": ("kubernetes",), "priority": 3}, {"id": "b4", "parent": "project", "tags": ("tableau", "python"), "priority": 2},
           {"id": "b5", "parent": "project", "tags": ("python", "sql"), "priority": 1})
ENTRIES = ({"id": "job", "min": 1, "max": 2}, {"id": "project", "min": 0, "max": 2})


def chosen(spark, sf_dir):
    return skills.select_bullets(parsed(spark, sf_dir), BULLETS, ENTRIES, [t.id for t in TERMS if t.kind != "domain"], 3)


@query("G13_select_bullets")
def g13(spark, sf_dir):
    return chosen(spark, sf_dir)


@query("G13_drop_weakest")
def g13_drop(spark, sf_dir):
    floors = spark.createDataFrame([(e["id"], e["min"]) for e in ENTRIES], "entry string, floor int")
    return skills.drop_weakest(chosen(spark, sf_dir), floors)


_CATS = [("Tools", 0, "excel"), ("Tools", 0, "tableau"), ("Languages", 1, "sql"), ("Languages", 1, "python"), ("Methods", 2, "dashboards")]


@query("G14_skill_order", _PARSED + ", c AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in _CATS) + """) v(category, category_pos, term)),
    r AS (SELECT jd, category, category_pos, max(weight) AS rank FROM t JOIN c USING (term) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY jd ORDER BY rank DESC, category_pos) AS pos FROM r""")
def g14(spark, sf_dir):
    return skills.skill_order(jd_terms(spark, sf_dir), spark.createDataFrame(_CATS, "category string, category_pos int, term string"))


@query("G14_top_courses", _PARSED + """, c AS (SELECT * FROM (VALUES ('Databases', 2, 'sql'), ('Statistics', 3, 'python'), ('Statistics', 3, 'excel'), ('Design', 1, 'dashboards')) v(course, priority, term)),
    r AS (SELECT jd, course, priority, CAST(sum(weight) AS BIGINT) AS value FROM t JOIN c USING (term) GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY jd ORDER BY value DESC, priority DESC, course) AS place FROM r) SELECT * FROM p WHERE place <= 1""")
def g14_courses(spark, sf_dir):
    c = spark.createDataFrame([("Databases", 2, "sql"), ("Statistics", 3, "python"), ("Statistics", 3, "excel"), ("Design", 1, "dashboards")], "course string, priority int, term string")
    return skills.top_courses(jd_terms(spark, sf_dir), c, 1)


@query("G14_echo_phrases", _J + """ SELECT jd, 1 AS pos, 'sql' AS term, 'SQL' AS phrase FROM j UNION ALL SELECT jd, 2, 'power-bi', 'Power BI' FROM j WHERE shape = 1""")
def g14_echo(spark, sf_dir):
    return skills.echo_phrases(parsed(spark, sf_dir), TERMS, F.lit("nothing said yet"))


@query("G22_content_violations", """WITH b AS (SELECT CAST(p_partkey % 1990 AS VARCHAR) AS id, p_brand AS parent, p_type AS term, p_size AS n FROM part),
    e AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_brand <> 'Brand#7' UNION ALL SELECT 'Brand#empty')
    SELECT 'duplicate-id' AS rule, id AS subject, CAST(count(*) AS VARCHAR) AS detail FROM b GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'orphan-parent', id, parent FROM b WHERE parent NOT IN (SELECT id FROM e)
    UNION ALL SELECT 'unknown-tag', id, term FROM b WHERE term = 'PROMO'
    UNION ALL SELECT 'invented-number', v.id, '777' FROM b v JOIN b x ON x.id = v.id WHERE v.n = 10
    UNION ALL SELECT 'too-few-bullets', 'Brand#empty', '0'""")
def g22(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.select((F.col("p_partkey") % 1990).cast("string").alias("id"), F.col("p_brand").alias("parent"), F.array("p_type").alias("tags"),
                 F.concat(F.lit("Cut costs by "), F.col("p_size").cast("string"), F.lit(" percent of 1,200.")).alias("text"), "p_size")
    e = p.filter("p_brand <> 'Brand#7'").select(F.col("p_brand").alias("id")).distinct().union(spark.createDataFrame([("Brand#empty",)], "id string"))
    t = p.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("term")).distinct()
    v = b.select(F.col("id").alias("bullet"), F.when(F.col("p_size") == 10, F.lit("Saved 777 of 1200")).otherwise(F.lit("Saved 1200")).alias("text"))
    return skills.content_violations(b.drop("p_size"), e, t, v)


@query("G22_synonym_violations", """WITH s AS (SELECT DISTINCT p_brand AS term, p_name AS alternate FROM part UNION SELECT p_type, p_type FROM part UNION SELECT p_type, 'x' FROM part UNION SELECT p_type, p_type || ' jobs' FROM part)
    SELECT 'duplicate' AS rule, min(term) AS term, alternate FROM s GROUP BY alternate HAVING count(DISTINCT term) > 1
    UNION ALL SELECT 'self', term, alternate FROM s WHERE term = alternate UNION ALL SELECT 'short', term, alternate FROM s WHERE length(alternate) < 3
    UNION ALL SELECT 'contained', term, alternate FROM s WHERE term <> alternate AND contains(' ' || alternate || ' ', ' ' || term || ' ')""")
def g22_synonyms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = p.select(F.col("p_brand").alias("term"), F.col("p_name").alias("alternate")).union(p.select("p_type", "p_type")).union(
        p.select("p_type", F.lit("x"))).union(p.select("p_type", F.concat("p_type", F.lit(" jobs")))).distinct()
    return skills.synonym_violations(s)


@query("G23_unsupported_claims", """SELECT o_orderkey AS id, 'number' AS kind, CAST(o_orderkey % 40 + 100 AS VARCHAR) AS claim FROM orders WHERE o_orderkey % 7 = 0
    UNION ALL SELECT o_orderkey, 'phrase', 'big plans' FROM orders WHERE o_orderkey % 5 = 0""")
def g23(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    n = (F.col("id") % 40 + 100).cast("string")
    texts = o.select("id", F.concat(F.lit("Led twelve teams and "), n, F.lit(" people; saved 2,000.")).alias("text"), F.array(F.lit("Big  plans")).alias("phrases"))
    ok = o.select("id", F.concat(F.lit("We had 12 teams, 2000 saved"), F.when(F.col("id") % 7 != 0, F.concat(F.lit(", "), n, F.lit(" people"))).otherwise(F.lit("")),
                                 F.when(F.col("id") % 5 != 0, F.lit(" and big\nplans")).otherwise(F.lit(""))).alias("text"))
    out = skills.unsupported_claims(texts, ok)
    return out.withColumn("claim", F.when(F.col("kind") == "phrase", F.lower(F.regexp_replace("claim", " +", " "))).otherwise(F.col("claim")))


@query("P12_title_family", _J + """ SELECT jd, CASE jd % 5 WHEN 0 THEN 'data analyst' WHEN 1 THEN 'supply chain analyst' WHEN 2 THEN 'help desk technician' WHEN 3 THEN 'data engineer' ELSE '' END AS family FROM j""")
def p12_family(spark, sf_dir):
    return jds(spark, sf_dir).select("jd", keys.title_family("title").alias("family"))
