"""Registered queries for segmentation (T) and vocabulary (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import years
from ..operators import score, segment, skills, vocab
from ..operators.vocab import Answer, Term
from ..profile import SAMPLE
from .registry import query
from .views import ADVERTS_SQL, JDS_SQL, adverts, jds, spread, table

TERMS = (
    Term("sql", "SQL", "tool", ("sql",), echo=("sql",)),
    Term("excel", "Excel", "tool", ("excel",)),
    Term("python", "Python", "tool", ("python",)),
    Term("tableau", "Tableau", "tool", ("tableau",)),
    Term("power-bi", "Power BI", "tool", ("power bi",), implies=("dashboards",), echo=("power bi",)),
    Term("dashboards", "Dashboards", "method", ("dashboards", "reports")),
    Term("kubernetes", "Kubernetes", "tool", ("kubernetes",)),
    Term("building", "Building", "domain", ("building",)),
)
_J = f"WITH j AS ({JDS_SQL})"

# (jd, section, text) as the template wrote them.
LINES_SQL = _J + """, lines AS (
    SELECT jd, uid, company, 0 AS pos, 'required' AS section, 'SQL and Excel' AS text FROM j WHERE shape = 0
    UNION ALL SELECT jd, uid, company, 1, 'required', y || '+ years of Python' FROM j WHERE shape = 0
    UNION ALL SELECT jd, uid, company, 2, 'preferred', 'Tableau preferred' FROM j WHERE shape = 0
    UNION ALL SELECT jd, uid, company, 0, 'required', 'SQL' FROM j WHERE shape = 1
    UNION ALL SELECT jd, uid, company, 1, 'required', y || ' years of Excel' FROM j WHERE shape = 1
    UNION ALL SELECT jd, uid, company, 2, 'preferred', 'Power BI' FROM j WHERE shape = 1
    UNION ALL SELECT jd, uid, company, 0, 'required', y || '+ years of SQL.' FROM j WHERE shape = 2
    UNION ALL SELECT jd, uid, company, 1, 'preferred', 'Tableau and Python.' FROM j WHERE shape = 2
    UNION ALL SELECT jd, uid, company, 0, 'required', 'Bachelor''s degree' FROM j WHERE shape = 3
    UNION ALL SELECT jd, uid, company, 1, 'required', y || ' years of SQL' FROM j WHERE shape = 3
    UNION ALL SELECT jd, uid, company, 2, 'required', 'Kubernetes' FROM j WHERE shape = 3)
"""


def lines(spark, sf_dir):
    return segment.lines_table(jds(spark, sf_dir))


@query("T01_binding_split", """SELECT doc_id, CASE WHEN length(text) + 1 > 200 THEN length(text) + 1 ELSE length(text) + 32 END AS binding,
    CASE WHEN length(text) + 1 > 200 THEN 31 ELSE 0 END AS tail FROM documents""")
def t01(spark, sf_dir):
    body = F.concat("text", F.lit(" Preferred Qualification: x y zz"))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.length(years.binding_text(body)).alias("binding"), F.length(years.preferred_tail(body)).alias("tail"))


@query("T02_structure", _J + """ SELECT jd, CASE shape WHEN 0 THEN 'heading:Requirements|list:3|heading:Benefits|para:Dental and vision'
    WHEN 1 THEN 'heading:About us|para:We make things for ' || segment || '.|heading:Requirements|list:2|heading:Nice to have|list:1|end:|para:We are hiring.'
    WHEN 2 THEN 'para:We do ' || lower(segment) || '.|heading:Required Qualifications|para:' || y || '+ years of SQL.|heading:Preferred Qualifications|para:Tableau and Python.'
    ELSE 'heading:Primary Responsibilities|list:2|heading:Qualifications|list:3' END AS shape_text FROM j""")
def t02(spark, sf_dir):
    b = segment.structure(jds(spark, sf_dir))
    one = lambda x: F.concat(x["kind"], F.lit(":"), F.when(x["kind"] == "list", F.size(x["items"]).cast("string")).otherwise(x["text"]))
    return b.select("jd", F.array_join(F.transform("blocks", one), "|").alias("shape_text"))


@query("T03_plain", _J + """ SELECT jd, CASE shape WHEN 0 THEN 'REQUIREMENTS' || chr(10) || '- SQL and Excel' || chr(10) || '- ' || y || '+ years of Python' || chr(10) || '- Tableau preferred' || chr(10) || chr(10) || 'BENEFITS' || chr(10) || 'Dental and vision'
    WHEN 1 THEN 'ABOUT US' || chr(10) || 'We make things for ' || segment || '.' || chr(10) || chr(10) || 'REQUIREMENTS' || chr(10) || '- SQL' || chr(10) || '- ' || y || ' years of Excel' || chr(10) || chr(10) || 'NICE TO HAVE' || chr(10) || '- Power BI' || chr(10) || 'We are hiring.'
    WHEN 2 THEN 'We do ' || lower(segment) || '.' || chr(10) || chr(10) || 'REQUIRED QUALIFICATIONS' || chr(10) || y || '+ years of SQL.' || chr(10) || chr(10) || 'PREFERRED QUALIFICATIONS' || chr(10) || 'Tableau and Python.'
    ELSE 'PRIMARY RESPONSIBILITIES' || chr(10) || '- Own the reports.' || chr(10) || '- Build dashboards.' || chr(10) || chr(10) || 'QUALIFICATIONS' || chr(10) || '- Bachelor''s degree' || chr(10) || '- ' || y || ' years of SQL' || chr(10) || '- Kubernetes' END AS plain FROM j""")
def t03(spark, sf_dir):
    return segment.structure(jds(spark, sf_dir)).select("jd", segment.plain("blocks").alias("plain"))


@query("T04_section_of", """SELECT l_orderkey AS ord, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_shipdate AS at_date, CASE l_linenumber WHEN 1 THEN 'required' WHEN 2 THEN 'preferred'
    WHEN 3 THEN 'responsibilities' WHEN 4 THEN 'ignore' WHEN 5 THEN 'required' END AS section FROM lineitem""")
def t04(spark, sf_dir):
    line = F.expr("case l_linenumber when 1 then concat('What You’ll Need for ', l_returnflag, ':') when 2 then 'Preferred Qualifications' "
                  "when 3 then 'Key Responsibilities' when 4 then 'Benefits and Perks' when 5 then 'Work Experience' "
                  "when 6 then 'We met the requirements of every customer in this long sentence.' else concat('Story ', l_linestatus) end")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), F.col("l_shipdate").alias("at_date"), segment.section_of(line).alias("section"))


@query("T05_split_sections", """SELECT doc_id, length(trim(text, chr(10) || ' ' || chr(9) || chr(13))) AS body,
    'SQL' || chr(10) || '5 years' AS required, 'Tableau' AS preferred
    FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-zÀ-ÿ]+', ' ', 'g') AS text FROM documents)""")
def t05(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).withColumn("text", F.regexp_replace("text", "[^A-Za-zÀ-ÿ]+", " "))
    m = segment.split_sections(F.concat(F.lit("Intro:\nAbout us\n"), F.lit("x"), "text", F.lit("x\nRequirements:\nSQL\n5 years\nNice to have\nTableau")))
    return d.select("doc_id", "text", m.alias("m")).select(
        "doc_id", (F.length(F.try_element_at("m", F.lit("ignore"))) - 2 - F.length("text") + F.length(F.trim("text"))).alias("body"),
        F.try_element_at("m", F.lit("required")).alias("required"), F.try_element_at("m", F.lit("preferred")).alias("preferred"))


@query("T06_requirement_lines", LINES_SQL + "SELECT uid, company, pos, section, text FROM lines")
def t06(spark, sf_dir):
    return lines(spark, sf_dir)


@query("T07_unknown_names", LINES_SQL + """SELECT uid, pos, section, w AS word FROM (SELECT uid, pos, section, unnest(regexp_extract_all(text, '\\b[A-Z]{2,6}\\b')) AS w FROM lines)
    WHERE w <> 'SQL'""")
def t07(spark, sf_dir):
    known = spark.createDataFrame([("sql",)], "word string")
    return skills.unknown_names(lines(spark, sf_dir), known)


@query("T07_unmapped_tokens", _J + " SELECT jd, 'Terraform' AS token, 2 AS n, 1 AS place FROM j")
def t07_jd(spark, sf_dir):
    raw = F.concat("description", F.lit("\nRequirements:\nTerraform or SQL\nTerraform and Snowflake"))
    return skills.unmapped_tokens(skills.parse_jds(jds(spark, sf_dir).withColumn("raw", raw), TERMS), TERMS)


@query("T08_about_section", _J + """ SELECT jd, substring('We make ' || repeat('things for ' || segment || ' ', 12) || 'now.', 1, 900) AS about FROM j""")
def t08(spark, sf_dir):
    text = F.concat(F.lit("Intro\nAbout Us:\nWe make "), F.expr("repeat(concat('things for ', segment, ' '), 12)"), F.lit("now."))
    return jds(spark, sf_dir).select("jd", segment.about_section(text).alias("about"))


# -- vocabulary -----------------------------------------------------------------------------

_TOK = r"\.?[A-Za-z0-9+#]+(?:[.\-/&''][A-Za-z0-9+#]+)*"
_DOC_TOKENS = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS w FROM documents),
    l AS (SELECT doc_id, lower(w) AS w FROM t)"""


def doc_vocabulary(spark, sf_dir):
    """Every word of the corpus as a vocabulary."""
    d = table(spark, sf_dir, "documents").select(F.explode(vocab.tokens("text")).alias("w")).select(F.lower("w").alias("phrase")).distinct()
    return d.select("phrase", F.lit(False).alias("cased"), F.col("phrase").alias("term"))


@query("V01_term_counts", _DOC_TOKENS + " SELECT doc_id, w AS term, count(*) AS n FROM l GROUP BY doc_id, w")
def v01(spark, sf_dir):
    return vocab.match_phrases(table(spark, sf_dir, "documents"), ["doc_id"], "text", doc_vocabulary(spark, sf_dir))


@query("V01_find_terms", _J + """ SELECT jd, CASE shape WHEN 0 THEN 'excel:1,python:1,sql:1,tableau:1' WHEN 1 THEN CASE WHEN segment = 'BUILDING' THEN 'building:1,' ELSE '' END || 'excel:1,power-bi:1,sql:1'
    WHEN 2 THEN CASE WHEN segment = 'BUILDING' THEN 'building:1,' ELSE '' END || 'python:1,sql:1,tableau:1' ELSE 'dashboards:2,kubernetes:1,sql:1' END AS found FROM j""")
def v01_find(spark, sf_dir):
    f = vocab.find_terms("description", TERMS)
    return jds(spark, sf_dir).select("jd", F.array_join(F.array_sort(F.transform(f, lambda t: F.concat(t["term"], F.lit(":"), t["n"].cast("string")))), ",").alias("found"))


_CLAUSE = r"[.,!?;:\n]+"


def benchmark_library(spark, sf_dir):
    """The benchmark's words and whole clauses, and its capitalised words as written."""
    b = table(spark, sf_dir, "benchmark")
    clauses = b.select(F.explode(F.split("text", _CLAUSE)).alias("alias"))
    words = b.select(F.explode(vocab.tokens("text")).alias("alias"))
    blind = clauses.union(words).select("alias", F.lit(False).alias("cased"))
    rows = blind.union(words.filter(F.col("alias").rlike("^[A-Z]")).select("alias", F.lit(True)))
    phrase = vocab.normal_phrase(F.col("alias"), F.col("cased"))
    named = rows.withColumn("term", F.concat(F.when(F.col("cased"), "x:").otherwise("b:"), phrase))
    return vocab.first_claims(named.withColumn("priority", F.lit(0)))


@query("V02_library_match", rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_TOK}') AS w FROM documents),
    c AS (SELECT unnest(string_split_regex(text, '[.,!?;:
]+')) AS c FROM benchmark), u AS (SELECT unnest(regexp_extract_all(text, '{_TOK}')) AS u FROM benchmark),
    p AS (SELECT DISTINCT lower(array_to_string(regexp_extract_all(c, '{_TOK}'), ' ')) AS p FROM c UNION SELECT lower(u) FROM u),
    b AS (SELECT p, split_part(p, ' ', 1) AS f, len(string_split(p, ' ')) AS n FROM p WHERE p <> ''), x AS (SELECT DISTINCT u AS x FROM u WHERE regexp_matches(u, '^[A-Z]')),
    o AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
    h AS (SELECT doc_id, i, n, 0 AS exact, 'b:' || p AS term FROM o JOIN b ON f = lower(word) WHERE lower(array_to_string(list_slice(w, i, i + n - 1), ' ')) = p
        UNION ALL SELECT doc_id, i, 1, 1, 'x:' || x FROM o JOIN x ON x = word),
    m AS (SELECT doc_id, i, max({{'n': n, 'exact': exact, 'term': term}}) AS m FROM h GROUP BY doc_id, i),
    l AS (SELECT doc_id, list({{'s': i, 'n': m.n, 't': m.term, 'free': 0::BIGINT, 'out': CAST([] AS VARCHAR[])}} ORDER BY i) AS l FROM m GROUP BY doc_id),
    g AS (SELECT doc_id, list_reduce(l, lambda a, e: CASE WHEN e.s < a.free THEN a ELSE {{'s': e.s, 'n': e.n, 't': e.t, 'free': e.s + e.n, 'out': list_append(a.out, e.t)}} END,
        {{'s': 0::BIGINT, 'n': 0::BIGINT, 't': '', 'free': 0::BIGINT, 'out': CAST([] AS VARCHAR[])}}).out AS terms FROM l)
    SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(terms) AS term FROM g) GROUP BY doc_id, term""")
def v02(spark, sf_dir):
    """Whole clauses beat words, capitalised words as written beat case-blind ones."""
    return vocab.match_phrases(table(spark, sf_dir, "documents"), ["doc_id"], "text", benchmark_library(spark, sf_dir))


def _edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.filter("n_nationkey > 0").select(F.col("n_name").alias("term"), F.concat(F.lit("NATION_"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("implied"))


@query("V03_expand_tags", """WITH RECURSIVE e AS (SELECT n_name AS term, 'NATION_' || (n_nationkey // 2) AS implied FROM nation WHERE n_nationkey > 0),
    c AS (SELECT s_suppkey AS id, n_name AS term FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION SELECT c.id, e.implied FROM c JOIN e ON e.term = c.term) SELECT DISTINCT id, term FROM c""")
def v03(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return vocab.expand(s.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("term")), ["id"], vocab.closure(_edges(spark, sf_dir)))


@query("V04_echo_surfaces", """WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[^A-Za-z0-9]+') AS l FROM documents)),
    f AS (SELECT doc_id, lower(w) AS k, min_by(w, pos) AS w, min(pos) AS pos FROM w WHERE lower(w) IN ('the', 'and', 'le', 'der', 'que') GROUP BY doc_id, lower(w))
    SELECT doc_id, string_agg(w, ',' ORDER BY pos) AS surfaces FROM f GROUP BY doc_id""")
def v04(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join(vocab.echo_surfaces("text", ("the", "and", "le", "der", "que")), ",").alias("surfaces")).filter("surfaces <> ''")


@query("V05_fold_library", """SELECT p_partkey AS id, CASE WHEN p_name = 'red bolt' THEN 'v:red-bolt' ELSE CAST(min(p_partkey) OVER (PARTITION BY p_name) AS VARCHAR) END AS target FROM part""")
def v05(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("int").alias("priority"),
                 F.explode(F.array(F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand"))).alias("alias"))
    own = p.filter("p_name = 'red bolt'").select(F.lit("v:red-bolt").alias("term"), F.initcap("p_name").alias("alias")).distinct()
    return vocab.fold_library(e, own).select(F.col("id").cast("long").alias("id"), "target")


@query("V06_build_library")
def v06(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9+#.]+"), F.lit(0))).alias("word"))
    p = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    software = p.select(F.concat_ws(" ", F.initcap("p_type"), F.initcap("p_name"), F.lit("Software")).alias("product"), (F.col("p_size") > 25).alias("hot"))
    return vocab.build_library(software, vocab.zipf(words), ("Economy", "Promo"))


@query("V07_skill_wording", f"WITH a AS ({ADVERTS_SQL}) " + """SELECT arrival, CASE WHEN CAST(qty AS INT) % 4 = 0 OR line % 3 = 1 THEN 'sql' WHEN line = 5 THEN 't-sql' END AS wording FROM a""")
def v07(spark, sf_dir):
    hay = F.concat(F.lower("description"), F.when(F.col("line") == 5, F.lit("knows t_sql, postgresql or t-sql")).otherwise(F.lit("")))
    hay = F.regexp_replace(hay, "t_sql, postgresql", "nosql1")
    found = score.skill_wording(F.regexp_replace(hay, "t-sql", "t-sqlx"), "sql", [])
    alt = score.skill_wording(F.regexp_replace(hay, r"\bt-sql\b", "tee-query"), "sql", ["tee-query"])
    return adverts(spark, sf_dir).select("arrival", F.when(found.isNotNull(), found).when(alt == "tee-query", F.lit("t-sql")).otherwise(alt).alias("wording"))


_ANCHORS = """WITH a AS (SELECT DISTINCT p_brand AS anchor, CAST(substring(p_brand, 7) AS INT) AS pos FROM part),
    t AS (SELECT p_brand AS anchor, p_name AS alternate, min(p_partkey) AS k FROM part GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY k) AS rank FROM t)"""


@query("V08_widen", _ANCHORS + """, m AS (SELECT alternate, min((CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END, rank, pos, a.anchor)) AS m FROM r JOIN a USING (anchor) WHERE alternate <> 'red bolt' GROUP BY alternate)
    SELECT alternate, m[4] AS anchor, m[2] AS rank FROM m ORDER BY m[1], m[2], m[3], alternate LIMIT 20""")
def v08(spark, sf_dir):
    from pyspark.sql import Window
    p = table(spark, sf_dir, "part")
    pos = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    anchors = p.select(F.col("p_brand").alias("anchor"), F.when(pos % 2 == 0, 0).otherwise(1).alias("phase"), pos.alias("pos")).distinct()
    t = p.groupBy(F.col("p_brand").alias("anchor"), F.col("p_name").alias("alternate")).agg(F.min("p_partkey").alias("k"))
    alts = t.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy("k"))).drop("k")
    return vocab.widen(anchors, alts, 20, spark.createDataFrame([("Red Bolt",)], "seed string"))


@query("V09_containment", """WITH t AS (SELECT lower(p_name) AS title, min(p_partkey) AS pos FROM part GROUP BY 1
    UNION ALL SELECT lower(p_type || ' ' || p_name), min(p_partkey) + 1000000 FROM part GROUP BY 1),
    o AS (SELECT title, min(pos) AS pos FROM t GROUP BY title),
    c AS (SELECT a.title, min_by(b.title, b.pos) AS covered_by FROM o a JOIN o b ON a.title <> b.title AND contains(' ' || a.title || ' ', ' ' || b.title || ' ') GROUP BY a.title)
    SELECT o.title, covered_by FROM o LEFT JOIN c USING (title)""")
def v09(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("pos")).union(
        p.select(F.concat_ws(" ", "p_type", "p_name"), F.col("p_partkey") + 1000000))
    return vocab.containment(t, 3).select("title", "covered_by")


@query("V10_search_plan", """WITH t AS (SELECT p_name AS title, min(p_partkey) AS pos FROM part GROUP BY 1), x AS (SELECT *, pos % 2 = 0 AS every_run FROM t),
    f AS (SELECT *, every_run AND row_number() OVER (PARTITION BY every_run ORDER BY pos, title) <= 25 AS always FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY always ORDER BY pos, title) - 1 AS rn, count(*) OVER (PARTITION BY always) AS n FROM f)
    SELECT title, always, CASE WHEN NOT always THEN CAST(ceil(n / 10e0) AS BIGINT) END AS runs_to_cover FROM r
    WHERE always OR ((rn - (30 % n)) % n + n) % n < least(10, n)""")
def v10(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("pos")).withColumn("every_run", F.col("pos") % 2 == 0)
    return vocab.search_plan(t, 10, 3).select("title", "always", "runs_to_cover")


BANK = (
    Answer("salary", "What salary would you like?", "", ("the", "pay range")),
    Answer("start", "When can you start le der?", "", ("sch", "an en")),
    Answer("visa", "Do you need a visa que?", "", ()),
)


@query("V11_rank_answers", """WITH q AS (SELECT conv_id, turn, lower(text) AS t, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM conversations),
    p AS (SELECT conv_id, turn, CASE WHEN contains(t, 'the') THEN 11 ELSE 0 END + CASE WHEN contains(t, 'pay range') THEN 12 ELSE 0 END + CASE WHEN list_contains(w, 'salary') THEN 1 ELSE 0 END AS a,
    CASE WHEN contains(t, 'sch') THEN 11 ELSE 0 END + CASE WHEN contains(t, 'an en') THEN 12 ELSE 0 END + len(list_filter(['when', 'can', 'start', 'le', 'der'], lambda x: list_contains(w, x))) AS b,
    len(list_filter(['need', 'visa', 'que'], lambda x: list_contains(w, x))) AS c FROM q),
    u AS (SELECT conv_id, turn, 0 AS i, 'salary' AS id, a AS points FROM p UNION ALL SELECT conv_id, turn, 1, 'start', b FROM p UNION ALL SELECT conv_id, turn, 2, 'visa', c FROM p)
    SELECT conv_id, turn, string_agg(id || ':' || points, ',' ORDER BY points DESC, i) AS ranked FROM u WHERE points > 0 GROUP BY conv_id, turn""")
def v11(spark, sf_dir):
    r = vocab.rank_answers("text", BANK)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(
        r, lambda x: F.concat(x["id"], F.lit(":"), x["points"].cast("string"))), ",").alias("ranked")).filter("ranked <> ''")


PARAGRAPHS = {"reports": "I built reports and dashboards in python for {company}.", "machine": "Household machinery pricing, tableau and kubernetes work."}


@query("V12_paragraph_relevance", _J + """ SELECT jd, (CASE WHEN contains(lower(description), 'built') THEN 1 ELSE 0 END + CASE WHEN contains(lower(description), 'reports') THEN 1 ELSE 0 END
    + CASE WHEN contains(lower(description), 'dashboards') THEN 1 ELSE 0 END + CASE WHEN contains(lower(description), 'python') THEN 1 ELSE 0 END) AS reports,
    (CASE WHEN contains(lower(description), 'household') THEN 1 ELSE 0 END + CASE WHEN contains(lower(description), 'machinery') THEN 1 ELSE 0 END
    + CASE WHEN contains(lower(description), 'pricing') THEN 1 ELSE 0 END + CASE WHEN contains(lower(description), 'tableau') THEN 1 ELSE 0 END
    + CASE WHEN contains(lower(description), 'kubernetes') THEN 1 ELSE 0 END + CASE WHEN segment IN ('HOUSEHOLD', 'MACHINERY') THEN 100 ELSE 0 END) AS machine FROM j""")
def v12(spark, sf_dir):
    r = vocab.paragraph_relevance("description", "segment", PARAGRAPHS)
    return jds(spark, sf_dir).select("jd", r.alias("r")).select("jd", F.col("r")[0]["relevance"].alias("reports"), F.col("r")[1]["relevance"].alias("machine"))


@query("V13_evidence")
def v13(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(vocab.tokens("text")).alias("w")).select(F.lower("w").alias("word")).distinct()
    return vocab.evidence(docs, (Term("the", "The", "tool", ("the",)), Term("le", "Le", "tool", ("le", "la"))), known)


@query("V14_known_terms", """WITH RECURSIVE e AS (SELECT n_name AS term, 'NATION_' || (n_nationkey // 2) AS implied FROM nation WHERE n_nationkey > 0),
    c AS (SELECT DISTINCT n_name AS term FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000
    UNION SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900 UNION SELECT e.implied FROM c JOIN e ON e.term = c.term)
    SELECT DISTINCT term FROM c""")
def v14(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("term"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("term"))
    return vocab.known_terms([a, b], vocab.closure(_edges(spark, sf_dir)))
