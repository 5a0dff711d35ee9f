"""Vocabulary matching, selection, sources and streams on small fixtures."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from hirescope.operators import companies, skills, trie, vocab
from hirescope.operators.vocab import Term
from hirescope.sources import payloads, sinks


def greedy(text, phrases, longest):
    """Leftmost, longest phrase first, no word counted twice."""
    ws, out, i = re.findall(trie.WORD, text), {}, 0
    while i < len(ws):
        for n in range(min(longest, len(ws) - i), 0, -1):
            part = " ".join(ws[i:i + n])
            hit = phrases.get((part, True)) or phrases.get((part.lower(), False))
            if hit:
                out[hit] = out.get(hit, 0) + 1
                i += n
                break
        else:
            i += 1
    return out


def test_match_phrases_against_a_loop(spark):
    rng = random.Random(3)
    alphabet = ["power", "BI", "bi", "node.js", "C++", "sql", "SQL", "server", "go", "Go", "x"]
    texts = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    table = {("power bi", False): "pbi", ("bi", False): "bi", ("sql server", False): "mssql", ("sql", False): "sql",
             ("Go", True): "golang", ("node.js", False): "node", ("power bi server", False): "pbis"}
    phrases = spark.createDataFrame([(p, c, t) for (p, c), t in table.items()], "phrase string, cased boolean, term string")
    df = spark.createDataFrame(texts, "id int, text string")
    got: dict = {}
    for r in vocab.match_phrases(df, ["id"], "text", phrases).collect():
        got.setdefault(r["id"], {})[r["term"]] = r["n"]
    for i, text in texts:
        assert got.get(i, {}) == greedy(text, table, 3), text


def test_find_terms_is_whole_word(spark):
    terms = (Term("excel", "Excel", "tool", ("excel",)), Term("node", "Node", "tool", ("node.js",)), Term("adhoc", "Ad hoc", "method", ("ad hoc",)))
    df = spark.createDataFrame([("excellent node.js and Excel, excel",)], "t string")
    found = {x["term"]: x["n"] for x in df.select(vocab.find_terms("t", terms).alias("f")).first()["f"]}
    assert found == {"excel": 2, "node": 1}


def test_closure_and_expand(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "term string, implied string")
    got = {(r["term"], r["implied"]) for r in vocab.closure(edges).collect()}
    assert {t for f, t in got if f == "a"} == {"a", "b", "c"} and ("x", "y") in got and ("y", "y") in got


def test_spellings_of_the_library(spark):
    rows = [("j1", "Microsoft Excel", True), ("j2", "Microsoft Excel", True), ("j3", "Human resource information system (HRIS)", True),
            ("j4", "Web Server Software", False)]
    software = spark.createDataFrame(rows, "job string, product string, hot boolean")
    freq = spark.createDataFrame([("excel", 3.7), ("microsoft", 3.0), ("web", 5.0), ("server", 5.0), ("human", 5.2), ("resource", 4.5), ("information", 5.5)], "word string, zipf double")
    lib = {(r["product"], r["phrase"], r["cased"]) for r in vocab.build_library(software, freq, ("Microsoft",)).collect()}
    assert ("Microsoft Excel", "microsoft excel", False) in lib
    assert ("Human resource information system (HRIS)", "HRIS", True) in lib
    # "Excel" alone is an everyday word once the vendor goes.
    assert not any(p == "excel" for _, p, _ in lib)


def test_select_bullets_floor_then_gain(spark):
    parsed = spark.createDataFrame([(1, [("sql", 3), ("python", 2), ("excel", 3)])], "jd int, terms array<struct<term:string,weight:int>>")
    bullets = [{"id": "a", "parent": "e", "tags": ("sql", "excel"), "priority": 1}, {"id": "b", "parent": "e", "tags": ("sql",), "priority": 9},
               {"id": "c", "parent": "p", "tags": ("python",), "priority": 1}]
    entries = [{"id": "e", "min": 1, "max": 2}, {"id": "p", "min": 0, "max": 1}]
    got = [(r["entry"], r["bullet"], r["gain"]) for r in skills.select_bullets(parsed, bullets, entries, ("sql", "python", "excel"), 2).orderBy("pos").collect()]
    assert got == [("e", "a", 6.0), ("p", "c", 2.0)]


def test_best_name_of_a_domain(spark):
    rows = [("Bowe House", "https://vcu.edu/a"), ("Virginia Commonwealth University", "http://maps.vcu.edu"), ("Cafe", "https://www.vcu.edu"), ("Cafe", "https://vcu.edu"),
            ("Bon Secours", "bonsecours.com"), ("Lobby Cafe", "bonsecours.com")]
    pins = spark.createDataFrame(rows, "name string, website string").withColumn("tags", F.create_map(F.lit("shop"), F.lit("x")))
    got = {r["site"]: (r["name"], r["pins"]) for r in companies.collapse_pins(pins).collect()}
    assert got == {"vcu.edu": ("Virginia Commonwealth University", 4), "bonsecours.com": ("Bon Secours", 2)}


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"title": " Data  Analyst ", "absolute_url": "https://x/1", "location": None, "departments": None,
                                                           "content": "&lt;p&gt;x&lt;/p&gt;", "first_published": None, "updated_at": "2026-05-01T10:00:00-04:00", "id": 7, "new_key": 1}]}))
    (tmp_path / "b.json").write_text("<html>down</html>")
    landed = payloads.read_payloads(spark, str(tmp_path), "Acme")
    rows = payloads.greenhouse(landed).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["company"], r["location"], r["external_id"], r["department"]) == ("Data Analyst", "Acme", "", "7", "")
    assert r["posted_at"].isoformat() == "2026-05-01T14:00:00"
    assert payloads.corrupt_payloads(landed).count() == 1


def test_snapshot_files(spark, tmp_path):
    for day, rows in (("01", [{"title": "A", "company": "X", "posted_at": "2026-05-01"}]), ("02", [{"title": "", "company": "X"}, {"title": "B", "company": "Y", "odd": 1}])):
        (tmp_path / f"jobs_{day}.json").write_text(json.dumps(rows))
    (tmp_path / "jobs_03.json").write_text("{broken")
    got = payloads.read_snapshots(spark, [str(p) for p in tmp_path.glob("jobs_*.json")]).collect()
    assert sorted((r["file"], r["title"]) for r in got) == [("jobs_01.json", "A"), ("jobs_02.json", "B")]
    assert payloads.read_snapshots(spark, [str(p) for p in tmp_path.glob("jobs_*.json")], keep=2).count() == 1


def test_all_snapshot_files_are_read_or_told(spark, tmp_path):
    paths = [str(tmp_path / f"jobs_{i:03d}.json") for i in range(95)]
    for i, path in enumerate(paths):
        with open(path, "w") as f:
            f.write("{broken" if i in (1, 93) else json.dumps([{"title": f"T{i}", "company": "X"}]))
    got = {r["title"] for r in payloads.read_snapshots(spark, paths).collect()}
    assert got == {f"T{i}" for i in range(95)} - {"T1", "T93"}
    assert {r["file"] for r in payloads.unreadable_snapshots(spark, paths).collect()} == {"jobs_001.json", "jobs_093.json"}


def test_refused_rows_are_kept(spark, tmp_path):
    fields = "uid string, dedupe_key string, source string, collected_at timestamp"
    raw = spark.createDataFrame([("u", "k", "a", None), ("", "k", "b", None), (None, None, "c", None), ("u", "", "d", None)], fields)
    for path, quarantine in ((str(tmp_path / "raw"), None), (str(tmp_path / "other"), str(tmp_path / "bad"))):
        sinks.write_raw(raw, path, quarantine)
        assert [r["source"] for r in spark.read.parquet(path).collect()] == ["a"]
        assert sorted(r["source"] for r in spark.read.parquet(quarantine or path + "-refused").collect()) == ["b", "c", "d"]


def test_slug_parts(spark):
    rows = [("data-analyst-columbus-ohio-united-states", "Data Analyst", "Columbus, Ohio, United States"),
            ("fair-housing-investigator-richmond-virginia-united-states-0a1b2c3d-0000-1111-2222-0123456789ab", "Fair Housing Investigator", "Richmond, Virginia, United States"),
            ("nurse-charleston-west-virginia", "Nurse", "Charleston, West Virginia"), ("clerk", "Clerk", "")]
    df = spark.createDataFrame(rows, "s string, t string, l string")
    for r in df.withColumn("p", payloads.slug_parts(F.col("s"))).collect():
        assert (r["p"]["title"], r["p"]["location"]) == (r["t"], r["l"]), r


def test_hosting_signatures(spark):
    rows = [("https://x.com", '<a href="https://acme.wd5.myworkdayjobs.com/en-US/Jobs/job/1">', "workday", "acme"),
            ("https://x.com", "https://career.successfactors.com/career?company=AcmeCo", "successfactors", "AcmeCo"),
            ("https://boards.greenhouse.io/acme", "", "greenhouse", "acme"), ("https://x.com", "nothing", "", "")]
    df = spark.createDataFrame(rows, "u string, h string, a string, t string")
    for r in df.withColumn("g", companies.hosting("u", "h")).collect():
        assert (r["g"]["ats"], r["g"]["tenant"]) == (r["a"], r["t"]), r


def test_the_trie_goes_on_only_from_live_prefixes(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e", "f", "A", "B"]
    library = {(" ".join(rng.choice(words[:6]) for _ in range(rng.randint(1, 7))), False) for _ in range(25)} | {("A b", True), ("B", True)}
    rows = [(p, c, f"{p}/{c}") for p, c in library]
    phrases = spark.createDataFrame(rows, "phrase string, cased boolean, term string")
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(60, None), (61, "")]
    texts += [(62, "a b c d " * 3000)]
    df = spark.createDataFrame(texts, "id int, text string")
    got: dict = {}
    for r in vocab.match_phrases(df, ["id"], "text", phrases).collect():
        got.setdefault(r["id"], {})[r["term"]] = r["n"]
    table = {(p, c): t for p, c, t in rows}
    for i, text in texts:
        assert got.get(i, {}) == greedy(text or "", table, 7), i
    edges = trie.phrase_trie(phrases)
    sizes = [rows.count() for rows in trie.levels(df, ["id"], "text", edges)]
    n_tokens = sum(len((t or "").split()) for _, t in texts)
    # Only the ends of the library's longer phrases go on, and each level has fewer than live ones before.
    assert len(sizes) <= 7 and all(n < n_tokens for n in sizes[1:])


def test_matching_with_an_empty_library(spark):
    phrases = spark.createDataFrame([], "phrase string, cased boolean, term string")
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert vocab.match_phrases(df, ["id"], "text", phrases).collect() == []
