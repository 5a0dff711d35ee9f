"""The landing stream: broken documents, replays, and going on from a checkpoint."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from hirescope.plans import stream_queries
from hirescope.streaming import landing


def line(i, source="greenhouse", payload=None, **more):
    payload = {"jobs": [{"title": f"Analyst {i}", "id": i, "absolute_url": f"u{i}"}]} if payload is None else payload
    return json.dumps({"doc_id": str(i), "source": source, "company": "Acme", "slug": "acme", "payload": payload} | more)


def files(folder: Path):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def run(spark, tmp_path, **more):
    paths = [str(tmp_path / n) for n in ("in", "postings", "unreadable", "checkpoint")]
    landing.land_all(spark, *paths, files_per_batch=1, **more)
    return spark.read.parquet(paths[1]), spark.read.parquet(paths[2])


def test_a_broken_document_costs_only_itself(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join([line(1), '{"doc_id": "2", "source": "lev', line(3, "smoke-signals"), line(4, payload={"total": 0})]))
    (tmp_path / "in" / "2.json").write_text("\n".join([
        line(5, "lever", [{"text": "Clerk", "id": "x"}]), line(6, payload=""), line(7, "greenhouse", {"jobs": []}), "[]", "", "nonsense",
        line(8, "workday", {"jobPostings": [{"title": "Nurse", "externalPath": "/job/1", "postedOn": "Posted Today"}]}, host="h.example", site="s")]))
    postings, unreadable = run(spark, tmp_path, as_of="2024-05-01 00:00:00")
    assert sorted((r.source, r.title) for r in postings.collect()) == [("greenhouse", "Analyst 1"), ("lever", "Clerk"), ("workday", "Nurse")]
    told = sorted((r.doc_id or "", r.reason) for r in unreadable.collect())
    assert [r for r in told if r[0]] == [("3", "unknown source"), ("4", "no list of postings"), ("6", "no payload")]
    assert sum(reason in ("not JSON", "unknown source") for i, reason in told if not i) >= 2
    assert all(r.file.endswith(".json") for r in unreadable.collect())
    report = {(r.batch, r.source): (r.postings, r.unreadable) for r in landing.land_report(postings, unreadable).collect()}
    assert sum(p for p, _ in report.values()) == 3 and sum(u for _, u in report.values()) == len(told)


def test_a_replayed_batch_changes_nothing_and_a_second_run_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join([line(10 * i + j) for j in range(4)] + ["broken"]))
    postings, unreadable = run(spark, tmp_path)
    before = sorted(r.title for r in postings.collect())
    stamps = files(tmp_path / "postings")
    file = unreadable.filter("batch = 1").first().file
    landing.land(str(tmp_path / "postings"), str(tmp_path / "unreadable"))(landing.landed(spark, file, stream=False), 1)
    after = files(tmp_path / "postings")
    untouched = [p for p in stamps if "batch=1" not in str(p)]
    assert all(after[p] == stamps[p] for p in untouched)
    spark.catalog.clearCache()
    again = spark.read.parquet(str(tmp_path / "postings"))
    assert sorted(r.title for r in again.collect()) == before and len(before) == 12
    (tmp_path / "in" / "9.json").write_text(line(99))
    postings, unreadable = run(spark, tmp_path)
    assert postings.count() == 13 and unreadable.count() == 3
    assert {p: t for p, t in files(tmp_path / "postings").items() if p in after} == after


def test_a_batch_without_a_readable_document(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("no\njson\n")
    postings, unreadable = run(spark, tmp_path)
    assert postings.count() == 0 and unreadable.count() == 2


def test_landed_files_are_compressed(spark, tmp_path):
    """The landing folder took six times the disk."""
    lines = spark.range(20_000).selectExpr("""concat('{"doc_id":"', id, '","source":"lever","payload":[{"text":"Data Analyst","id":"', id, '"}]}') AS value""")
    stream_queries._land_files(lines, str(tmp_path / "in"), 2)
    files = [p for p in (tmp_path / "in").iterdir() if p.suffix in (".txt", ".gz")]
    raw = lines.selectExpr("sum(length(value) + 1) AS n").first().n
    assert len(files) == 2 and sum(p.stat().st_size for p in files) < raw / 4
    good, bad = landing.read_documents(landing.landed(spark, str(tmp_path / "in"), stream=False))
    assert (good.count(), bad.count()) == (20_000, 0)


def test_reasons_are_told_once(spark, tmp_path):
    """Every document was parsed for its reason once a source, and again for both tables."""
    (tmp_path / "a.json").write_text('{"doc_id":"1","source":"lever","payload":[]}\n{"doc_id":"2","source":"x","payload":[]}\n')
    judged = landing.judged(landing.landed(spark, str(tmp_path), stream=False))
    assert landing.judged(judged) is judged
    good, bad = landing.read_documents(judged.withColumn("reason", F.lit("told")))
    assert (good.count(), [r.reason for r in bad.collect()]) == (0, ["told", "told"])
    assert [(r.doc_id, r.reason) for r in landing.read_documents(judged)[1].collect()] == [("2", landing.UNKNOWN)]
