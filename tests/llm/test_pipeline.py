"""Pipeline stages one by one, and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hirescope.llm import pii

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, fields=FIELDS):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], fields)


def words(seed, n=40):
    return " ".join(f"w{(seed * 7919 + i * 31) % 997}x{seed}" for i in range(n))


def similarity(a, b):
    x, y = (({tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} if t and t.split() else set()) for t in (a, b))
    return 100 * len(x & y) / len(x | y) if x | y else 0


def test_one_document_of_each_group_stays(spark):
    base = words(1, 80)
    rows = [(1, base), (2, base), (3, base + " more"), (3, base + " more"), (4, words(2)), (4, words(2)), (5, None), (6, ""), (None, words(3)), (None, words(3))]
    rows += [(10 + i, words(10 + i)) for i in range(5)]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    kept: list = []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if not any(i == j or similarity(t, u) >= 80 for j, u in kept):
            kept.append((i, t))
    assert got == sorted(kept + [r for r in rows if r[0] is None], key=repr)


def test_personal_data_is_taken_out_and_the_length_follows(spark):
    rows = [(1, "write to a.b@example.org now"), (2, "clean text"), (3, None), (4, ""), (4, "")]
    got = {r.doc_id: r for r in corpus_pipeline.take_out_personal_data(spark, documents(spark, rows), "").collect()}
    assert "a.b@example.org" not in got[1].text and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean text" and got[3].text is None and got[4].text == ""


def test_stages_do_without_a_length_column(spark):
    docs = documents(spark, [(1, "mail me@example.org"), (2, "x")]).drop("n_chars")
    assert corpus_pipeline.take_out_personal_data(spark, docs, "").columns == docs.columns


@pytest.mark.parametrize("name", ["_key", "_TEXT", "_terms", "key", "term", "spans"])
def test_columns_with_clashing_names_come_through(spark, name):
    docs = documents(spark, [(1, "write to a.b@example.org now"), (2, "clean")]).withColumn(name, F.lit("own"))
    got = pii.sanitised(docs)
    assert got.columns == docs.columns
    assert all(r[name] == "own" for r in got.collect())


def test_the_last_stage_packs_every_row(spark):
    rows = [(i, words(i, 30)) for i in range(20)] + [(20, None), (20, None), (None, "x")]
    got = corpus_pipeline.pack(spark, documents(spark, rows), "").collect()
    assert len(got) == len(rows) and all(r.offset + r.length <= 2048 for r in got)


def test_an_empty_table_goes_through_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    toxic = [(i, f"you are a worthless stupid idiot and pathetic trash number{i} of all {words(i, 4)}") for i in range(0, 120)]
    clean = [(i, f"the weather in town number{i} is fine and we walk along {words(i, 8)}") for i in range(1000, 1300)]
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, toxic + clean + [(5000, None), (5001, "")])
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert not kept & {i for i, _ in toxic} and {i for i, _ in clean} | {5000, 5001} <= kept
