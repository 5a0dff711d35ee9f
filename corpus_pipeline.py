"""Documents made ready for training: toxic ones out, one of each group of near
duplicates kept, personal data taken out, the rest packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of ``documents``; ``n_chars`` follows the text.
Clean documents stay, also those without text. Every case that the operators define
(nulls, empty and very long texts, repeated rows, empty tables, more columns) holds
here too. Rows that repeat an id are one document: the least of them stays. Rows without
an id are never duplicates. A table without ``n_chars`` goes without it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.llm import near_dup, packing, pii, toxicity
from hirescope.llm.words import set_up
from hirescope.session import scratch, written

#: Words in a shingle and per cent of similarity from which documents are duplicates.
SHINGLE, SIMILAR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_up(spark)
    return toxicity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_up(spark)
    groups = near_dup.near_duplicates(docs, size=SHINGLE, percent=SIMILAR)
    gone = written(groups.filter("NOT kept").select("doc_id").distinct(), "gone")
    kept = docs.join(near_dup.small(gone), "doc_id", "left_anti").select(*docs.columns)
    # Rows that repeat an id are one document, whose least row stays; other rows aren't moved for it.
    repeated = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    one = kept.join(near_dup.small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(near_dup.small(repeated), "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_up(spark)
    clean = pii.sanitised(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    set_up(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", take_out_personal_data),
    ("packing", pack),
]

#: No stage but the last can be said in SQL: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
