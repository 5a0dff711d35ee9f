"""The registered queries of these operators, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirescope.llm import (
    alignment, ann, byte_pairs, chat, licenses, lm_score, media, near_dup, packing, pieces, pii, repair, toxicity)
from hirescope.llm.words import set_up

Query = Callable[[SparkSession, str], DataFrame]

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    set_up(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM documents
), o AS (
    SELECT doc_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), p AS (
    SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS context FROM o
), total AS (SELECT count(*) AS n FROM o),
word_all AS (SELECT word, count(*) AS c FROM o GROUP BY 1), word_own AS (SELECT doc_id, word, count(*) AS c FROM o GROUP BY 1, 2),
pair_all AS (SELECT context, word, count(*) AS c FROM p WHERE context IS NOT NULL GROUP BY 1, 2),
pair_own AS (SELECT doc_id, context, word, count(*) AS c FROM p WHERE context IS NOT NULL GROUP BY 1, 2, 3),
s AS (
    SELECT p.doc_id, p.context IS NULL AS is_first, total.n - p.n_words AS others, wa.c - wo.c AS c_word,
        pa.c - po.c AS c_pair, ca.c - co.c AS c_context
    FROM p CROSS JOIN total JOIN word_all wa ON p.word = wa.word JOIN word_own wo ON p.doc_id = wo.doc_id AND p.word = wo.word
    LEFT JOIN pair_all pa ON p.context = pa.context AND p.word = pa.word
    LEFT JOIN pair_own po ON p.doc_id = po.doc_id AND p.context = po.context AND p.word = po.word
    LEFT JOIN word_all ca ON p.context = ca.word LEFT JOIN word_own co ON p.doc_id = co.doc_id AND p.context = co.word
), v AS (
    SELECT doc_id, coalesce(c_pair > 0, false) AS known,
        CASE WHEN c_pair > 0 THEN c_pair::DOUBLE / c_context
            ELSE (CASE WHEN is_first THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END)
                * (CASE WHEN c_word > 0 THEN c_word::DOUBLE / greatest(others, 1) ELSE 0.4::DOUBLE / (others + 1) END) END AS value FROM s
), d AS (
    SELECT doc_id, CAST(sum(known::INT) AS BIGINT) AS n_known, CAST(sum(CAST(round_even(ln(value) * 1e6, 0) AS BIGINT)) AS BIGINT) AS log_micro FROM v GROUP BY 1
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_known, 0) AS n_known, coalesce(log_micro, 0) AS log_micro,
    CASE WHEN len(words) > 0 THEN log_micro / 1e6::DOUBLE / len(words) END AS score
FROM w LEFT JOIN d ON w.doc_id = d.doc_id
"""


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(text).alias("text")) for i, role in enumerate(("user", "assistant"))))))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.expanded(turns.unionByName(extra)))


OP4_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, 4 + length(role) + 2 + 8
        + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) AS size FROM t
), c AS (
    SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(size) + coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, decoded, and the decoded text's hash."""
    rows = pieces.decoded(pieces.encoded(_table(spark, sf_dir, "documents"), PIECE_VOCABULARY), PIECE_VOCABULARY)
    return rows.select("doc_id", "n_pieces", "ids_crc32", "score", F.sha2("text", 256).alias("decoded_sha256"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(_table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded, and the hashes of both."""
    vocabulary = BYTE_RANKS, public_tokenizers.PATTERN
    rows = byte_pairs.decoded(byte_pairs.encoded(_table(spark, sf_dir, "documents"), *vocabulary), *vocabulary)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_lm_score, op3_licenses, op4_chat, op5_pieces, op6_media, op7_near_dup, op8_ann, op9_packing, op10_pii,
        op11_repair, op12_byte_pairs, op13_alignment)}


def checks() -> dict[str, str]:
    return {"op2_lm_score": OP2_SQL, "op4_chat": OP4_SQL}
