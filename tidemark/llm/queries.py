"""The registered queries of this subpackage: name, callable and, where SQL can say it, oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprints, licenses, mixing, ngramjoin, quality, sharding, substrings, toxicity
from .common import crc_fold, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").filter(~held_out), label="toxic")
    scored = model.score(docs.withColumn("held_out", held_out))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean_ratio", "stretch_ratio")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels").filter(~held_out), label="quality")
    scored = quality.score(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return sharding.place(docs).select("doc_id", "n_bytes", "slot", "shard")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngramjoin.with_components(docs).select("doc_id", "n_shingles", "component_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = read(spark, sf_dir, "conversations")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).drop("text")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_substrings": op6_substrings,
    "op7_fingerprints": op7_fingerprints,
    "op8_ngram_join": op8_ngram_join,
    "op9_chat": op9_chat,
    "op10_decontaminate": op10_decontaminate,
}


def _shard_sql() -> str:
    table = sharding.lookup_table(sharding.shard_names(sharding.SHARDS))
    return f"""
WITH cells AS (SELECT unnest(generate_series(0, {len(table) - 1})) AS slot, unnest([{",".join(map(str, table))}]) AS shard),
placed AS (
  SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {len(table)} AS slot
  FROM documents)
SELECT doc_id, n_bytes, CAST(slot AS BIGINT) AS slot, CAST(shard AS INTEGER) AS shard FROM placed JOIN cells USING (slot)"""


_CHAT_SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|/?OUT\]|/?SYS\]|ROLE:)')) + 8
            + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 5 WHEN 'system' THEN 5 ELSE 7 + 2 * strlen(role) END AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

ORACLE_SQL = {"op5_sharding": _shard_sql(), "op9_chat": _CHAT_SQL}
