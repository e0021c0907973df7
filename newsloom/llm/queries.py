"""Queries of the operators over their whole tables, with SQL where SQL has the means."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import audit, bpe, exact, langid, packing, quality, secrets, sharding, simhash, tools, urls, warc, whiten
from newsloom.llm.quality_sql import OP1_SQL
from newsloom.session import fresh_path

#: Tokenizer file of packing and encoding.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.assess(_table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = [F.crc32("ids").alias("ids_crc32")]
    got = packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, digest=digest)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tools.turns_as_calls(_table(spark, sf_dir, "conversations"))
    got = tools.link(calls, results, tools.REPLY)
    return got.withColumn("faults", F.array_join("faults", "; "))


OP3_SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations
),
c AS (
  SELECT conv_id, 'call-' || turn AS call_id, turn, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS level
  FROM r WHERE role = 'assistant'
),
a AS (
  SELECT conv_id, coalesce('call-' || before, 'start') AS call_id, CAST(to_json({'role': role, 'text': text}) AS VARCHAR) AS content
  FROM r WHERE role <> 'assistant'
)
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, level,
  CASE WHEN turn IS NULL THEN 'orphan' WHEN length(text) > 1000 THEN 'invalid' WHEN content IS NULL THEN 'open' ELSE 'done' END AS status,
  CASE WHEN length(text) > 1000 THEN 'range of chars' ELSE '' END AS faults,
  '{"arguments":' || CASE WHEN turn IS NULL THEN 'null'
    ELSE '{' || CASE WHEN contains(text, '?') THEN '"asks":true,' ELSE '' END || '"chars":' || length(text)
      || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}' END
  || ',"call_id":"' || coalesce(c.call_id, a.call_id) || '","name":' || CASE WHEN turn IS NOT NULL THEN '"reply"' ELSE 'null' END
  || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
"""


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "shards")
    sharding.write_shards(sharding.two_pass_shuffle(_table(spark, sf_dir, "documents")), path)
    got = sharding.read_shards(spark, path)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return got.select(
        F.col("row.doc_id").alias("doc_id"), sharding.record_bytes(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return got.select(
        "page_id", F.col("full_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"), "refers_to",
    )


OP5_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id > page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact.new_index(spark)
    got = exact.deduplicate(_table(spark, sf_dir, "documents"), index)
    # The verdicts are written; the index has done its work here.
    index.forget()
    return got


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op7_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).drop("hash", "sure")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    kinds = [r.kind for r in secrets.BASE]
    base = secrets.joined(F.filter(spans, lambda s: s["kind"].isin(kinds)))
    return secrets.find_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pack": op2_pack,
    "op3_tool_calls": op3_tool_calls,
    "op4_shard": op4_shard,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_filter_urls": op7_filter_urls,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_whiten": op12_whiten,
    "op13_secrets": op13_secrets,
}
SQL: dict[str, str] = {
    "op1_quality": OP1_SQL,
    "op3_tool_calls": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op13_secrets": secrets.OP13_SQL,
}
