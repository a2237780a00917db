"""One query for each operator: the operator applied to its whole table, and the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, language_id, mixing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity
from .shared import table, written


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.transform("evidence", lambda x: x["doc_id"]).alias("evidence_ids"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(written(sharding.document_sizes(table(spark, sf_dir, "documents")), "sizes"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.format_pairs(chat_format.rejected_variants(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.concat_ws(",", F.transform(F.filter(c, lambda s: s["train"]), lambda s: F.concat_ws("-", s["start"], s["end"])))
    return pairs.select("pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", "rejected", spans("chosen_segments").alias("chosen_train"), spans("rejected_segments").alias("rejected_train"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_toxicity, op3_decontamination, op4_quality_rules, op5_sharding, op6_simhash, op7_substring_dedup, op8_language_id, op9_chat_formatting, op10_mixing)}
#: Operators that SQL can express. (The others learn, draw, or need a hash that the checking engine lacks: tests compare them with brute force.)
ORACLE_SQL: dict[str, str] = {
    "op9_chat_formatting": """
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n, strpos('0123456789abcdef', substr(md5(CAST(conv_id AS BIGINT)::VARCHAR), 1, 1)) - 1 AS kind
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT id AS pair_id, true AS is_chosen, role, text, i FROM c
  UNION ALL SELECT p.id, false, o.role, o.text, o.i FROM c p JOIN c o ON o.id = xor(p.id, 1) WHERE p.i = 1 AND p.kind <= 2
  UNION ALL SELECT id, false, role, text, i FROM c WHERE kind > 2 AND i < n
  UNION ALL SELECT p.id, false, p.role, o.text, p.i FROM c p LEFT JOIN c o ON o.id = xor(p.id, 1) AND o.i = o.n WHERE p.kind > 5 AND p.i = p.n),
m AS (
  SELECT a.pair_id, a.i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE a.is_chosen AND NOT b.is_chosen AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text),
r AS (SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM m),
n AS (
  SELECT p.pair_id, count(r.i) AS prompt_turns
  FROM (SELECT DISTINCT pair_id FROM t) p LEFT JOIN r ON p.pair_id = r.pair_id AND r.i = r.k GROUP BY p.pair_id),
x AS (
  SELECT t.pair_id, t.is_chosen, t.i, t.i <= n.prompt_turns AS shared, n.prompt_turns, coalesce(t.role, '') = 'assistant' AS train,
         '<|im_start|>' || coalesce(t.role, '') || chr(10) AS head, coalesce(t.text, '') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN n ON t.pair_id = n.pair_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body)) FILTER (WHERE NOT shared) OVER (PARTITION BY pair_id, is_chosen ORDER BY i), 0) AS upto FROM x)
SELECT pair_id, prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE shared AND is_chosen), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE NOT shared AND is_chosen), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE NOT shared AND NOT is_chosen), '') AS rejected,
       coalesce(string_agg((upto - length(body))::VARCHAR || '-' || upto::VARCHAR, ',' ORDER BY i) FILTER (WHERE NOT shared AND is_chosen AND train), '') AS chosen_train,
       coalesce(string_agg((upto - length(body))::VARCHAR || '-' || upto::VARCHAR, ',' ORDER BY i) FILTER (WHERE NOT shared AND NOT is_chosen AND train), '') AS rejected_train
FROM y GROUP BY pair_id, prompt_turns""",
}
