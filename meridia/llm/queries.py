"""The ten operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import decontamination, interpolation, mixing, near_duplicates, repeated_phrases, repetition, sharding, token_files, toxicity, warc
from meridia.llm._store import shared, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases.digest(repeated_phrases.remove_repeats(table(spark, sf_dir, "documents"), window=35))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_bundles(table(spark, sf_dir, "pages"), shared(spark))
    return warc.read_bundles(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def remainder(key: str, modulus: int, value: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == value, F.lit(False))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7, 2))


def op7_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(table(spark, sf_dir, "documents"))


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"), shared(spark), vocabulary())
    return token_files.read_shards(manifest)


def op9_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 4, 2)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_offending", "worst_sentence", "worst_score")


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.hash_tree(table(spark, sf_dir, "documents"), sharding.layout(24), sharding.layout(25))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The rows of op2_warc_bundles.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY body)
SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM coalesce(first, page_id) THEN first END AS refers_to
FROM p LEFT JOIN f ON p.body = f.body
"""


def queries() -> dict[str, Query]:
    return {
        "op1_repeated_phrases": op1_repeated_phrases,
        "op2_warc_bundles": op2_warc_bundles,
        "op3_minmax_hashing": op3_minmax_hashing,
        "op4_string_tiling": op4_string_tiling,
        "op5_low_discrepancy_mix": op5_low_discrepancy_mix,
        "op6_deleted_interpolation": op6_deleted_interpolation,
        "op7_suffix_repetition": op7_suffix_repetition,
        "op8_repair_tokens": op8_repair_tokens,
        "op9_mil_toxicity": op9_mil_toxicity,
        "op10_hash_tree": op10_hash_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_bundles": WARC, "op5_low_discrepancy_mix": mixing.ORACLE}
