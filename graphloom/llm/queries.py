"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cap_filters, chat, edit_fingerprint, line_dedup, ngram_join, packing, partition_search, sharding, token_files, toxicity, turn_repair, whitening
from .common import documents


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(documents(spark, sf_dir))


def recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_ids=False)


def edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprint_edits(documents(spark, sf_dir))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by their fingerprints."""
    return edit_fingerprint.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_links", "component_id")


def token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def cuckoo_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=4)


def learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


def signature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_jaccard_join,
    "op2_recurrent_toxicity": recurrent_toxicity,
    "op3_chat_round_trip": chat_round_trip,
    "op4_byte_bpe": byte_bpe,
    "op5_edit_fingerprints": edit_fingerprints,
    "op6_token_orc": token_orc,
    "op7_embedding_caps": embedding_caps,
    "op8_cuckoo_line_dedup": cuckoo_line_dedup,
    "op9_hypergeometric_shards": hypergeometric_shards,
    "op10_tiered_packing": tiered_packing,
    "op11_lanczos_whitening": lanczos_whitening,
    "op12_learned_partitions": learned_partitions,
    "op13_signature_repair": signature_repair,
    "fingerprint_groups": fingerprint_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op8_cuckoo_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        stripped AS (
            SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare FROM lines),
        keyed AS (
            SELECT *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM stripped),
        frequent AS (
            SELECT line_key, max(doc_id) AS last_doc FROM keyed WHERE length(line_key) >= 40
            GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5)
        SELECT k.doc_id, count(*) AS n_lines,
               count(*) FILTER (f.last_doc IS NOT NULL AND k.doc_id < f.last_doc) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.last_doc IS NULL OR k.doc_id = f.last_doc), '')) AS kept_sha256
        FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key
        GROUP BY k.doc_id""",
}
