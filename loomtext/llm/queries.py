"""The registered queries of the subpackage. Each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .byte_bpe import round_trip
from .conversations import damaged, repair_conversations
from .exact_dedup import exact_dedup
from .hard_negatives import mine_hard_negatives, shifted_labels
from .mixing import mix_sources
from .pii import find_personal_data
from .quality import fit_quality, score_quality
from .secrets_scan import scan_secrets
from .shared import table
from .simhash import near_duplicates
from .token_counts import token_counts
from .topk import top_k
from .url_filter import filter_urls
from .warc import archive_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a digest in place of the secret."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "ordinal", F.sha2("candidate", 256).alias("candidate_sha256"), "n_chars", "probability", "kept"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(shifted_labels(table(spark, sf_dir, "embeddings")))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "probability")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_topk": op2_topk,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversations": op12_conversations,
    "op13_url_filter": op13_url_filter,
}
ORACLE_SQL = {
    "op1_exact_dedup": oracles.EXACT_DEDUP,
    "op2_topk": oracles.TOP_K,
    "op4_warc": oracles.WARC,
    "op7_mixing": oracles.mixing(),
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
}
