"""The numbered operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .language import identify
from .mixing import mix_sources
from .near_dup import near_duplicates
from .negatives import hard_negatives
from .neighbours import nearest
from .packing import pack
from .pieces import sample_encodings
from .pii import personal_data
from .quality import quality
from .repair import audited, damaged, repair_conversations
from .shards import kd_shards
from .substring import remove_repeats
from .tables import table
from .warc import archive_round_trip


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return identify(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document."""
    return sample_encodings(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, against all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the windows that an earlier one has."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by target weights takes of each document."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, and whether the base rules and its perplexity keep it."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality(table(spark, sf_dir, "documents")).select(columns)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as its archive's record tells of it."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of each document."""
    return kd_shards(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    return personal_data(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on each damaged conversation, and the digest of its repair."""
    return audited(repair_conversations(damaged(table(spark, sf_dir, "conversations"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for each positive of every hundredth vector, against all vectors."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op3_nearest_neighbours": oracles.NEAREST,
    "op4_substring_dedup": oracles.SUBSTRINGS,
    "op5_mixing": oracles.MIXING,
    "op7_warc": oracles.WARC,
    "op8_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op12_conversation_repair": oracles.REPAIR,
    "op13_hard_negatives": oracles.NEGATIVES,
}
