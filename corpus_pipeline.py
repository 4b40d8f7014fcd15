"""A training-corpus pipeline over `documents`: each stage is written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm.language import keep_identified
from cuewright.llm.mixing import apply_mix
from cuewright.llm.near_dup import drop_near_duplicates
from cuewright.llm.pieces import sample_encodings
from cuewright.llm.pii import mask_personal_data
from cuewright.llm.tables import new_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows stay; those that it rejects (no letters, or unlike what was learned of the language) go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with personal data in their texts masked."""
    return mask_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, kept or repeated so that their sources' sizes meet the target weights."""
    return apply_mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, and whether their pieces decode to its text."""
    return sample_encodings(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Learned models and sampled segmentations: SQL cannot express the stages. tests/llm holds each against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
