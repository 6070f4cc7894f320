"""A corpus from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows and rereads them for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docengine.llm import minhash, mixing, packing, quality, suffix_dedup
from docengine.llm.common import materialize, release


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, predicts good. Each row is judged by its own text."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay only where they come first."""
    return suffix_dedup.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix to target weights takes them."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents, with their ids, sequences and step groups."""
    return packing.with_step_groups(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end=2))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models, cube sampling and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Intermediate tables are deleted as soon as the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = release(spark, since=None)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, since=made, keep=1)
    return docs
