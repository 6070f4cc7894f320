"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import chat, embedding_lsh, licences, media, minhash, mixing, oracles, packing, quality, suffix_dedup, token_files
from docengine.llm.common import scratch
from docengine.llm.tokens import with_crc32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    read = chats.select("conv_id", "valid", chat.formatted("segments").alias("formatted"), chat.read_loss_text("segments").alias("loss"))
    read = read.withColumn("turns", chat.read_turns(F.col("formatted")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = media.fingerprints(media.render_vectors(_table(spark, sf_dir, "embeddings")))
    return media.match_recordings(prints).withColumnRenamed("rec_id", "vec_id")


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "tie")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return with_crc32(pieces, "ids", "ids_crc32")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))
    ranges = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "repeated_words", "later_words", ranges.alias("spans"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return with_crc32(token_files.read_token_files(spark, path), "ids", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_minhash_dedup, op3_embedding_dedup, op4_chat, op5_chroma, op6_cube_mixing, op7_packing, op8_suffix_dedup, op9_licences, op10_token_files)}
#: The others train models, sample or tokenize, which SQL cannot express.
ORACLES: dict[str, str] = {"op2_minhash_dedup": oracles.MINHASH, "op3_embedding_dedup": oracles.EMBEDDING, "op4_chat": oracles.CHAT, "op8_suffix_dedup": oracles.REPEATS}
