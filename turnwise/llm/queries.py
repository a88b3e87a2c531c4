"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from turnwise.llm import binary, bpe, chat, embedding_dedup, licenses, mixing, near_dedup, quality, token_counts, toxicity
from turnwise.llm.common import fresh_path, read


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    binary.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return binary.read_back(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trick = spark.range(2).selectExpr(
        "cast(-1 as bigint) AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{chat.TRICK}' AS text"
    )
    return chat.digests(rows.unionByName(trick))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.resolved(read(spark, sf_dir, "documents"), k=3, percent=85).drop("digest")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.resolved(read(spark, sf_dir, "embeddings"), cosine=0.93)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the cache begins empty here, so that every run does the whole work
    cache = fresh_path(spark, "count-cache")
    return token_counts.counted(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_binary": op1_token_binary,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat.OP3_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_license_scan": licenses.OP10_SQL,
}
