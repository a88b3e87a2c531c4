"""The corpus pipeline: toxic and poor documents go, one of each group of near-duplicates stays, sources
are mixed to weights, and what is left is encoded. Every stage reads what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import bpe, mixing, near_dedup, quality, toxicity
from turnwise.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the limit, trained on the rows of docs that have labels. Null and empty texts
    score as clean and stay, as do null doc_ids and repeated rows, each judged; no labels: all stay."""
    return toxicity.keep_clean(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the threshold table. Null, empty and very short texts go; null
    doc_ids and repeated rows are each judged."""
    return quality.keep_clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at five words and 0.8: the least doc_id's, of several the least text hash; rows
    of null ids stay only where their group has no other. Rows without words are no copies of each other,
    but of rows alike in doc_id and text one stays."""
    return near_dedup.one_of_each(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. A null source is one of its own; rows without words count nothing
    and follow their key; repeated rows are each a row, of which the cut may take some."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of decoded bytes for each row; null texts count as empty."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Models and MinHash candidates have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
