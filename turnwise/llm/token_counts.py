"""Token counts by a digest cache.

A stored count is found by the digest of the normalised content and the digest of the tokenizer's file.
Only distinct contents that the cache lacks are encoded, once each, and then appended. Normalising must
not change a count, so it only makes null texts empty; the digest is SHA-256 of the UTF-8 bytes.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and copies share one
entry; null doc_ids are counted; a missing cache is an empty one; entries that concurrent runs append
twice agree and are read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from turnwise.llm.common import bounded_batches, text_of, written
from turnwise.llm.encoder import encoder, slices

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def version_of(tokenizer: str) -> str:
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _cached(spark, path: str, version: str) -> DataFrame:
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], CACHE_SCHEMA)
    return known.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; the cache at that path is longer afterwards."""
    spark = docs.sparkSession
    bounded_batches(spark)
    version = version_of(tokenizer)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = written(text.select("doc_id", _digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    misses = misses.join(_cached(spark, cache, version), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        seen: set[bytes] = set()  # rows alike in doc_id and content meet in one task: each content is encoded once
        for b in batches:
            digests = b.column(0).to_pylist()
            fresh = [i for i, x in enumerate(digests) if x not in seen and not seen.add(x)]
            b = b.take(pa.array(fresh, pa.int64()))
            texts = b.column(1).to_pylist()
            n = []
            for lo, hi in slices(texts):
                n += [len(x) // enc.dtype.itemsize for x in enc.encode(texts[lo:hi])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    # each missing content goes along with one of its documents; the small side is hashed, texts are not sorted
    m = misses.select(F.col("digest").alias("m_digest"), F.col("doc_id").alias("m_doc")).hint("shuffle_hash")
    found = text.select("doc_id", _digest(F.col("text")).alias("digest"), "text")
    found = found.join(m, (F.col("digest") == F.col("m_digest")) & F.col("doc_id").eqNullSafe(F.col("m_doc")))
    fresh = found.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    # a table: behind an aggregate, a content with very many copies could not be dealt over tasks by the join
    counts = written(_cached(spark, cache, version), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
