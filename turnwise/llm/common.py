"""Shared plumbing of the training-data operators: tables, words, shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.storage import fresh_path, shared_dir, written  # noqa: F401

#: ASCII white space splits words; everything else, however exotic, belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a working table, through Hadoop, so that any store will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """ARRAY<STRING> of the words of a text that is not null; empty for a blank one."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def crc_mod(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


#: Bytes and rows of text at once on their way to a Python worker.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches in this session, unless it has sizes of its own: Spark's default of 10,000 rows
    is too many where rows are whole documents."""
    for key, (default, small) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, small)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow; behind it, freed memory goes back to the system. Workers are used again and wait in
    a pool, where each would keep the most that any of its tasks has had."""

    @functools.wraps(run)
    def leaving_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # of glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return leaving_none
