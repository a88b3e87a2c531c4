"""Token ids as files: frequency-ranked, byte-aligned variable-length codes, control bytes apart.

Layout of the written table: a shard holds a range of doc_id in ascending order, a row is a block of
whole documents. ``control`` has two bits for each value (its bytes less one), four values to a byte;
``data`` has the values' bytes, little end first. A value is the id's rank by frequency over the whole
corpus, so common ids take one byte. ``vocab`` beside it maps ranks back to ids. Blocks carry their
number of ids and where they start within the shard; a shard's own start is the sum before it.

Defined cases: null and empty texts have the end id only; documents of one doc_id stand in the order of
their ids' bytes, null doc_ids come first; an empty table writes no block and reads back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, fresh_path, remove, text_of
from turnwise.llm.encoder import END_ID, encoder, id_type, slices

BLOCK_IDS = 1 << 20
BLOCK_SCHEMA = "shard int, block int, start_in_shard long, n_ids long, doc_ids array<long>, lens array<long>, control binary, data binary"

# bytes of each of the four values that a control byte stands for
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit integers."""
    v = values.astype("<u4")
    n = (v > 0xFF).view(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = n
    q = quads.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    width = int(n.max(initial=0)) + 1
    used = np.arange(width, dtype=np.uint8) <= n[:, None]
    return control.tobytes(), np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4)[:, :width])[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    width = int(n.max(initial=1))
    part = np.zeros((count, width), np.uint8)
    part[np.arange(width, dtype=np.uint8) < n[:, None]] = np.frombuffer(data, np.uint8)
    out = part[:, 0].astype("<u4")
    for k in range(1, width):
        out |= part[:, k].astype("<u4") << np.uint32(8 * k)
    return out


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (bytes of unsigned integers of the tokenizer's id_type, the end id last)."""
    bounded_batches(docs.sparkSession)
    end = np.array([END_ID], dtype=id_type(tokenizer)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids = [x + end for x in enc.encode(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def frequencies(ids: DataFrame, kind: str) -> np.ndarray:
    """Ids from the most frequent to the least. The table has one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=len(total))
            c[: len(total)] += total
            total = c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    spark = docs.sparkSession
    work = fresh_path(spark, "ids")
    encoded(docs, tokenizer).write.option("compression", "zstd").parquet(work)
    ids = spark.read.schema("doc_id long, ids binary").parquet(work)
    kind = id_type(tokenizer)
    by_rank = frequencies(ids, kind)
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    held = spark.sparkContext.broadcast(ranks)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, doc_ids, parts, size
            control, data = pack(held.value[np.concatenate(parts)])
            row = {
                "shard": [shard], "block": [block], "start_in_shard": [start], "n_ids": [size],
                "doc_ids": [doc_ids], "lens": [[len(p) for p in parts]], "control": [control], "data": [data],
            }
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], list(row))
            block, start, doc_ids, parts, size = block + 1, start + size, [], [], 0
            return out

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(x.as_buffer(), kind)
                if parts and size + len(v) > BLOCK_IDS:
                    yield flush()
                doc_ids.append(d)
                parts.append(v)
                size += len(v)
        if parts:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = ids.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(run, BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    vocab = spark.createDataFrame([(np.asarray(by_rank, "<u4").tobytes(),)], "ids binary")
    vocab.coalesce(1).write.parquet(f"{path}/vocab")
    remove(spark, work)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, as decoded from the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shards = sorted(map(tuple, blocks.groupBy("shard").agg(F.sum("n_ids")).collect()))  # one row for each shard
    starts, at = {}, 0
    for shard, n in shards:
        starts[shard], at = at, at + n
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/vocab").first()[0], "<u4")
    held = spark.sparkContext.broadcast((by_rank, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, first = held.value
        for b in batches:
            for r in range(b.num_rows):
                shard, at, n, docs, lens, control, data = (b.column(k)[r].as_py() for k in range(7))
                raw = ids_of[unpack(control, data, n)].tobytes()
                lens = np.array(lens, np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens.tolist())]
                cols = [pa.array(docs, pa.int64()), pa.array(first[shard] + at + ends - lens), pa.array(lens), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    picked = blocks.select("shard", "start_in_shard", "n_ids", "doc_ids", "lens", "control", "data")
    return picked.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
