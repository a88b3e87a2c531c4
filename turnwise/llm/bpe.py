"""Byte-level BPE in Spark higher-order functions over distinct words.

1. A scan cuts texts into the pattern's matches and gives each chunk of documents as one row: the words
   that the task has not met before, and for each document the numbers of its words. The numbering of a
   task begins anew after KNOWN words, so its memory is bounded.
2. ``transform`` encodes the words of a row: ``aggregate`` folds merges over an array of pieces (bytes
   in hex, so that joining pieces joins strings), always the leftmost pair of lowest rank. Ranks are a
   literal: an array of small maps, addressed by the CRC-32 of the key, since one map of 50,000 entries
   would be searched from end to end.
3. The ids of words, kept by number, make the ids of documents; decoding joins the ids' binary pieces.

All three are one stage without a shuffle, so a lost executor costs its tasks only. Small partitions are
put together (not shuffled) up to TASK_BYTES of input, since a task encodes each of its words once. Words of more than
LONG bytes take the same merges from a heap in step 3: the fold copies its array for each merge, which
is quadratic in a word's length.

Defined cases: null text is empty (no ids, digests of the empty string); repeated rows are encoded
each; an empty table gives no rows; doc_id may be null; other columns are ignored or passed on.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, lean, text_of
from turnwise.llm.encoder import PATTERN, SHORT, distinct, is_plain, latin, mixed_bits, piece_keys, plain_pieces, slices

CHUNK = 1_000_000  # characters
KNOWN = 1_000_000  # words
TASK_BYTES = 128 << 20
LONG = 96  # bytes
BUCKETS = 1 << 15
PLACES = 128  # over LONG
NONE = 1 << 40  # over any rank

_tables: dict[str, tuple] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """ARRAY<MAP<hex, rank>> as one literal, folded by the optimizer from its JSON."""
    cells: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        cells[zlib.crc32(key.encode()) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(cells)), "array<map<string,int>>")


def _rank(literal: Column, key: Column) -> Column:
    cell = F.get(literal, F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int"))
    return F.try_element_at(cell, key)


def _let(value: Column, kind: str, body) -> Column:
    """body(value), of SQL type kind, with value computed once.

    A lambda's variable is the only binding that columns have. It is that of aggregate() over one element:
    an item taken out of transform() would ask for its type, and so walk the whole body, each time."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def encode_word(literal: Column, word: Column) -> Column:
    """ARRAY<INT> of the ids of a word (STRING in hex, not empty, of LONG bytes at most).

    The fold's state is one BIGINT for each boundary between pieces that is left, in order: the rank of
    joining there, or NONE, above the boundary's place. So the least one is the leftmost of lowest rank.
    """
    n = F.shiftright(F.length(word), 1)
    place = lambda x: x.bitwiseAND(PLACES - 1).cast("int")

    def rank(a: Column, b: Column) -> Column:
        return _rank(literal, F.substring(word, 2 * a + 1, 2 * (b - a)))

    def boundary(a: Column, at: Column, b: Column) -> Column:
        return F.coalesce(rank(a, b), F.lit(NONE)).cast("bigint") * PLACES + at

    def merge(acc: Column, _: Column) -> Column:
        def at(m: Column) -> Column:
            def joined(j: Column) -> Column:  # j: m's place in the array, from 1
                left, right = F.coalesce(place(F.get(acc, j - 2)), F.lit(0)), F.coalesce(place(F.get(acc, j)), n)
                before = boundary(F.coalesce(place(F.get(acc, j - 3)), F.lit(0)), left, right)
                after = boundary(left, right, F.coalesce(place(F.get(acc, j + 1)), n))
                rest = F.array_remove(acc, m)
                return F.transform(rest, lambda x, i: F.when(i == j - 2, before).when(i == j - 1, after).otherwise(x))

            return F.when(m < NONE * PLACES, _let(F.array_position(acc, m).cast("int"), "array<bigint>", joined)).otherwise(acc)

        return _let(F.array_min(acc), "array<bigint>", at)

    start = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: boundary(k - 1, k, k + 1))).otherwise(F.array().cast("array<bigint>"))

    def ids(left: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(left, place))
        return F.transform(begins, lambda b, i: rank(b, F.coalesce(place(F.get(left, i)), n)))

    def fold(whole: Column) -> Column:
        folded = _let(start, "array<bigint>", lambda s: F.aggregate(s, s, merge))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(_let(folded, "array<int>", ids))

    return _let(_rank(literal, word), "array<int>", fold)


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n, for long words."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that begins here; 0: begins none
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        if e < n:
            prev[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (k := prev[i]) >= 0 and (r := ranks.get(word[k:e])) is not None:
            heapq.heappush(heap, (r, k, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Words:
    """Numbers words in the order in which a task meets them, told apart by their bytes.

    Plain texts are cut by numpy, and their words of up to 15 bytes held as two integers each, in the order
    of a hash; the others are cut by the pattern and, like long words, held in a dict."""

    def __init__(self, pattern: str):
        self.fast = pattern == PATTERN
        self.find = regex.compile(pattern).findall
        self.count = 0
        self.hashes, self.low, self.high = (np.empty(0, np.uint64) for _ in range(3))
        self.numbers = np.empty(0, np.int32)
        self.others: dict[str, int] = {}

    def _other(self, word: str, new: list[bytes]) -> int:
        if word not in self.others:
            self.others[word] = self.count
            self.count += 1
            new.append(word.encode())
        return self.others[word]

    def _short(self, low: np.ndarray, high: np.ndarray, short: np.ndarray, words: list[bytes], new: list[bytes]) -> np.ndarray:
        """Numbers of words by their two integers; -1 where they are not short, or meet another word's hash."""
        h = mixed_bits(low + mixed_bits(high))
        at = np.searchsorted(self.hashes, h)
        met = at < len(self.hashes)
        met[met] = self.hashes[at[met]] == h[met]
        known = met & short
        known[known] = (self.low[at[known]] == low[known]) & (self.high[at[known]] == high[known])
        number = np.full(len(h), -1, np.int32)
        number[known] = self.numbers[at[known]]
        fresh = np.flatnonzero(short & ~met)
        fresh = fresh[np.unique(h[fresh], return_index=True)[1]]
        number[fresh] = self.count + np.arange(len(fresh), dtype=np.int32)
        self.count += len(fresh)
        new += [words[i].decode("latin-1").encode() for i in fresh.tolist()]
        for name, of in (("numbers", number), ("low", low), ("high", high), ("hashes", h)):
            setattr(self, name, np.insert(getattr(self, name), at[fresh], of[fresh]))
        return number

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[bytes]]:
        """Numbers of all words one after the other, how many each text has, and the new words."""
        parts: list = [np.empty(0, np.int32)] * len(texts)
        plain, new = {}, []
        for i, t in enumerate(texts):
            raw = latin(t) if self.fast and is_plain(t) else None
            if raw is not None:
                plain[i] = raw
        if plain:
            raw, s, ends, opens = plain_pieces(list(plain.values()))
            low, high = piece_keys(raw, s, ends)
            first, which = distinct(low, high)
            begin, end = s[first], ends[first]
            words = [raw[x:y] for x, y in zip(begin.tolist(), end.tolist())]
            number = self._short(low[first], high[first], end - begin <= SHORT, words, new)
            for i in np.flatnonzero(number < 0).tolist():
                number[i] = self._other(words[i].decode("latin-1"), new)
            for i, part in zip(plain, np.split(number[which], np.searchsorted(s, opens[1:]))):
                parts[i] = part
        # by numbers: a short word may be held in both ways, and is then encoded twice, to the same ids
        for i, t in enumerate(texts):
            if i not in plain:
                parts[i] = np.array([self._other(w, new) for w in self.find(t)], np.int32)
        return np.concatenate(parts), [len(p) for p in parts], new


CHUNK_SCHEMA = "words array<string>, long_words array<binary>, at binary, counts array<int>, anew boolean"


def chunked(docs: DataFrame, pattern: str) -> DataFrame:
    """keys ARRAY<__key> of a chunk's documents and CHUNK_SCHEMA: words has the new ones in the order of
    their numbers, null for a long one, whose bytes are in long_words; anew: numbering begins at 0."""
    keys = docs.schema["__key"].dataType

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, CHUNK):
                anew = not words.count or words.count > KNOWN
                if anew:
                    words = Words(pattern)
                at, counts, new = words.numbered(texts[lo:hi])
                keyed = b.column(0).slice(lo, hi - lo)
                cols = [
                    pa.ListArray.from_arrays(pa.array([0, len(keyed)], pa.int32()), keyed),
                    pa.array([[w.hex().upper() if len(w) <= LONG else None for w in new]], pa.list_(pa.string())),
                    pa.array([[w for w in new if len(w) > LONG]], pa.list_(pa.binary())),
                    pa.array([at.tobytes()], pa.binary()),
                    pa.array([counts], pa.list_(pa.int32())),
                    pa.array([anew], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["keys", "words", "long_words", "at", "counts", "anew"])

    return docs.select("__key", "text").mapInArrow(run, f"keys array<{keys.simpleString()}>, {CHUNK_SCHEMA}")


def _table(path: str) -> tuple:
    if path not in _tables:
        ranks = ranks_of(path)
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for p, i in ranks.items():
            pieces[i] = p
        _tables[path] = ranks, pieces, [str(i).encode() for i in range(size)]
    return _tables[path]


def encoded(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 for each row of docs."""
    keep = keep or ("doc_id",)
    bounded_batches(docs.sparkSession)
    kept = key_type(docs, keep)
    key = F.struct(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)))
    docs = docs.select(key.alias("__key"), text_of().alias("text"))
    docs = docs.coalesce(_tasks(docs))
    # one literal in the plan, bound to a variable: each mention would be a copy
    words = _let(
        rank_literal(ranks_of(path)),
        "array<array<int>>",
        lambda table: F.transform("words", lambda w: F.when(w.isNotNull(), encode_word(table, w))),
    )
    ids = chunked(docs, pattern).select(
        "keys",
        words.alias("ids"),
        "long_words",
        "at",
        "counts",
        "anew",
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pieces, texts = _table(path)
        pool, size = [], []  # of the words by number: ids one after the other, and how many
        for b in batches:
            for r in range(b.num_rows):
                if b.column(5)[r].as_py():
                    pool, size = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
                words = b.column(1)[r].values
                longer = [merge_heap(w, ranks) for w in b.column(2)[r].as_py()]
                if longer:
                    rest = iter(longer)
                    words = pa.array([next(rest) if w is None else w for w in words.to_pylist()], pa.list_(pa.int32()))
                pool = [np.concatenate([*pool, words.flatten().to_numpy()])]
                size = [np.concatenate([*size, np.diff(words.offsets.to_numpy())])]
                first = np.cumsum(size[0]) - size[0]
                keys = b.column(0)[r].values
                at = np.frombuffer(b.column(3)[r].as_buffer(), "<i4")
                each = size[0][at]
                ends = np.cumsum(each)
                ids = np.repeat(first[at] - (ends - each), each)
                ids += np.arange(len(ids))
                ids = pool[0][ids]
                counts = np.array(b.column(4)[r].as_py(), np.int64)
                cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
                ids_sha, decoded_sha = [], []
                for begin, end in zip(cuts.tolist(), cuts[1:].tolist()):
                    doc = ids[begin:end].tolist()
                    ids_sha.append(hashlib.sha256(b",".join([texts[i] for i in doc])).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join([pieces[i] for i in doc])).hexdigest())
                cols = [keys, pa.array(np.diff(cuts), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = ids.mapInArrow(run, f"key {kept}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(*(F.col(f"key.k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", "ids_sha256", "decoded_sha256")


def _tasks(docs: DataFrame) -> int:
    """One for each core, more where that would give a task more than TASK_BYTES, as Spark estimates."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, docs.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), 1_000_000))


def key_type(docs: DataFrame, keep: tuple[str, ...]) -> str:
    fields = (f"k{i}:{docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return f"struct<{','.join(fields)}>"
