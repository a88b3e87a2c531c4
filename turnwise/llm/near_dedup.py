"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact checks.

1. A scan hashes each text's shingles. Of sets over SPARSE it keeps, for each of 256 buckets, the least
   hash as its number of leading zeros and ten mantissa bits (two bytes); of others, where buckets stay
   empty, the minima under as many independent hash functions. Texts of one shingle set form a class;
   its least doc_id goes on for all.
2. Bands of these find candidates. ``rows_for`` takes as many values to a band as keep the chance of
   missing a pair at the threshold under 1e-8. A band's least member links to each other one, so
   candidates grow with the members; their components are groups that no true link leaves.
3. Of each group, the sets are first compared with that of its least class, in blocks of about BLOCK
   classes or BLOCK_SHINGLES shingles, which is linear in the group. Classes that this leaves over are
   compared, by pairs of blocks, with each other and with the rest; pairs that are already connected are
   passed over. In a comparison, the collision-corrected Jaccard estimate from the registers rules pairs
   out (where Chernoff's bound leaves a chance under 1e-9 for the threshold), and the rest is decided on
   the full shingle sets. Only the links of a spanning forest are given out.
4. Components of those links, and of the classes, are the result.

Words are runs of other than ASCII white space, A-Z in lower case. A text of fewer words than a shingle
has is one shingle; a text without words has none and is linked with nothing. Shingles are compared by
64-bit hashes of 64-bit hashes of their words, which take words as a whole (two integers for up to 15
bytes, BLAKE2 for longer ones), so no pattern of letters makes two of them alike.

A class has an id of its own, given when the table of classes is written, and stands for a row of the
table by doc_id and a hash of the text, so neither null nor repeated doc_ids are mixed up.

Defined cases: null text has no words; rows of one doc_id are told apart by their text; null doc_ids
take part, and a component of them alone has a null id; an empty table gives no rows. ``one_of_each``
keeps, of a component, the row of the least doc_id, and of several the one of the least text hash; rows
without words all stay, but of rows alike in doc_id and text one does.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, lean, text_of, written
from turnwise.llm.components import components
from turnwise.llm.encoder import SHORT
from turnwise.llm.encoder import mixed_bits as _mix
from turnwise.llm.encoder import piece_keys

BUCKETS, BUCKET_BITS, MANTISSA = 256, 8, 10
#: Chernoff's exponent for a chance of 1e-9.
RULED_OUT = 9 * np.log(10)
MISS = 1e-8
#: Sets of up to this many shingles are banded by full MinHashes. Over it, a bucket is empty with a chance
#: under 0.003.
SPARSE = 1500
BLOCK, BLOCK_SHINGLES = 800, 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240611)
_R = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = _rng.integers(0, 2**64, BUCKETS, np.uint64) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word, of all its bytes."""
    raw = text.encode().lower()  # bytes.lower() touches A-Z only
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    low, high = piece_keys(raw, starts, ends)
    longer = np.flatnonzero(ends - starts > SHORT)
    if len(longer):  # piece_keys numbers these within the text only
        spans = zip(starts[longer].tolist(), ends[longer].tolist())
        wide = np.frombuffer(b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in spans), np.uint64)
        low[longer], high[longer] = wide[::2], wide[1::2]
    return _mix(low + _mix(high))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(k, len(h))
    s = h[: len(h) - width + 1]
    for j in range(1, width):
        s = _mix(s * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - width + 1 + j])
    return np.unique(s)


def registers(s: np.ndarray) -> np.ndarray:
    """uint16 for each bucket: 0 if empty, else one more than leading zeros and mantissa bits."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(s):
        bucket = (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        low = s[first] & np.uint64((1 << 64 - BUCKET_BITS) - 1)
        fraction, exponent = np.frexp(low.astype(np.float64))
        mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0)
        zeros = 64 - BUCKET_BITS - exponent.clip(0)
        out[bucket[first]] = (zeros << MANTISSA | mantissa) % 65535 + 1
    return out


@functools.cache
def rows_for(threshold: float) -> int:
    return max((r for r in range(1, 33) if (1 - threshold**r) ** (BUCKETS // r) <= MISS), default=1)


def minima(s: np.ndarray, n: int) -> np.ndarray:
    """The least value of the hashes under each of n multiplicative hash functions."""
    step = max(1, 50_000 // len(s))
    return np.concatenate([(s * _FACTORS[i : min(i + step, n), None]).min(axis=1) for i in range(0, n, step)])


def _folded(values: np.ndarray, rows: int, first: int) -> np.ndarray:
    n = BUCKETS // rows
    r = values[: n * rows].reshape(rows, n)
    h = _mix(np.arange(first, first + n, dtype=np.uint64) * _R)
    for j in range(rows):
        h = _mix(h + r[j] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j))
    return h.view(np.int64)


def register_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of the bands, each with its band's number.

    A bucket that is empty borrows, for banding only, from the next one that is not, marked with the
    distance. That makes neighbours alike, so it is for sets with hardly an empty bucket.
    """
    held = np.flatnonzero(regs)
    at = np.arange(BUCKETS)
    source = held[np.searchsorted(held, at) % len(held)]
    value = regs[source].astype(np.uint64) | ((source - at) % BUCKETS).astype(np.uint64) << np.uint64(16)
    return _folded(value, rows, 1)


def band_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Band hashes of a set: of its minima, if it or a set that it may be linked to has at most SPARSE
    shingles; of its registers, if it has more."""
    rows = rows_for(percent / 100)
    found = [np.empty(0, np.int64)]
    if len(s) and percent * len(s) <= 100 * SPARSE:
        found.append(_folded(minima(s, BUCKETS // rows * rows), rows, BUCKETS + 1))
    if len(s) > SPARSE:
        found.append(register_keys(registers(s), rows))
    return np.concatenate(found)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text, which tells rows of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("tkey"))


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, tkey, n_shingles, digest of the set, band hashes, for each row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, bands = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), k)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(s, percent).tobytes())
            cols = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tkey", "n_shingles", "digest", "bands"])

    return _keyed(docs).mapInArrow(run, "doc_id long, tkey long, n_shingles long, digest binary, bands binary")


def _bands(classes: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.frombuffer(r.as_buffer(), np.int64) for r in b.column(1)]
            if keys:
                ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(keys))], ["id", "band"])

    return classes.select("id", "bands").mapInArrow(run, "id long, band long")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(i) for i in range(len(self.up))), np.int64, len(self.up))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """On the full sets, in whole numbers: 100 * intersection >= percent * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _divergence(x: np.ndarray, t: float) -> np.ndarray:
    """Kullback-Leibler divergence of chances x under t from t; 0 for others."""
    x = x.clip(1e-12, t)
    return x * np.log(x / t) + (1 - x) * np.log((1 - x) / (1 - t)) if t < 1 else np.where(x < 1, np.inf, 0.0)


def _collision(a: int, b: np.ndarray) -> np.ndarray:
    """Chance that the registers of two different minima agree, for sets of these sizes: minima of rates a
    and b fall into one cell of width w with w times a * b / (a + b)^2, and a cell at x is x / 1.39 wide on
    average, over 2^MANTISSA."""
    return 0.7213 * 2.0**-MANTISSA * a * b / (a + b.astype(np.float64)) ** 2


class Compared:
    """Sets with their registers, to be held against each other."""

    def __init__(self, raw: pd.Series, percent: int):
        self.sets = [np.frombuffer(s, np.uint64) for s in raw]
        self.regs = np.stack([registers(s) for s in self.sets])
        self.full = self.regs > 0
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent

    def likely(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Those of rest that neither sizes nor registers rule out as linked with i."""
        # sizes alone bound the similarity
        small, big = np.minimum(self.sizes[rest], self.sizes[i]), np.maximum(self.sizes[rest], self.sizes[i])
        rest = rest[small * 100 >= self.percent * big]
        used = (self.full[rest] | self.full[i]).sum(axis=1)
        same = ((self.regs[rest] == self.regs[i]) & self.full[i]).sum(axis=1)
        chance = _collision(self.sizes[i], self.sizes[rest])
        estimate = (same / used - chance) / (1 - chance)
        return rest[used * _divergence(estimate, self.percent / 100) <= RULED_OUT]

    def linked(self, i: int, j: int) -> bool:
        return linked(self.sets[i], self.sets[j], self.percent)


def forest_links(c: Compared, f: Forest, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that the forest lacks of all pairs, or of those from side 0 to side 1."""
    out = []
    for i in range(len(c.sets)):
        if side is None:
            rest = np.arange(i + 1, len(c.sets))
        else:
            rest = np.flatnonzero(side == 1) if side[i] == 0 else np.empty(0, int)
        for j in c.likely(i, rest) if len(rest) else ():
            if f.root(i) != f.root(j) and c.linked(i, j):
                f.up[f.root(i)] = f.root(j)
                out.append((i, int(j)))
    return out


def _sets(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """id, s: the shingle sets of classes in groups, each from the row that stands for it."""
    c = classes.select(F.col("id").alias("c_id"), "rep.doc_id", "rep.tkey", F.col("digest").alias("c_digest"))
    c = groups.select("node").join(c, F.col("node") == F.col("c_id"))
    c = c.select(F.col("node").alias("id"), F.col("doc_id").alias("c_doc"), F.col("tkey").alias("c_key"), "c_digest")
    rows = _keyed(docs)
    found = rows.join(c.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(c["c_doc"]) & (rows["tkey"] == c["c_key"]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows alike in doc_id and text meet in one task
        for b in batches:
            ids, sets = [], []
            for i, t, d in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if i not in seen:
                    s = shingles(t.as_py(), k)
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d:
                        seen.add(i)
                        ids.append(i)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "s"])

    return found.select("id", "text", "c_digest").mapInArrow(run, "id long, s binary")


def _blocks() -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")


def _block_of(n: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")


def _star_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links of each group's least class, u, to others. The group is dealt out in blocks, each with
    a copy of that class."""
    n = groups.groupBy(F.col("component").alias("g")).agg(_blocks().alias("n"))
    rows = groups.join(n, F.col("component") == F.col("g"))
    head = F.col("node") == F.col("g")
    every = F.when(head, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(_block_of("n")))
    dealt = rows.select("node", "g", head.alias("head"), F.explode(every).alias("b"))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["head", "node"], ascending=[False, True]).drop_duplicates("node")
        c, ids = Compared(pdf["s"], percent), pdf["node"].to_numpy()
        found = [j for j in c.likely(0, np.arange(1, len(ids))) if c.linked(0, j)] if pdf["head"].iat[0] else []
        return pd.DataFrame({"u": np.full(len(found), ids[0]), "v": ids[found]})

    held = dealt.join(sets, F.col("node") == F.col("id")).select("node", "g", "head", "b", "s")
    return held.groupBy("g", "b").applyInPandas(check, "u long, v long")


def _other_links(groups: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): what connects the classes that their group's least class is not linked with, to each other
    and to the rest of the group. Blocks below ``n`` hold such classes, the ones above the rest."""
    known = stars.select(F.col("v").alias("s_v"))
    rows = groups.join(known, F.col("node") == F.col("s_v"), "left")
    rows = rows.select("node", F.col("component").alias("g"), "size", (F.col("s_v").isNotNull() | (F.col("node") == F.col("component"))).alias("met"))
    each = rows.groupBy("g", "met").agg(_blocks().alias("n")).groupBy(F.col("g").alias("n_g")).agg(
        F.max(F.when(~F.col("met"), F.col("n"))).alias("n"), F.max(F.when(F.col("met"), F.col("n"))).alias("n_met")
    )
    rows = rows.join(each.where("n is not null"), F.col("g") == F.col("n_g"))
    c = F.when(F.col("met"), F.col("n") + _block_of("n_met")).otherwise(_block_of("n"))
    others = F.sequence(F.lit(0), F.when(F.col("met"), F.col("n") - 1).otherwise(F.col("n") + F.col("n_met") - 1))
    dealt = rows.select("node", "g", "met", c.alias("c"), F.explode(others).alias("o"))
    dealt = dealt.select("node", "g", "met", "c", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        side = None if pdf["a"].iat[0] == pdf["b"].iat[0] else (pdf["c"] == pdf["b"]).to_numpy().astype(int)
        ids, f = pdf["node"].to_numpy(), Forest(len(pdf))
        met = np.flatnonzero(pdf["met"].to_numpy())
        for i in met[1:].tolist():  # connected through the group's least class
            f.up[i] = int(met[0])
        pairs = np.array(forest_links(Compared(pdf["s"], percent), f, side), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": ids[pairs[:, 0]], "v": ids[pairs[:, 1]]})

    held = dealt.join(sets, F.col("node") == F.col("id")).select("node", "g", "met", "c", "a", "b", "s")
    return held.groupBy("g", "a", "b").applyInPandas(check, "u long, v long")


def _placed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, tkey, n_shingles, digest and rep, the doc_id and tkey that stand for the component, for each
    row of docs; rep is null without shingles."""
    bounded_batches(docs.sparkSession)
    sig = written(signatures(docs, k, percent), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")).alias("rep")
    classes = sig.where("n_shingles > 0").groupBy("digest").agg(rep, F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    bands = _bands(classes)
    least = bands.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = bands.join(least.withColumnRenamed("band", "l_band"), F.col("band") == F.col("l_band"))
    grouped = components(stars.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    heads = grouped.select(F.col("component").alias("node"), "component").distinct()
    groups = grouped.unionByName(heads).join(classes.select("id", "size"), F.col("node") == F.col("id")).drop("id")
    groups = written(groups, "groups")
    sets = written(_sets(docs, classes, groups, k), "sets")
    met = written(_star_links(groups, sets, percent), "star-links")
    comp = components(met.unionByName(_other_links(groups, met, sets, percent)))
    of_class = classes.join(comp, F.col("id") == F.col("node"), "left")
    of_class = of_class.select(F.col("digest").alias("k_digest"), "rep", F.coalesce("component", "id").alias("c"))
    reps = of_class.groupBy(F.col("c").alias("r_c")).agg(F.min("rep").alias("rep"))
    of_class = of_class.drop("rep").join(reps, F.col("c") == F.col("r_c")).select("k_digest", "rep")
    return sig.drop("bands").join(of_class, F.col("digest") == F.col("k_digest"), "left").drop("k_digest")


def resolved(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, digest, component_id, kept for each row of docs."""
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id"))
    return _placed(docs, k, percent).select(
        "doc_id", "n_shingles", "digest", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, with all their columns; of rows alike in doc_id and text, one."""
    stays = F.col("rep").isNull() | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("tkey") == F.col("rep.tkey")))
    kept = _placed(docs, k, percent).where(stays).groupBy(F.col("doc_id").alias("k_doc"), F.col("tkey").alias("k_key")).agg(F.count("*").alias("k_n"))
    kept = written(kept, "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k_doc")) & (F.xxhash64(text_of()) == F.col("k_key"))
    rows = docs.join(kept.hint("shuffle_hash"), same, "left_semi")
    repeated = kept.where("k_n > 1").limit(1).count()
    return rows.dropDuplicates(["doc_id", "text"]) if repeated else rows
