"""Near-duplicate embeddings by a subspace pigeonhole join.

Two unit vectors of cosine c lie at squared distance 2 - 2c. A rotation (fixed, orthogonal) keeps
distances; cut into blocks of dimensions, the squared distances of the blocks add up, so a pair within
the threshold's distance is, in one block at least, within that block's share of it, in proportion to
its dimensions. Each block is a range join: slabs along its first coordinate, as wide as the block's
radius, each vector at home in its own slab and a visitor in the next. Full slabs are dealt out as pairs
of chunks of about CHUNK vectors. The union of candidates is checked in double precision on the vectors
as given; a pair counts in the first block that finds it, so no pair list is stored or made distinct.
Tasks give out counts of links and the links of a spanning forest.

Vectors alike in every bit form a class and are compared once. Vectors that are null, empty, zero, or
hold null or non-finite components, null labels, and vectors of different lengths link with nothing.
Repeated vec_ids are told apart by their labels and vectors; null vec_ids take part and link others, and a
component of them alone has a null id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, written
from turnwise.llm.components import components
from turnwise.llm.near_dedup import Forest

BLOCKS = 4
CHUNK = 2000
SEED = 7


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]


def cuts(dim: int) -> list[np.ndarray]:
    return [x for x in np.array_split(np.arange(dim), BLOCKS) if len(x)]


def budgets(dim: int, cosine: float) -> list[float]:
    """Squared distance that each block may have, with room for rounding."""
    return [(2 - 2 * cosine) * len(x) / dim * (1 + 1e-6) + 1e-9 for x in cuts(dim)]


def rotated(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation(v.shape[1])


def _classed(vectors: DataFrame, cosine: float) -> DataFrame:
    """vec_id, label, and for usable vectors digest, bytes of doubles, and a slab for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest: list = [None] * b.num_rows
            raw: list = [None] * b.num_rows
            slabs: list = [None] * b.num_rows
            by_dim: dict[int, list[int]] = {}
            for i, (x, label) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist())):
                if x and label is not None and None not in x:
                    v = np.array(x, np.float64) + 0.0
                    with np.errstate(over="ignore", under="ignore"):
                        norm = np.linalg.norm(v)
                    if np.isfinite(norm) and norm > 0:
                        raw[i] = v.tobytes()
                        digest[i] = hashlib.blake2b(raw[i], digest_size=16).digest()
                        by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                r = rotated(np.stack([np.frombuffer(raw[i]) for i in rows]))
                first = [x[0] for x in cuts(dim)]
                found = np.floor(r[:, first] / np.sqrt(budgets(dim, cosine))).astype(int).tolist()
                for i, s in zip(rows, found):
                    slabs[i] = s
            cols = [pa.array(digest, pa.binary()), pa.array(raw, pa.binary()), pa.array(slabs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["vec_id", "label", "digest", "v", "slabs"])

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    return rows.mapInArrow(run, "vec_id long, label long, digest binary, v binary, slabs array<int>")


def pair_links(a: np.ndarray, b: np.ndarray, block: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked rows of a and b that this block is the first to find; i < j if same."""
    dim = a.shape[1]
    part, most = cuts(dim), budgets(dim, cosine)
    ra, rb = rotated(a), rotated(b)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    xa, xb = ra[:, part[block]], rb[:, part[block]]
    left, right = [], []
    step = max(1, 500_000 // max(1, len(b)))
    for lo in range(0, len(a), step):
        y = xa[lo : lo + step]
        near = (y**2).sum(1)[:, None] + (xb**2).sum(1) - 2 * y @ xb.T <= most[block] + 1e-9
        i, j = np.nonzero(near)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            gap = (ra[p] - rb[q]) ** 2  # the same for either order, in whichever task
            within = np.stack([gap[:, x].sum(1) <= m for x, m in zip(part, most)])
            ok = within[block] & (within.argmax(0) == block)
            p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= cosine
            left.append(p[ok])
            right.append(q[ok])
    none = np.empty(0, int)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _dealt(classes: DataFrame) -> DataFrame:
    """Rows for each (label, dim, block, slab, h, g): vectors at home in chunk h, compared with chunk g
    of the slab (g > h, or themselves) or with visitors in chunk g."""
    key = ["label", "dim", "block", "slab"]
    home = classes.select("id", "n", "label", F.octet_length("v").alias("dim"), "v", F.posexplode("slabs").alias("block", "slab"))
    sizes = home.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k"))
    visits = home.withColumn("slab", F.col("slab") + 1).withColumn("visitor", F.lit(True))
    rows = home.withColumn("visitor", F.lit(False)).unionByName(visits)
    rows = rows.join(sizes.withColumnsRenamed({c: f"s_{c}" for c in key}), [F.col(c) == F.col(f"s_{c}") for c in key])
    rows = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    # (h, g) for home with home: both chunks in order; for visitors: g = -1 - chunk
    own = F.transform(every, lambda o: F.struct(F.least("c", o).alias("h"), F.greatest("c", o).alias("g")))
    guests = F.transform(every, lambda o: F.struct(o.alias("h"), (-1 - F.col("c")).alias("g")))
    hosts = F.transform(every, lambda o: F.struct(F.col("c").alias("h"), (-1 - o).alias("g")))
    work = F.explode(F.when(F.col("visitor"), guests).otherwise(F.concat(own, hosts))).alias("w")
    return rows.select(*key, "id", "n", "v", "visitor", "c", work).select(*key, "id", "n", "v", "visitor", "c", "w.h", "w.g")


def links(classes: DataFrame, cosine: float) -> DataFrame:
    """id, n (vectors linked, copies of others included), and u, v where the row is a forest's link."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        block, h, g = (int(pdf[c].iat[0]) for c in ("block", "h", "g"))
        pdf = pdf.sort_values("id")
        second = pdf["visitor"] if g < 0 else pdf["c"] == g
        one, two = (pdf, pdf) if h == g else (pdf[~second], pdf[second])
        if not len(one) or not len(two):
            return pd.DataFrame({"id": [], "n": [], "u": [], "v": []})
        a, b = (np.stack([np.frombuffer(x) for x in p["v"]]) for p in (one, two))
        i, j = pair_links(a, b, block, cosine, h == g)
        ia, ib = one["id"].to_numpy(), two["id"].to_numpy()
        na, nb = one["n"].to_numpy(), two["n"].to_numpy()
        counts = pd.concat(
            [pd.Series(np.bincount(i, nb[j], len(a)), ia), pd.Series(np.bincount(j, na[i], len(b)), ib)]
        )
        counts = counts[counts > 0].astype("int64")
        place = {x: k for k, x in enumerate(dict.fromkeys([*ia[i], *ib[j]]))}
        f, u, v = Forest(len(place)), [], []
        for x, y in zip(ia[i].tolist(), ib[j].tolist()):
            p, q = f.root(place[x]), f.root(place[y])
            if p != q:
                f.up[p] = q
                u.append(x)
                v.append(y)
        out = pd.DataFrame({"id": counts.index, "n": counts.to_numpy()})
        return pd.concat([out, pd.DataFrame({"u": u, "v": v})]).astype("Int64")[["id", "n", "u", "v"]]

    return _dealt(classes).groupBy("label", "dim", "block", "slab", "h", "g").applyInPandas(check, "id long, n long, u long, v long")


def resolved(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    bounded_batches(vectors.sparkSession)
    rows = written(_classed(vectors, cosine), "vectors")
    same = ["label", "digest"]
    classes = rows.where("digest is not null").groupBy(*same).agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("slabs").alias("slabs")
    )
    # ids of their own, given as the table is written: vec_ids may be null or repeated
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "vector-classes")
    found = written(links(classes, cosine), "vector-links")
    counts = found.where("id is not null").groupBy(F.col("id").alias("l_id")).agg(F.sum("n").alias("links"))
    comp = components(found.where("u is not null").select("u", "v"))
    of_class = classes.join(counts, F.col("id") == F.col("l_id"), "left").join(comp, F.col("id") == F.col("node"), "left")
    of_class = of_class.select(
        F.col("label").alias("c_label"),
        F.col("digest").alias("c_digest"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("c"),
        "least",
    )
    leasts = of_class.groupBy(F.col("c").alias("r_c")).agg(F.min("least").alias("component"))
    of_class = of_class.drop("least").join(leasts, F.col("c") == F.col("r_c"))
    out = rows.select("vec_id", *same).join(
        of_class, (F.col("label") == F.col("c_label")) & (F.col("digest") == F.col("c_digest")), "left"
    )
    component = F.when(F.col("c_digest").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
