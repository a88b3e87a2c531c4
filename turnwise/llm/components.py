"""Connected components of a links table, in one task where there are few links, else by alternating
large-star and small-star steps.

Up to FEW links are read by one task, which holds them as arrays. A round of stars is a plan of some twenty
stages whatever the links, and so many tasks more that the driver keeps record of; more than FEW links take
such rounds. A node with very many links is dealt over SALT tasks by a hash of the other end: least ends are taken
for each part, then for the node, and given back to the parts that it has. Rounds are logarithmic in
practice; each is written to shared storage, which cuts the lineage. Nothing is collected but a round's
row count and checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import lean, written


SALT = 16
#: Links that one task puts together, in some 60 MB beside the links.
FEW = 500_000


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m), m the least of u and all its v; and (u, m) alone."""
    salted = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int").alias("s"))
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy(F.col("u").alias("mu")).agg(F.min("m").alias("m"), F.collect_list("s").alias("ss"))
    least = least.select("mu", F.least("mu", "m").alias("m"), "ss")
    each = least.select("mu", "m", F.explode("ss").alias("ms"))
    return salted.join(each, (F.col("u") == F.col("mu")) & (F.col("s") == F.col("ms"))).select("u", "v", "m"), least.select("mu", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both)[0].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, least = _with_least(down)
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("mu").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, in order, and for each the least one of its component: a root hangs on the least
    root that a link leads to, and ways to roots are shortened, until no link leads to another root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _in_one_task(e: DataFrame) -> DataFrame:
    """(u, v) for every node u but the least of its component, v."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            nodes, least = least_nodes(*(np.concatenate(x) for x in zip(*got)))
            rest = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(least[rest])], ["u", "v"])

    return e.select("u", "v").coalesce(1).mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(u, v) but each component's least node."""
    e = written(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    before = _sum(e)
    if 0 < before[0] <= FEW:
        e = written(_in_one_task(e), "stars")
        before = (0,)
    while before[0]:
        e = written(_small_star(_large_star(e)), "stars")
        after = _sum(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
