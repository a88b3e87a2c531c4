"""Mixing sources to target weights by hash-random order and distributed prefix sums.

The plan is small: one row for each source (target, whole epochs, and the last key of the broken
epoch). Whether and how often a document is taken then follows from its own row and its source's, so
texts are never shuffled.

Keys are of doc_id and text, so rows share one only if both are alike; such rows are summed up before the
sort, and the cut may fall among them. Which of them it takes is then told by an order over the tasks
that read them, for the rows of that key alone.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a null
doc_id is keyed as the empty string; an empty table gives an empty plan. Targets are met to within half
of the document that the cut falls into, however many rows are repeated. Of rows alike in doc_id and
text but not in other columns, any may be the ones that ``mixed`` repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """Hash-random and the same on every run."""
    content = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), content, F.lit(f":{seed}")).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): weights by order of the source's name.

    With caps at most * size, resharing the excess until none is above ends at one level for all that
    are not capped: target = least(cap, level * weight). Sorted by cap / weight, the level is the first
    share of what is left that is under the next cap. One row for each source goes through the window.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(order - 1, F.lit(len(weights))) + 1)
    s = by_source.select("source", "source_size", w.alias("w"))
    s = s.select("*", (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(whole)
    s = s.select(
        "*",
        (
            (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            # the weights from here on, as the whole less what is before: whole numbers, and a frame that grows
            / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    s = s.select("*", F.first(fits, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("at"))
    return s.select(
        "source",
        "source_size",
        F.round(F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap"))), 6).alias("target"),
    )


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_n, key_n): a document is taken epochs times, and
    once more where its key is under cut_key, or is it and the document among the first cut_n of its key_n."""
    spark = docs.sparkSession
    sizes = written(docs.select("source", size_of().alias("size"), key_of(seed=seed).alias("key")), "mix-sizes")
    goal = written(targets(sizes), "mix-targets")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = sizes.groupBy("source", "key", "size").agg(F.count("*").alias("n"))
    ranged = keyed.repartitionByRange(n, "source", "key").select("*", F.spark_partition_id().alias("pid"))
    ranged = written(ranged, "mix-ranged")
    # a source's prefix sums: whole ranges first, then within the range
    words = F.col("size") * F.col("n")
    totals = ranged.groupBy("source", "pid").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("o_source"),
        F.col("pid").alias("o_pid"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    within = Window.partitionBy("source", "pid").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.select("source", "pid", "key", "size", "n", F.coalesce(F.sum(words).over(within), F.lit(0)).alias("run"))
    g = goal.withColumnRenamed("source", "g_source").withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    g = g.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # of n alike, the first k: for the last one, twice what is before it and its size are at most twice the rest
    room = 2 * F.col("rest") - 2 * (F.col("offset") + F.col("run")) + F.col("size")
    k = F.when(F.col("size") > 0, F.least(F.floor(room / (2 * F.col("size"))), F.col("n"))).when(room >= 0, F.col("n")).otherwise(0)
    cuts = (
        run.join(offsets, run["source"].eqNullSafe(offsets["o_source"]) & (run["pid"] == offsets["o_pid"]))
        .join(g.select("g_source", "rest"), F.col("source").eqNullSafe(F.col("g_source")))
        .select("source", "key", "n", k.cast("long").alias("k"))
        .where("k > 0")
        .groupBy(F.col("source").alias("c_source"))
        .agg(F.max(F.struct("key", "k", "n")).alias("cut"))
    )
    out = g.join(cuts, g["g_source"].eqNullSafe(cuts["c_source"]), "left")
    out = out.select(
        F.col("g_source").alias("p_source"),
        "source_size",
        "target",
        F.col("epochs").cast("int").alias("epochs"),
        F.col("cut.key").alias("cut_key"),
        F.col("cut.k").alias("cut_n"),
        F.col("cut.n").alias("key_n"),
    )
    return written(out, "mix-plan")


def _timed(rows: DataFrame, p: DataFrame) -> DataFrame:
    """rows, which have __source and __key, with the columns of their source's plan and __times."""
    d = rows.join(p, rows["__source"].eqNullSafe(p["p_source"]))
    more = F.col("__key") <= F.col("cut_key")
    if not p.where("cut_n < key_n").limit(1).count():
        return d.withColumn("__times", F.col("epochs") + F.when(more, 1).otherwise(0))
    # the cut falls among rows of one key: these are numbered, by task and within it
    at_cut = F.coalesce((F.col("__key") == F.col("cut_key")) & (F.col("cut_n") < F.col("key_n")), F.lit(False))
    rest = d.where(~at_cut).withColumn("__times", F.col("epochs") + F.when(more, 1).otherwise(0))
    cut = written(d.where(at_cut).withColumn("__pid", F.spark_partition_id()), "mix-cut")
    counts = cut.groupBy(F.col("__key").alias("n_key"), F.col("__source").alias("n_source"), F.col("__pid").alias("n_pid")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("n_source", "n_key").orderBy("n_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("n_key", "n_source", "n_pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    at = cut.withColumn("__at", F.row_number().over(Window.partitionBy("__source", "__key", "__pid").orderBy("__key")))
    same = (at["__key"] == before["n_key"]) & at["__source"].eqNullSafe(before["n_source"]) & (at["__pid"] == before["n_pid"])
    first = F.col("__before") + F.col("__at") <= F.col("cut_n")
    cut = at.join(before, same).withColumn("__times", F.col("epochs") + F.when(first, 1).otherwise(0))
    return rest.unionByName(cut.select(*rest.columns))


def taken(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row. The plan has a row for each source and is
    joined as Spark's size estimate of that table says."""
    d = docs.select("doc_id", docs["source"].alias("__source"), size_of().alias("size"), key_of(seed=seed).alias("__key"))
    return _timed(d, plan(docs, seed)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("__times")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs["source"].alias("__source"), key_of(seed=seed).alias("__key"))
    times = _timed(d, plan(docs, seed)).where("__times > 0")
    return times.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix-1') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS r FROM w),
t AS (SELECT source, source_size,
             round(least(cap, coalesce((SELECT arg_min(level, r) FROM l WHERE level * w <= cap) * w, cap)), 6) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p"""
