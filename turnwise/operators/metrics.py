"""Pooled metrics, rankings, concentration, comparison, strata and bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pooled(df: DataFrame, keys: list[str], errors: list[str], total: str, means: list[str] = ()) -> DataFrame:
    """Sums first, one division after: a rate with additive parts is never an average of rates.
    What has no additive parts is averaged. Groups without total are left out."""
    sums = df.groupBy(*keys).agg(
        F.sum(total).alias(total), *(F.sum(c).alias(c) for c in errors), *(F.avg(c).alias(f"{c}_mean") for c in means), F.count("*").alias("n_rows")
    )
    rate = lambda c: F.try_divide(F.col(c), F.col(total)).alias(f"{c}_rate")
    return sums.where(F.col(total) > 0).select("*", *(rate(c) for c in errors))


def shares(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({f"{c}_share": F.try_divide(F.col(c), F.sum(c).over(w)) for c in columns})


def dominant(columns: dict[str, str], guard: Column) -> Column:
    """Name of the greatest column, the first on ties; none where guard fails."""
    items = list(columns.items())
    out = F.lit(items[-1][1])
    for i in range(len(items) - 2, -1, -1):
        best = F.lit(True)
        for c, _ in items[i + 1 :]:
            best = best & (F.col(items[i][0]) >= F.col(c))
        out = F.when(best, items[i][1]).otherwise(out)
    return F.when(guard, out).otherwise("none")


def ranked(df: DataFrame, by: Column, n: int, *ties: str, columns: list[str] | None = None) -> DataFrame:
    out = df.orderBy(by, *ties).limit(n)
    return out.select(*(c for c in columns if c in df.columns)) if columns else out


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def pareto(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Rank, running sum and running share of value, the largest first."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), tie)
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"rank": F.row_number().over(w), "running": run, "running_share": F.try_divide(run, F.sum(value).over(Window.partitionBy(*keys)))})


def prefix_reaching(df: DataFrame, keys: list[str], value: str, tie: str, part: float = 0.8) -> DataFrame:
    """How many of the largest rows make up that part of the total."""
    p = pareto(df, keys, value, tie)
    return p.where(F.col("running_share") >= part).groupBy(*keys).agg(F.min("rank").alias("n_needed"), F.min("running").alias("reached"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_group(df, keys, order, 1).drop("rank")


def compared(df: DataFrame, item: str, model: str, a: str, b: str, metric: str) -> DataFrame:
    """One row for each item: the metric of a and b, the delta and the better one, n/a where one lacks."""
    wide = df.groupBy(item).pivot(model, [a, b]).agg(F.avg(metric))
    x, y = F.col(a), F.col(b)
    better = F.when(x.isNull() | y.isNull(), "n/a").when(x < y, a).when(y < x, b).otherwise("tie")
    return wide.select(item, x.alias("a"), y.alias("b"), (x - y).alias("delta"), better.alias("better"))


def head_to_head(wide: DataFrame, item: str, a: str, b: str, tol: float = 1e-9) -> DataFrame:
    d = F.col("delta")
    return wide.agg(
        F.count_if(d < -tol).alias("a_wins"), F.count_if(d > tol).alias("b_wins"), F.count_if(F.abs(d) <= tol).alias("ties"),
        F.count_if(d.isNull()).alias("not_compared"), F.avg(F.abs(d)).alias("mean_abs_delta"), F.max_by(item, F.struct(F.abs(d), item)).alias("largest_at"),
    )


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where either does not vary."""
    ok = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(ok, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _poisson_table() -> np.ndarray:
    """Poisson(1) counts by their distribution's place in 2^16."""
    p, acc, cuts = 0.36787944117144233, 0.0, []
    for k in range(8):
        acc += p
        cuts.append(acc)
        p /= k + 1
    return np.searchsorted(cuts, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float64)


def poisson_counts(row: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each row goes into each draw: a Poisson(1) count by 16 bits of a hash of row, draw and seed."""
    h = row.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    h = h + (np.arange(-(-draws // 4), dtype=np.uint64) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return _POISSON[h.view(np.uint16)[:, :draws]]


_POISSON = _poisson_table()


def bootstrap(df: DataFrame, delta: str, draws: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and percentile interval of the mean under resampling of (row, delta), without a join: a task adds
    its rows up for each draw and gives one row for each draw, whatever its input."""
    d = df.select(F.col("row").cast("long").alias("row"), F.col(delta).cast("double").alias("x")).where("row is not null and x is not null")
    step = max(1, 400_000 // draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(draws), np.zeros(draws)
        for b in batches:
            row, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(row), step):
                k = poisson_counts(row[at : at + step], draws, seed)
                total += x[at : at + step] @ k
                n += k.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(n.astype(np.int64))], ["draw", "total", "n"])

    means = d.mapInArrow(run, "draw long, total double, n long").groupBy("draw").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("m"))
    ordered = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # as many as draws
    at = lambda q: F.get("m", F.lit(int(q * draws)))
    whole = d.agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    return whole.crossJoin(ordered.select(at(low).alias("low"), at(high).alias("high")))
