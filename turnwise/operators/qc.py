"""Checks of a reference against systems: lags, run summaries, samples, shared words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions.align import shared_runs
from turnwise.operators.fusion import HOP, lag_profile

#: Fixed values of the flags.
LAG, HEADROOM, GAIN, MARGIN, APART = 1.0, 0.35, 0.01, 0.02, 0.5
LAGS = "clip_id string, peak_lag double, peak_iou double, zero_iou double, margin double"


def lags(ref: DataFrame, hyp: DataFrame, durations: DataFrame, reach: int = 500) -> DataFrame:
    """For each clip the lag at which the reference fits best, how well it fits there and at none, and how
    much better than at lags further off."""

    def one(key, r: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(h):
            return pd.DataFrame([], columns=[c.split()[0] for c in LAGS.split(", ")])
        n = max(1, int(float(r["duration"].iat[0]) / HOP))
        p = lag_profile(list(zip(r["start"], r["end"])), list(zip(h["start"], h["end"])), n, reach)
        k = int(p.argmax())
        far = np.abs(np.arange(len(p)) - k) * HOP > APART
        return pd.DataFrame([(key[0], (k - reach) * HOP, p[k], p[reach], p[k] - (p[far].max() if far.any() else 0.0))], columns=[c.split()[0] for c in LAGS.split(", ")])

    # new attributes, so that both sides may come from one table
    anew = lambda df, *cs: df.select(*(F.col(c).alias(c) for c in cs))
    timed = anew(ref.join(durations, "clip_id"), "clip_id", "start", "end", "duration")
    return timed.groupBy("clip_id").cogroup(anew(hyp, "clip_id", "start", "end").groupBy("clip_id")).applyInPandas(one, LAGS)


def assessed(profile: DataFrame) -> DataFrame:
    """headroom and flagged: a clear lag that closes enough of what is missing."""
    room = F.try_divide(F.col("peak_iou") - F.col("zero_iou"), 1 - F.col("zero_iou"))
    out = profile.withColumn("headroom", F.coalesce(room, F.lit(0.0)))
    gain = F.col("peak_iou") - F.col("zero_iou")
    flagged = (F.abs("peak_lag") >= LAG) & (F.col("headroom") >= HEADROOM) & (gain >= GAIN) & (F.col("margin") >= MARGIN)
    reason = F.when(F.abs("peak_lag") < LAG, "small lag").when(F.col("headroom") < HEADROOM, "little headroom").when(gain < GAIN, "no gain").when(F.col("margin") < MARGIN, "not clear").otherwise("shifted")
    return out.withColumns({"flagged": flagged, "reason": reason}).orderBy(F.col("flagged").desc(), F.abs("peak_lag").desc(), gain.desc(), "clip_id")


def summary(df: DataFrame, keys: list[str], seconds: str, length: str, ok: Column, corpus: float) -> DataFrame:
    """Runs, failures, speed as time over length, and the time that a corpus of that length would take."""
    rate = F.try_divide(F.col(seconds), F.col(length))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.bool_and(ok).alias("all_ok"), F.max(F.abs(seconds)).alias("most"),
        F.avg(rate).alias("rate_mean"), F.min(rate).alias("rate_min"), F.max(rate).alias("rate_max"), (F.avg(rate) * F.lit(corpus)).alias("projected"),
    )


def stratified(df: DataFrame, strata: list[str], by: str, tie: str, at: list[float]) -> DataFrame:
    """From each stratum the rows at these percentiles of ``by``."""
    w = Window.partitionBy(*strata).orderBy(by, tie)
    n = F.count("*").over(Window.partitionBy(*strata))
    ranked = df.select("*", (F.row_number().over(w) - 1).alias("__r"), n.alias("__n"))
    wanted = F.array_distinct(F.array(*(F.floor(F.lit(q) * (F.col("__n") - 1)) for q in at)))
    return ranked.where(F.array_contains(wanted, F.col("__r").cast("bigint"))).drop("__r", "__n")


def duplicate_positions(pairs: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, idx, positions: places of words that overlapping segments l and r share in runs."""

    @F.pandas_udf("a array<int>, b array<int>")
    def runs(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for u, v in zip(x, y):
            found = shared_runs(list(u), list(v), least)
            out.append(([i + k for i, _, n in found for k in range(n)], [j + k for _, j, n in found for k in range(n)]))
        return pd.DataFrame(out, columns=["a", "b"])

    p = pairs.select(*(F.col(f"l.{k}").alias(k) for k in keys), F.col("l.idx").alias("i"), F.col("r.idx").alias("j"), runs("l.tokens", "r.tokens").alias("x"))
    both = p.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("idx"), F.col("x.a").alias("at")), F.struct(F.col("j").alias("idx"), F.col("x.b").alias("at")))).alias("y"))
    return both.groupBy(*keys, "y.idx").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("y.at")))).alias("positions")).where(F.size("positions") > 0)


def over_models(profiles: DataFrame, apart: float = APART) -> DataFrame:
    """profiles (model, clip_id, peak_lag, peak_iou, zero_iou, margin) by clip: the mean profile, how far the
    models' lags lie apart, and whether they agree."""
    means = (F.avg(c).alias(c) for c in ("peak_lag", "peak_iou", "zero_iou", "margin"))
    out = profiles.groupBy("clip_id").agg(*means, (F.max("peak_lag") - F.min("peak_lag")).alias("spread"), F.count("*").alias("n_models"))
    return out.withColumn("agreed", F.col("spread") <= apart)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in an order that depends on the seed and the key only."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def widened(picked: list[dict], rest: list[dict], n: int, by: str) -> list[dict]:
    """picked and rows of rest up to n, each the one that lies farthest from all picked; ties go by order."""
    out, left = list(picked), list(rest)
    while len(out) < n and left:
        far = [min((abs(x[by] - y[by]) for y in out), default=0) for x in left]
        out.append(left.pop(far.index(max(far))))
    return out


def within_budget(picked: list[dict], pool: list[dict], key: str, group: str, size: str, budget: float) -> list[dict]:
    """picked under the budget: the largest goes, and its group's smallest row that is not picked comes for
    it, until they fit or one is left. A row that came and is the largest may go again, so a swap that
    gains nothing ends it."""
    out = sorted(picked, key=lambda x: (-x[size], x[key]))
    while sum(x[size] for x in out) > budget and len(out) > 1:
        gone, out = out[0], out[1:]
        held = {x[key] for x in out}
        free = [x for x in pool if x[group] == gone[group] and x[key] not in held and x[size] < gone[size]]
        if free:
            out = sorted([*out, min(free, key=lambda x: (x[size], x[key]))], key=lambda x: (-x[size], x[key]))
    return sorted(out, key=lambda x: x[key])


def pilot(df: DataFrame, group: str, by: str, spread: str, size: str, n: int, budget: float, at: tuple[float, ...] = (0.9, 0.5, 0.1), seed: int = 0, key: str = "clip_id") -> list[dict]:
    """A small sample: of each group one row, at percentiles of ``by`` in turn, widened over ``spread`` in a
    seeded order up to n, within a budget of ``size``. The candidates are a list of clips on the driver."""
    turn = F.dense_rank().over(Window.orderBy(group)) - 1
    groups = df.select(group).distinct().select(F.col(group).alias("__g"), F.element_at(F.array(*map(F.lit, at)), (turn % len(at) + 1).cast("int")).alias("__q"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(by, key)) - 1
    ranked = df.withColumns({"__r": rank, "__n": F.count("*").over(Window.partitionBy(group))}).join(groups, F.col(group) == F.col("__g"))
    wanted = F.floor(F.col("__q") * (F.col("__n") - 1))
    marked = shuffled(ranked.withColumn("__first", F.col("__r") == wanted).drop("__r", "__n", "__g", "__q"), key, seed)
    rows = [r.asDict() for r in marked.collect()]
    first = sorted((r for r in rows if r["__first"]), key=lambda r: r[group])
    out = widened(first, [r for r in rows if not r["__first"]], n, spread)
    return [{k: v for k, v in r.items() if k != "__first"} for r in within_budget(out, rows, key, group, size, budget)]
