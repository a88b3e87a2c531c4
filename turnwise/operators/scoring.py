"""All scores of segmentations against a reference in one plan, and what follows from them.

Turns are (clip_id, speaker, start, end), of systems with a column ``model`` in front. Every step is a
join or an aggregate by model and clip; only the assignment of labels is a grouped function, on one row
for each pair of labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions.align import assign
from turnwise.operators import intervals as iv
from turnwise.operators.fusion import optimal_mapping
from turnwise.storage import written

KEYS = ["model", "clip_id"]
PARTS = ("miss", "fa", "confusion", "correct", "total")


def overlap_matrix(ref: DataFrame, hyp: DataFrame, keys: list[str], width, label: str = "speaker") -> DataFrame:
    """keys, label (of hyp), target (of ref), amount: the time that both hold; disjoint within a label."""
    pairs = iv.interval_join(hyp, ref, keys, width)
    names = [F.col(f"l.{k}").alias(k) for k in keys]
    return pairs.groupBy(*names, F.col(f"l.{label}").alias("label"), F.col(f"r.{label}").alias("target")).agg(F.sum("shared").alias("amount"))


def jaccard_errors(shared: DataFrame, ref_time: DataFrame, hyp_time: DataFrame, keys: list[str]) -> DataFrame:
    """keys, jer: the mean over reference labels of 1 - shared / union under the assignment of the least
    total; a label without a partner counts 1. Lengths are (keys, speaker, amount)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, h, both = (pdf[pdf["kind"] == k] for k in ("ref", "hyp", "both"))
        if not len(r):
            return pd.DataFrame([], columns=[*keys, "jer"])
        rows = {x: i for i, x in enumerate(sorted(r["a"]))}
        cols = {x: i for i, x in enumerate(sorted(h["a"]))}
        lengths = dict(zip(r["a"], r["amount"])), dict(zip(h["a"], h["amount"]))
        error = np.ones((len(rows), max(1, len(cols))))
        for label, target, amount in zip(both["a"], both["b"], both["amount"]):
            error[rows[target], cols[label]] = 1 - amount / (lengths[0][target] + lengths[1][label] - amount)
        found = [error[i, j] if j >= 0 else 1.0 for i, j in enumerate(assign(error))]
        return pd.DataFrame([(*key, float(np.mean(found)))], columns=[*keys, "jer"])

    side = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), F.col("speaker").alias("a"), F.lit(None).cast("string").alias("b"), F.col("amount").cast("double"))
    both = shared.select(*keys, F.lit("both").alias("kind"), F.col("label").alias("a"), F.col("target").alias("b"), F.col("amount").cast("double"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shared.schema if f.name in keys)
    return side(ref_time, "ref").unionByName(side(hyp_time, "hyp")).unionByName(both).groupBy(*keys).applyInPandas(one, f"{types}, jer double")


def _time(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("amount"))


def components(ref: DataFrame, hyp: DataFrame, keys: list[str], width, region: DataFrame | None = None) -> DataFrame:
    """keys and the seconds of PARTS, under the mapping that is best within the region (disjoint within
    keys; null: everywhere). No row for keys without a turn in it."""
    if region is not None:
        ref, hyp = iv.restrict(ref, region, keys, width), iv.restrict(hyp, region, keys, width)
    mapping = optimal_mapping(overlap_matrix(ref, hyp, keys, width), keys)
    parts = iv.error_regions(ref, iv.relabel(hyp, mapping, keys), keys)
    n = F.col("until") - F.col("t")
    named = {"total": "n_ref"}
    return written(parts.groupBy(*keys).agg(*(F.sum(F.col(named.get(p, p)) * n).alias(p) for p in PARTS)), "score-parts")


def error_rate() -> Column:
    return F.try_divide(F.col("miss") + F.col("fa") + F.col("confusion"), F.col("total"))


def score_all(ref: DataFrame, hyp: DataFrame, whole: DataFrame, width, collar=0.25) -> DataFrame:
    """A row for each model and clip: components, rate, mean Jaccard error and speaker counts; ``lenient_``
    components and rate (less a collar around reference edges and what several speakers share); rates
    where two or more reference speakers speak, and where one does. A region without reference speech has
    no rate: null. ``whole`` (clip_id, start, end) is what is scored of each clip."""
    models = hyp.select("model", "clip_id").distinct()
    spans = models.join(whole.select("clip_id", "start", "end"), "clip_id").select(*KEYS, "start", "end")
    ref = models.join(ref.select("clip_id", "speaker", "start", "end"), "clip_id").select(*KEYS, "speaker", "start", "end")
    one_label = [*KEYS, "speaker"]
    # each part reads these several times: written, the plan does not repeat what made them
    r, h = (written(iv.union_intervals(iv.restrict(df.select(*KEYS, "speaker", "start", "end"), spans, KEYS, width), one_label).drop("n_merged"), "score-turns") for df in (ref, hyp))
    out = models.join(components(r, h, KEYS, width), KEYS, "left").na.fill(0, list(PARTS)).withColumn("der", error_rate())
    jer = jaccard_errors(overlap_matrix(r, h, KEYS, width), _time(r, KEYS), _time(h, KEYS), KEYS)
    count = lambda df, name: df.groupBy(*KEYS).agg(F.countDistinct("speaker").alias(name))
    out = out.join(jer, KEYS, "left").join(count(r, "n_ref"), KEYS, "left").join(count(h, "n_hyp"), KEYS, "left").na.fill(0, ["n_ref", "n_hyp"])
    out = out.withColumns({"count_error": F.col("n_hyp") - F.col("n_ref"), "count_correct": (F.col("n_hyp") == F.col("n_ref")).cast("int")})
    lenient = components(r, h, KEYS, width, iv.scored_region(r, spans, KEYS, "speaker", collar, True)).withColumn("der", error_rate())
    out = out.join(lenient.withColumnsRenamed({c: f"lenient_{c}" for c in (*PARTS, "der")}), KEYS, "left")
    for name, low, high in (("overlap", 2, None), ("single", 1, 1)):
        part = components(r, h, KEYS, width, iv.timeline(r, KEYS, "speaker", low, high)).where("total > 0")
        out = out.join(part.select(*KEYS, error_rate().alias(f"{name}_der"), F.col("total").alias(f"{name}_total")), KEYS, "left")
    return out


def pooled_scores(scores: DataFrame) -> DataFrame:
    """By model: rates of summed seconds; Jaccard errors and counts, which do not add up, as means."""
    s = scores.groupBy("model").agg(
        F.count("*").alias("n_clips"), *(F.sum(p).alias(p) for p in PARTS), F.avg("jer").alias("jer_mean"),
        F.avg("count_correct").alias("count_accuracy"), F.avg(F.abs("count_error")).alias("count_mae"), F.avg("count_error").alias("count_bias"),
    )
    return s.where("total > 0").withColumns({"der": error_rate(), **{f"{p}_share": F.col(p) / F.col("total") for p in ("miss", "fa", "confusion")}})


def disagreements(regions: DataFrame, scores: DataFrame, keys: list[str], tol: float = 1e-6) -> DataFrame:
    """keys, part, integral, told of scores that the integral of their regions (t, until and counts) does
    not bear out; none if all is well."""
    n = F.col("until") - F.col("t")
    own = regions.groupBy(*keys).agg(*(F.sum(F.col(p) * n).alias(p) for p in PARTS[:4]))
    long = lambda df, name: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("v")) for p in PARTS[:4]))).alias("x")).select(*keys, "x.part", F.col("x.v").alias(name))
    both = long(own, "integral").join(long(scores, "told"), [*keys, "part"], "full").na.fill(0.0, ["integral", "told"])
    return both.where(F.abs(F.col("integral") - F.col("told")) > tol)


def residual(regions: DataFrame, roles: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """keys and counts of regions less those of the roles found in them, not under 0."""
    told = roles.groupBy(*keys).agg(*(F.sum(c).alias(f"__{c}") for c in counts))
    both = regions.join(told, keys, "left")
    return both.select(*keys, *(F.greatest(F.col(c) - F.coalesce(f"__{c}", F.lit(0)), F.lit(0)).alias(c) for c in counts))


#: ranking, which is a column, and the rows that it is for
RANKINGS = {
    "der": None, "jer": None, "confusion": None, "miss": None, "fa": None,
    "overlap_der": "overlap_total > 0", "abs_count_error": None, "error_share": None,
}


def enriched(scores: DataFrame) -> DataFrame:
    """Scores with the error's seconds, its share of the model's, the size of the count error, and which part
    is the largest (miss, confusion, fa in this order on ties; none without an error)."""
    error = F.col("miss") + F.col("fa") + F.col("confusion")
    total = scores.groupBy("model").agg(F.sum(error).alias("__all"))
    out = scores.join(total, "model").withColumn("error", error)
    most = F.greatest("miss", "confusion", "fa")
    part = F.when(most <= 0, "none").when(F.col("miss") == most, "miss").when(F.col("confusion") == most, "confusion").otherwise("fa")
    return out.withColumns({"error_share": F.try_divide("error", "__all"), "abs_count_error": F.abs("count_error"), "dominant": part}).drop("__all")


def worst(scores: DataFrame, n: int = 20) -> DataFrame:
    """ranking, rank, model, clip_id, value: the n worst rows by each of RANKINGS; absent values come last. One
    pass over the scores; each task passes on its n worst of a ranking only."""
    e = enriched(scores)
    entry = lambda name, only: F.when(F.expr(only or "true"), F.struct(F.lit(name).alias("ranking"), F.col(name).cast("double").alias("value")))
    rows = e.select(*KEYS, F.explode(F.array(*(entry(k, v) for k, v in RANKINGS.items()))).alias("x")).where("x is not null")
    rank = F.row_number().over(Window.partitionBy("ranking").orderBy(F.col("value").desc_nulls_last(), *KEYS))
    return rows.select("x.ranking", "x.value", *KEYS).withColumn("rank", rank).where(F.col("rank") <= n).select("ranking", "rank", *KEYS, "value")


def composition(scores: DataFrame) -> DataFrame:
    """By model: the rate, what the error consists of in percent, mean rates where speakers overlap and
    where one speaks, and how many clips each part dominates."""
    e = enriched(scores)
    parts = ("miss", "fa", "confusion")
    return e.groupBy("model").agg(
        F.try_divide(F.sum("error"), F.sum("total")).alias("der"),
        *(F.try_divide(100 * F.sum(p), F.sum("error")).alias(f"{p}_percent") for p in parts),
        F.avg(F.when(F.col("overlap_total") > 0, F.col("overlap_der"))).alias("overlap_der"), F.avg("single_der").alias("single_der"),
        *(F.count_if(F.col("dominant") == p).alias(f"clips_{p}") for p in parts),
    )


def oracle_gap(pooled: DataFrame, oracle: DataFrame, value: str = "der") -> DataFrame:
    """model, the rate, the rate of the run that was told the truth, and what not knowing it costs."""
    o = oracle.select("model", F.col(value).alias(f"{value}_oracle"))
    return pooled.select("model", value).join(o, "model").withColumn("cost", F.col(value) - F.col(f"{value}_oracle"))


def precision(audited: DataFrame, verdict: str, right: str, keys: list[str]) -> DataFrame:
    """By keys: rows with a verdict, the right ones, and their share."""
    told = F.trim(F.coalesce(F.col(verdict), F.lit(""))) != ""
    out = audited.groupBy(*keys).agg(F.count_if(told).alias("audited"), F.count_if(told & (F.col(verdict) == right)).alias("right"))
    return out.withColumn("precision", F.try_divide("right", "audited"))
