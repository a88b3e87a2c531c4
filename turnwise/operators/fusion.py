"""Vote fusion of competing segmentations, label maps, and scores against a reference.

Mapping labels is a small assignment for each clip and runs as a grouped function on a clip's turns.
Frames are kept as intervals of frame numbers and swept, so the work follows the turns, not the hours.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.align import align, assign, cp_counts, edit_counts, speaker_errors

HOP, MIN_DUR = 0.01, 0.20


def frames(start: float, end: float, n: int, hop: float = HOP) -> tuple[int, int]:
    return int(max(0.0, start) / hop), int(min(n * hop, end) / hop)


def _unions(turns: list[tuple[str, float, float]], n: int) -> dict[str, list[tuple[int, int]]]:
    """Frame intervals of each label, disjoint and in order."""
    by: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for label, s, e in turns:
        lo, hi = frames(s, e, n)
        if hi > lo:
            by[label].append((lo, hi))
    out = {}
    for label, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for lo, hi in spans[1:]:
            if lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out[label] = [tuple(x) for x in merged]
    return out


class Votes:
    """Votes of the labels on the cuts between all turns' edges."""

    def __init__(self, cuts: np.ndarray):
        self.cuts, self.length = cuts, np.diff(cuts)
        self.labels: list[str] = []
        self.rows: list[np.ndarray] = []

    def track(self, spans: list[tuple[int, int]]) -> np.ndarray:
        t = np.zeros(len(self.length))
        for lo, hi in spans:
            t[np.searchsorted(self.cuts, lo) : np.searchsorted(self.cuts, hi)] = 1
        return t


def rank_weights(systems: list[list[tuple[str, float, float]]], duration: float) -> list[float]:
    """One over a system's rank by agreement: the frames, counted by speaker, that it shares with each other
    system. Ties keep the order given."""
    n = max(1, int(duration / HOP))
    tracks = [_unions(t, n) for t in systems]
    cuts = np.unique([x for t in tracks for spans in t.values() for span in spans for x in span] or [0, 0])
    v = Votes(cuts)
    busy = [sum((v.track(spans) for spans in t.values()), np.zeros(len(v.length))) for t in tracks]
    agree = [sum(float((np.minimum(a, b) * v.length).sum()) for j, b in enumerate(busy) if j != i) for i, a in enumerate(busy)]
    out = [0.0] * len(systems)
    for rank, i in enumerate(sorted(range(len(systems)), key=lambda i: -agree[i])):
        out[i] = 1.0 / (rank + 1)
    return out


def fuse(
    systems: list[list[tuple[str, float, float]]], weights: list[float] | None, duration: float, threshold: float = 0.5,
    min_dur: float = MIN_DUR, overlap_threshold: float | None = None, rank_weighted: bool = False,
) -> list[tuple[str, float, float]]:
    """Turns that systems agree on, in order of start and speaker.

    Without weights all weigh 1, or by rank of agreement. An overlap threshold under the other lets further
    speakers in where one has reached the threshold.

    Systems without turns do not count, one alone passes through. The heaviest comes first, then the
    order given and keeps its labels. Each next one's labels are assigned to those so far by the largest overlap with what
    has been voted, and names spk{n} made for the rest; a label holds where its votes reach the share."""
    if weights is None:
        weights = [1.0] * len(systems)
        if rank_weighted:
            held = [t for t in systems if t]
            by_rank = iter(rank_weights(held, duration))
            weights = [next(by_rank) if t else 0.0 for t in systems]
    pairs = [(t, w) for t, w in zip(systems, weights) if t]
    if not pairs:
        return []
    if len(pairs) == 1:
        return sorted(pairs[0][0], key=lambda x: (x[1], x[0]))
    n = max(1, int(duration / HOP))
    pairs.sort(key=lambda x: -x[1])
    tracks = [_unions(t, n) for t, _ in pairs]
    cuts = np.unique([x for t in tracks for spans in t.values() for span in spans for x in span] or [0, 0])
    v = Votes(cuts)
    for k, ((turns, w), spans) in enumerate(zip(pairs, tracks)):
        own = sorted(spans)
        mapped: dict[str, int] = {}
        if v.labels and own:
            cells = np.array([[float((v.track(spans[x]) * row * v.length).sum()) for row in v.rows] for x in own])
            for i, j in enumerate(assign(-cells)):
                if j >= 0 and cells[i, j] > 0:
                    mapped[own[i]] = int(j)
        for x in own:
            if x not in mapped:
                mapped[x] = len(v.labels)
                v.labels.append(f"spk{len(v.labels)}" if k else x)
                v.rows.append(np.zeros(len(v.length)))
            v.rows[mapped[x]] += w * v.track(spans[x])
    total = sum(w for _, w in pairs)
    votes = np.array(v.rows).reshape(len(v.labels), -1)
    active = votes >= threshold * total - 1e-9
    if overlap_threshold is not None and overlap_threshold < threshold:
        active |= (votes >= overlap_threshold * total - 1e-9) & active.any(axis=0)
    out = []
    for label, row in zip(v.labels, active):
        on = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
        for a, b in zip(on[::2], on[1::2]):
            lo, hi = int(cuts[a]), int(cuts[b])
            if (hi - lo) * HOP >= min_dur:
                out.append((label, lo * HOP, hi * HOP))
    return sorted(out, key=lambda x: (x[1], x[0]))


def fused(
    turns: DataFrame, systems: list[str], durations: DataFrame, weights: list[float] | None = None, threshold: float = 0.5,
    min_dur: float = MIN_DUR, overlap_threshold: float | None = None, rank_weighted: bool = False,
) -> DataFrame:
    """clip_id, system = fusion, turn_idx, speaker, start, end from turns of the named systems."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn_idx")
        of = [list(zip(p["speaker"], p["start"], p["end"])) for p in (pdf[pdf["system"] == s] for s in systems)]
        out = fuse(of, weights, float(pdf["duration"].iat[0]), threshold, min_dur, overlap_threshold, rank_weighted)
        rows = [(pdf["clip_id"].iat[0], "fusion", i, *t) for i, t in enumerate(out)]
        return pd.DataFrame(rows, columns=["clip_id", "system", "turn_idx", "speaker", "start", "end"])

    rows = turns.where(F.col("system").isin(systems)).join(durations, "clip_id")
    return rows.groupBy("clip_id").applyInPandas(one, "clip_id string, system string, turn_idx long, speaker string, start double, end double")


def materialized(turns: DataFrame, systems: list[str], durations: DataFrame, path: str, threshold: float = 0.5, **options) -> DataFrame:
    """The fusion as a system of its own under ``path``, with a sidecar row for each clip; clips that have one
    under the same settings are not fused again. Returns the sidecars."""
    spark = turns.sparkSession
    settings = f"{'+'.join(systems)}|{threshold}|{sorted(options.items())}"
    schema = "clip_id string, status string, n_turns long, n_speakers long, settings string"
    try:
        done = spark.read.schema(schema).json(f"{path}/sidecars")
    except Exception as e:  # only an absent folder means that nothing is done
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], schema)
    todo = durations.join(done.where((F.col("settings") == settings) & (F.col("status") == "ok")).select("clip_id"), "clip_id", "left_anti")
    out = fused(turns.join(todo.select("clip_id"), "clip_id", "left_semi"), systems, todo, threshold=threshold, **options)
    stamp = F.sha1(F.lit(settings).cast("binary"))
    out.withColumn("settings", stamp).write.mode("append").parquet(f"{path}/turns")
    made = spark.read.parquet(f"{path}/turns").where(F.col("settings") == stamp).groupBy("clip_id").agg(F.count("*").alias("n_turns"), F.countDistinct("speaker").alias("n_speakers"))
    side = todo.select("clip_id").join(made, "clip_id", "left").na.fill(0, ["n_turns", "n_speakers"])
    side = side.select("clip_id", F.lit("ok").alias("status"), "n_turns", "n_speakers", F.lit(settings).alias("settings"))
    side.write.mode("append").json(f"{path}/sidecars")
    return spark.read.schema(schema).json(f"{path}/sidecars").where(F.col("settings") == settings)


def optimal_mapping(shared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, target from (label, target, amount) rows: the assignment of the largest total."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="label", columns="target", values="amount", aggfunc="sum", fill_value=0).sort_index()
        cols = assign(-wide.to_numpy(float))
        rows = [(*pdf[keys].iloc[0], wide.index[i], wide.columns[j]) for i, j in enumerate(cols) if j >= 0 and wide.iat[i, j] > 0]
        return pd.DataFrame(rows, columns=[*keys, "label", "target"])

    types = {f.name: f.dataType.simpleString() for f in shared.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "label", "target"])
    return shared.groupBy(*keys).applyInPandas(one, schema)


def jaccard_error(ref: dict[str, list[tuple[float, float]]], hyp: dict[str, list[tuple[float, float]]]) -> float | None:
    """Mean over reference speakers of (false alarm + miss) / union under the best mapping; spans disjoint."""
    if not ref:
        return None
    r, h = sorted(ref), sorted(hyp)
    length = lambda spans: sum(e - s for s, e in spans)
    both = lambda a, b: sum(max(0.0, min(x[1], y[1]) - max(x[0], y[0])) for x in a for y in b)
    error = np.ones((len(r), max(len(h), 1)))
    for i, x in enumerate(r):
        for j, y in enumerate(h):
            shared = both(ref[x], hyp[y])
            error[i, j] = 1 - shared / (length(ref[x]) + length(hyp[y]) - shared)
    cols = assign(error)
    return float(np.mean([error[i, j] if j >= 0 else 1.0 for i, j in enumerate(cols)]))


SCORES = "hits long, substitutions long, deletions long, insertions long, cp_errors long, ref_words long, wrong_speaker long, attributed long"


def transcript_scores(stream: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, side ref|hyp, word_idx, token, speaker): counts that pool by addition. WER is
    (substitutions + deletions + insertions) / ref_words, cpWER cp_errors / ref_words, and WDER
    wrong_speaker / attributed, under one mapping of speakers."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        side = {s: list(zip(p["token"], p["speaker"])) for s, p in ((s, pdf[pdf["side"] == s]) for s in ("ref", "hyp"))}
        by: dict[str, dict[str, list[str]]] = {s: defaultdict(list) for s in side}
        for s, words in side.items():
            for w, p in words:
                by[s][p].append(w)
        h, s, d, i = edit_counts([w for w, _ in side["ref"]], [w for w, _ in side["hyp"]])
        cp, mapping = cp_counts(by["ref"], by["hyp"])
        wrong, total = speaker_errors(side["ref"], side["hyp"], mapping)
        return pd.DataFrame([(*pdf[keys].iloc[0], h, s, d, i, sum(cp[1:]), len(side["ref"]), wrong, total)], columns=[*keys, *(c.split()[0] for c in SCORES.split(", "))])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema if f.name in keys)
    return stream.groupBy(*keys).applyInPandas(one, f"{types}, {SCORES}")


def aligned(stream: DataFrame, keys: list[str]) -> DataFrame:
    """keys, op, i, j: the alignment of the ref and hyp sides of (keys, side, word_idx, token), places from 0."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        ref, hyp = (pdf.loc[pdf["side"] == s, "token"].tolist() for s in ("ref", "hyp"))
        out = pd.DataFrame(align(ref, hyp), columns=["op", "i", "j"]).astype({"i": "Int64", "j": "Int64"})
        for k in keys[::-1]:
            out.insert(0, k, pdf[k].iat[0])
        return out

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema if f.name in keys)
    return stream.groupBy(*keys).applyInPandas(one, f"{types}, op string, i long, j long")


def ops_by_region(ops: DataFrame, regions: DataFrame, keys: list[str], region: str) -> DataFrame:
    """Counts of each operation by the region of its reference word, and the error rate in each."""
    at = ops.where("i is not null").join(regions.withColumnRenamed("word_idx", "i"), [*keys, "i"])
    wide = at.groupBy(region).pivot("op", ["C", "S", "D"]).agg(F.count("i")).na.fill(0)
    return wide.withColumn("error_rate", F.try_divide(F.col("S") + F.col("D"), F.col("C") + F.col("S") + F.col("D")))


def lag_profile(ref: list[tuple[float, float]], hyp: list[tuple[float, float]], n: int, reach: int = 500) -> np.ndarray:
    """Overlap over union of two activity tracks of n frames at each lag from -reach to reach; a positive
    lag moves the reference earlier. Lags of n frames and more stay 0."""
    a, b = np.zeros(n), np.zeros(n)
    for track, spans in ((a, ref), (b, hyp)):
        for s, e in spans:
            lo, hi = frames(s, e, n)
            if hi > lo:
                track[lo:hi] = 1
    size = 1 << (2 * n - 1).bit_length()
    shared = np.rint(np.fft.irfft(np.conj(np.fft.rfft(b, size)) * np.fft.rfft(a, size), size))
    sum_a, sum_b = np.append(0, np.cumsum(a)), np.append(0, np.cumsum(b))
    out = np.zeros(2 * reach + 1)
    for k, lag in enumerate(range(-reach, reach + 1)):
        if abs(lag) < n:
            both = shared[lag % size]
            in_a = sum_a[n] - sum_a[lag] if lag >= 0 else sum_a[n + lag]
            in_b = sum_b[n - lag] if lag >= 0 else sum_b[n] - sum_b[-lag]
            union = in_a + in_b - both
            out[k] = both / union if union else 0.0
    return out
