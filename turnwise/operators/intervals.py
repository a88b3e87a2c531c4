"""Interval algebra: unions, gap merges, sweeps, overlap joins and assignment, as DataFrame plans.

Intervals are half-open [start, end) in any numeric type. ``keys`` name what intervals are compared
within (a clip, a clip and a system); every window and join is partitioned by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-9  # touching intervals merge


def crop(df: DataFrame, lo: Column, hi: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Clamps to [lo, hi); what lies outside or is empty goes."""
    s, e = F.greatest(F.col(start), lo), F.least(F.col(end), hi)
    return df.where((F.col(start) < hi) & (s < e)).withColumns({start: s, end: e})


def crop_counters(df: DataFrame, keys: list[str], hi: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that a crop drops for starting at or after hi, and rows that it cuts short."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(start) >= hi).alias("n_dropped"),
        F.count_if((F.col(start) < hi) & (F.col(end) > hi)).alias("n_truncated"),
    )


def _bins(rows: DataFrame, keys: list[str], at: str, width) -> DataFrame:
    return rows.withColumn("__bin", F.floor(F.col(at) / F.lit(width)).cast("long"))


def _with_bins(rows: DataFrame, keys: list[str], before: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """rows, which have __bin, with columns ``over`` the bins of their keys: of each bin one row goes through a
    window, so that the rows of a key need not meet in one task. ``before`` are the bins' aggregates."""
    n = [*keys, "__bin"]
    bins = rows.groupBy(*n).agg(*(c.alias(k) for k, c in before.items()))
    bins = bins.select(*(F.col(c).alias(f"__of_{c}") for c in n), *(c.alias(k) for k, c in over.items()))
    return rows.join(bins, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in n]).drop(*(f"__of_{c}" for c in n))


def _running(rows: DataFrame, keys: list[str], t: str, sums: list[str], width) -> DataFrame:
    """rows (one for each keys and t) with ``until``, the next t of their keys, and running sums. With a width
    they are dealt out by time bins of it, and a bin begins with the sums of those before."""
    if width is None:
        over = Window.partitionBy(*keys).orderBy(t)
        upto = over.rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*keys, t, F.lead(t).over(over).alias("until"), *(F.sum(c).over(upto).alias(c) for c in sums))
    order = Window.partitionBy(*keys).orderBy("__bin")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    binned = _with_bins(
        _bins(rows, keys, t, width), keys, {"__first": F.min(t), **{f"__{c}": F.sum(c) for c in sums}},
        {"__next": F.lead("__first").over(order), **{f"__{c}": F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)) for c in sums}},
    )
    over = Window.partitionBy(*keys, "__bin").orderBy(t)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    return binned.select(*keys, t, F.coalesce(F.lead(t).over(over), F.col("__next")).alias("until"), *((F.sum(c).over(upto) + F.col(f"__{c}")).alias(c) for c in sums))


def _islands(df: DataFrame, part: list[str], order: list[str], start: str, end: str, gap: Column, width=None) -> DataFrame:
    if width is None:
        seen = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        run = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        new = F.coalesce((F.col(start) > F.max(end).over(seen) + gap).cast("int"), F.lit(1))
        return df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(run)).drop("__new")
    earlier = Window.partitionBy(*part).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*part, "__bin").orderBy(*order)
    binned = _with_bins(_bins(df, part, start, width), part, {"__end": F.max(end)}, {"__reached": F.max("__end").over(earlier)})
    reached = F.greatest(F.col("__reached"), F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce((F.col(start) > reached + gap).cast("int"), F.lit(1))
    told = _with_bins(binned.withColumn("__new", new).drop("__reached"), part, {"__n": F.sum("__new")}, {"__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0))})
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("__island", F.col("__before") + F.sum("__new").over(upto)).drop("__new", "__before", "__bin")


def union_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", eps: float | int = EPS, width=None) -> DataFrame:
    """Disjoint unions within keys, touching ones merged, with the number of rows in each. With a width, rows of
    one key are dealt out by time bins of it."""
    with_id = _islands(df, keys, [start, end], start, end, F.lit(eps), width)
    return (
        with_id.groupBy(*keys, "__island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"))
        .drop("__island")
    )


def merge_gaps(df: DataFrame, keys: list[str], label: str, gap: float | int, start: str = "start", end: str = "end", tie: str = "idx") -> DataFrame:
    """Joins turns of one label that follow each other within gap; another label in between keeps them apart."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    change = F.coalesce((~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int"), F.lit(1))
    runs = df.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    with_id = _islands(runs, [*keys, "__run"], [start, tie], start, end, F.lit(gap))
    return (
        with_id.groupBy(*keys, "__run", "__island", label)
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"))
        .drop("__run", "__island")
    )


def depth_series(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", weight: Column | None = None, width=None) -> DataFrame:
    """keys, t, until, depth: how many intervals (or how much weight) hold on each elementary interval. With a
    width, edges of one key are dealt out by time bins of it."""
    w = weight if weight is not None else F.lit(1)
    ev = F.explode(F.array(F.struct(F.col(start).alias("t"), w.alias("d")), F.struct(F.col(end).alias("t"), (-w).alias("d"))))
    deltas = df.select(*keys, ev.alias("x")).groupBy(*keys, "x.t").agg(F.sum("x.d").alias("depth"))
    return _running(deltas, keys, "t", ["depth"], width).where(F.col("until").isNotNull())


def label_depth(df: DataFrame, keys: list[str], label: str, start: str = "start", end: str = "end", eps: float | int = EPS, width=None) -> DataFrame:
    """Depth in distinct labels: a label's own overlaps count once."""
    return depth_series(union_intervals(df, [*keys, label], start, end, eps, width), keys, start, end, None, width)


def sweep(df: DataFrame, keys: list[str], label: str, start: str = "start", end: str = "end", eps: float | int = EPS, width=None) -> DataFrame:
    """Time under any label, under two or more, and summed over labels."""
    length = F.col("until") - F.col("t")
    return label_depth(df, keys, label, start, end, eps, width).groupBy(*keys).agg(
        F.sum(F.when(F.col("depth") >= 1, length).otherwise(0)).alias("union_len"),
        F.sum(F.when(F.col("depth") >= 2, length).otherwise(0)).alias("overlap_len"),
        F.sum(F.col("depth") * length).alias("label_len"),
    )


def timeline(df: DataFrame, keys: list[str], label: str, low: int, high: int | None = None, start: str = "start", end: str = "end", eps: float | int = EPS, width=None) -> DataFrame:
    """Stretches where from low to high labels hold, neighbours joined."""
    d = label_depth(df, keys, label, start, end, eps, width)
    kept = d.where((F.col("depth") >= low) & (F.lit(True) if high is None else F.col("depth") <= high))
    return union_intervals(kept.select(*keys, F.col("t").alias(start), F.col("until").alias(end)), keys, start, end, eps, width).drop("n_merged")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width, start: str = "start", end: str = "end", left_as: str = "l", right_as: str = "r", empty: bool = False) -> DataFrame:
    """Pairs that overlap, as structs l and r with ``shared``: an equi-join on keys and time bins.

    An interval goes to each bin that it touches; a pair is kept in the bin where the later one starts,
    so it comes out once. A bin of about an interval's length keeps both copies and pairs few. Intervals
    that do not end after their start are left out, unless ``empty``: then they are paired with those that
    begin before their start and last beyond it, as start < other end and other start < end say.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        last = F.greatest(F.col(start), F.col(end))  # the bin of its start, for one that ends before it
        first, last = (F.floor(c / F.lit(width)).cast("long") for c in (F.col(start), last))
        row = F.struct(*(df[c] for c in df.columns)).alias(name)
        kept = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()) if empty else df.where(F.col(start) < F.col(end))
        return kept.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), row, F.explode(F.sequence(first, last)).alias(f"{name}_bin"))

    a, b = binned(left, left_as), binned(right, right_as)
    on = [F.col(f"{left_as}_{k}") == F.col(f"{right_as}_{k}") for k in keys]
    ls, le, rs, re_ = (F.col(f"{x}.{c}") for x in (left_as, right_as) for c in (start, end))
    on += [F.col(f"{left_as}_bin") == F.col(f"{right_as}_bin"), ls < re_, rs < le]
    later = F.floor(F.greatest(ls, rs) / F.lit(width)).cast("long")
    return a.join(b, on).where(F.col(f"{left_as}_bin") == later).select(left_as, right_as, (F.least(le, re_) - F.greatest(ls, rs)).alias("shared"))


def overlap_pairs(df: DataFrame, keys: list[str], idx: str, width, start: str = "start", end: str = "end", empty: bool = False) -> DataFrame:
    """Overlapping pairs within keys, the one that begins first (then ends first, then idx) as l; with
    ``empty`` also those of an empty interval and one that it lies in, which share nothing."""
    pairs = interval_join(df, df, keys, width, start, end, empty=empty)
    order = lambda x: F.struct(F.col(f"{x}.{start}"), F.col(f"{x}.{end}"), F.col(f"{x}.{idx}"))
    return pairs.where(order("l") < order("r"))


def assign_max_overlap(words: DataFrame, turns: DataFrame, keys: list[str], width, word: str = "word_idx", turn: str = "turn_idx", label: str = "speaker", unknown="SPEAKER_UNKNOWN") -> DataFrame:
    """keys, word, label, shared: the turn with the longest overlap, the first listed on ties; without any,
    the turn whose nearer edge is closest to the word's middle; without turns, ``unknown``."""
    best = (
        interval_join(words, turns, keys, width)
        .where("shared > 0")
        .groupBy(*(F.col(f"l.{k}").alias(k) for k in keys), F.col(f"l.{word}").alias(word))
        .agg(F.max(F.struct("shared", (-F.col(f"r.{turn}")).alias("t"), F.col(f"r.{label}").alias("label"))).alias("x"))
        .select(*keys, word, F.col("x.label").alias(label), F.col("x.shared").alias("shared"))
    )
    rest = words.join(best.select(*keys, word), [*keys, word], "left_anti")
    near = nearest_turn(rest, turns, keys, word, turn, label, unknown)
    return best.unionByName(near.select(*keys, word, label, F.lit(0).cast(best.schema["shared"].dataType).alias("shared")))


def nearest_turn(words: DataFrame, turns: DataFrame, keys: list[str], word: str = "word_idx", turn: str = "turn_idx", label: str = "speaker", unknown="SPEAKER_UNKNOWN") -> DataFrame:
    """For words that no turn overlaps: an as-of join to edges on either side of the middle.

    Edges and middles go through one ordered window each way, so the work is n log n, not words times turns.
    """
    doubled = lambda c: F.col(c) * 2  # noqa: E731  whole numbers stay whole: distances are doubled
    w = words.select(*keys, F.col(word).alias("__w"), (F.col("start") + F.col("end")).alias("m"), F.lit(None).cast("long").alias("__t"), F.lit(None).cast(turns.schema[label].dataType).alias("__l"))
    edges = turns.select(*keys, F.explode(F.array(doubled("start"), doubled("end"))).alias("m"), F.col(turn).cast("long").alias("__t"), F.col(label).alias("__l"))
    edges = edges.groupBy(*keys, "m").agg(F.min(F.struct("__t", "__l")).alias("x"))
    edges = edges.select(*keys, F.lit(None).cast(words.schema[word].dataType).alias("__w"), "m", "x.__t", "x.__l")
    every = w.unionByName(edges)
    edge = F.when(F.col("__w").isNull(), F.struct("m", "__t", "__l"))
    # frames by value, so that an edge at the very middle is seen from both sides; each grows from its own
    # end of the order, as one that shrinks towards the end would be summed up anew for every row
    up, down = (Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("m").asc(), F.col("m").desc()))
    before, after = F.last(edge, True).over(up), F.last(edge, True).over(down)
    seen = every.select(*keys, "__w", "m", before.alias("b"), after.alias("a")).where("__w is not null")
    side = lambda x: F.struct(F.abs(F.col(f"{x}.m") - F.col("m")).alias("d"), F.col(f"{x}.__t").alias("t"), F.col(f"{x}.__l").alias("l"))
    pick = F.when(F.col("b").isNull(), side("a")).when(F.col("a").isNull(), side("b")).otherwise(F.least(side("a"), side("b")))
    return seen.select(*keys, F.col("__w").alias(word), F.coalesce(pick["l"], F.lit(unknown)).alias(label))


def frame_intervals(df: DataFrame, hop: float, n_frames: Column, start: str = "start", end: str = "end") -> DataFrame:
    """lo, hi: frames [lo, hi) that an interval sets on a grid of n_frames, without listing them."""
    lo = (F.greatest(F.lit(0.0), F.col(start)) / F.lit(hop)).cast("long")
    hi = (F.least(n_frames * F.lit(hop), F.col(end)) / F.lit(hop)).cast("long")
    return df.withColumns({"lo": lo, "hi": hi}).where("hi > lo")


def frames_to_turns(df: DataFrame, keys: list[str], hop: float, min_dur: float) -> DataFrame:
    """Runs of frames as seconds, those of min_dur and longer."""
    runs = union_intervals(df, keys, "lo", "hi", 0)
    return runs.where((F.col("hi") - F.col("lo")) * F.lit(hop) >= F.lit(min_dur)).select(
        *keys, (F.col("lo") * F.lit(hop)).alias("start"), (F.col("hi") * F.lit(hop)).alias("end")
    )


def consensus(df: DataFrame, keys: list[str], voter: str, votes: int, n_voters: int, start: str = "start", end: str = "end", eps: float | int = 0) -> DataFrame:
    """Stretches where at least min(votes, n_voters) voters are active."""
    return timeline(df, keys, voter, min(votes, n_voters), None, start, end, eps)


def boundaries(df: DataFrame, keys: list[str], lo: Column, hi: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Distinct edges strictly inside (lo, hi), and lo and hi."""
    inner = df.select(*keys, F.explode(F.array(start, end)).alias("t")).where((F.col("t") > lo) & (F.col("t") < hi))
    ends = df.select(*keys).distinct().select(*keys, F.explode(F.array(lo, hi)).alias("t"))
    return inner.unionByName(ends).distinct()


def active_at(points: DataFrame, turns: DataFrame, keys: list[str], width, at: str, label: str) -> DataFrame:
    """Points with the distinct labels of the turns that hold there (start <= at < end)."""
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    p = points.withColumn("__bin", bin_of(at))
    span = F.explode(F.sequence(bin_of("start"), bin_of("end"))).alias("__t_bin")
    t = turns.select(*(F.col(k).alias(f"__t_{k}") for k in keys), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col(label).alias("__label"), span)
    on = [F.col(k) == F.col(f"__t_{k}") for k in keys] + [F.col("__bin") == F.col("__t_bin"), F.col("__s") <= F.col(at), F.col(at) < F.col("__e")]
    return p.join(t, on, "left").groupBy(*keys, at).agg(F.array_sort(F.collect_set("__label")).alias("labels"))


def error_regions(ref: DataFrame, hyp: DataFrame, keys: list[str], label: str = "speaker", start: str = "start", end: str = "end", width=None) -> DataFrame:
    """Elementary intervals with multisets of labels on both sides, as miss, false alarm, confusion and
    correct counts. Labels of hyp are already mapped to those of ref. Depths come from running sums by label."""
    both = ref.select(*keys, label, start, end, F.lit(1).alias("r"), F.lit(0).alias("h")).unionByName(
        hyp.select(*keys, label, start, end, F.lit(0).alias("r"), F.lit(1).alias("h"))
    )
    ev = F.explode(F.array(F.struct(F.col(start).alias("t"), F.col("r"), F.col("h")), F.struct(F.col(end).alias("t"), (-F.col("r")).alias("r"), (-F.col("h")).alias("h"))))
    deltas = both.select(*keys, label, ev.alias("x")).groupBy(*keys, label, "x.t").agg(F.sum("x.r").alias("r"), F.sum("x.h").alias("h"))
    per_label = _running(deltas, [*keys, label], "t", ["r", "h"], width).where("until is not null")
    # each label's stretch changes the clip's totals at its edges
    parts = {"n_ref": F.col("r"), "n_hyp": F.col("h"), "n_both": F.least("r", "h")}
    at = lambda c, sign: F.struct(F.col(c).alias("t"), *((v * sign).alias(k) for k, v in parts.items()))
    total = per_label.select(*keys, F.explode(F.array(at("t", 1), at("until", -1))).alias("x")).groupBy(*keys, "x.t").agg(*(F.sum(f"x.{k}").alias(k) for k in parts))
    d = _running(total, keys, "t", list(parts), width).where("until is not null")
    n_ref, n_hyp, ok = F.col("n_ref"), F.col("n_hyp"), F.col("n_both")
    return d.select(
        *keys, "t", "until",
        F.greatest(n_ref - n_hyp, F.lit(0)).alias("miss"), F.greatest(n_hyp - n_ref, F.lit(0)).alias("fa"),
        (F.least("n_ref", "n_hyp") - ok).alias("confusion"), ok.alias("correct"), n_ref.alias("n_ref"), n_hyp.alias("n_hyp"),
    ).where("n_ref > 0 or n_hyp > 0")


def merge_regions(regions: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Neighbouring regions of one signature as one."""
    w = Window.partitionBy(*keys).orderBy("t")
    same = F.lit(True)
    for c in signature:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    new = (~(same & (F.lag("until").over(w) == F.col("t")))).cast("int")
    r = regions.withColumn("__n", F.coalesce(new, F.lit(1))).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "__g", *signature).agg(F.min("t").alias("t"), F.max("until").alias("until")).drop("__g")


def relabel(hyp: DataFrame, mapping: DataFrame, keys: list[str], label: str = "speaker") -> DataFrame:
    """Mapped labels; an unmapped one that is also a target gets #unmapped behind it."""
    m = mapping.select(*(F.col(k).alias(f"m_{k}") for k in keys), F.col("label").alias("m_label"), "target")
    t = mapping.select(*(F.col(k).alias(f"t_{k}") for k in keys), F.col("target").alias("t_target")).distinct()
    out = hyp.join(m, [F.col(k) == F.col(f"m_{k}") for k in keys] + [F.col(label) == F.col("m_label")], "left")
    out = out.join(t, [F.col(k) == F.col(f"t_{k}") for k in keys] + [F.col(label) == F.col("t_target")], "left")
    new = F.coalesce(F.col("target").cast("string"), F.when(F.col("t_target").isNotNull(), F.concat(F.col(label).cast("string"), F.lit("#unmapped"))), F.col(label).cast("string"))
    return out.withColumn(label, new).select(*hyp.columns)


def shift(df: DataFrame, delta: Column, lo: Column, hi: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Moves intervals by delta, clips them to [lo, hi) and drops the empty."""
    return crop(df.withColumns({start: F.col(start) + delta, end: F.col(end) + delta}), lo, hi, start, end)


def to_grid(value: Column, grid: float) -> Column:
    """The nearest multiple of grid, halves to even."""
    return F.bround(value / F.lit(float(grid))) * F.lit(float(grid))


def split_long(df: DataFrame, longest, step, start: str = "start", end: str = "end") -> DataFrame:
    """Pieces of at most ``longest``, one every ``step``, until one reaches the end: piece, p_start, p_end."""
    length = F.col(end) - F.col(start)
    last = F.greatest(F.lit(0), F.ceil((length - F.lit(longest)) / F.lit(step))).cast("int")
    p = df.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    begin = F.col(start) + F.col("piece") * F.lit(step)
    return p.withColumns({"p_start": begin, "p_end": F.least(F.col(end), begin + F.lit(longest))})


def padded_grid(clips: DataFrame, step, pad, end: str = "duration") -> DataFrame:
    """Each clip's chunks of ``step`` from 0, the last one cut: chunk, own_start, own_end, and start, end with
    the padding that is heard but not kept."""
    n = F.ceil(F.col(end) / F.lit(step)).cast("int")
    p = clips.where(F.col(end) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    own = {"own_start": F.col("chunk") * F.lit(step), "own_end": F.least(F.col(end), (F.col("chunk") + 1) * F.lit(step))}
    return p.withColumns(own).withColumns({"start": F.greatest(F.col("own_start") - pad, F.lit(0.0)), "end": F.least(F.col(end), F.col("own_end") + pad)})


def kept_of_chunks(words: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Words (keys, chunk, start, end; times of the clip) whose start lies in their chunk without padding, so
    that none comes twice."""
    own = grid.select(*keys, "chunk", "own_start", "own_end")
    inside = (F.col("start") >= F.col("own_start")) & (F.col("start") < F.col("own_end"))
    return words.join(own, [*keys, "chunk"]).where(inside).drop("own_start", "own_end")


def unrolled(df: DataFrame, tokens: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each token with an equal share of its row's time: pos, token, t_start, t_end."""
    step = (F.col(end) - F.col(start)) / F.size(tokens)
    p = df.select("*", F.posexplode(tokens).alias("pos", "token"))
    return p.withColumns({"t_start": F.col(start) + F.col("pos") * step, "t_end": F.col(start) + (F.col("pos") + 1) * step})


def neighbour_gaps(df: DataFrame, keys: list[str], idx: str, start: str = "start", end: str = "end") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start, idx)
    return df.withColumns({"gap_before": F.col(start) - F.lag(end).over(w), "gap_after": F.lead(start).over(w) - F.col(end)})


def restrict(df: DataFrame, regions: DataFrame, keys: list[str], width, start: str = "start", end: str = "end") -> DataFrame:
    """What of each interval lies within the regions (disjoint within keys), a row for each part."""
    parts = interval_join(df, regions.select(*keys, start, end), keys, width, start, end)
    cut = {start: F.greatest(F.col(f"l.{start}"), F.col(f"r.{start}")), end: F.least(F.col(f"l.{end}"), F.col(f"r.{end}"))}
    return parts.select(*(cut[c].alias(c) if c in cut else F.col(f"l.{c}").alias(c) for c in df.columns))


def without(regions: DataFrame, holes: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What of the regions (disjoint within keys) no hole covers."""
    mark = 1 << 40
    both = regions.select(*keys, start, end, F.lit(1).cast("long").alias("__w")).unionByName(holes.select(*keys, start, end, F.lit(mark).alias("__w")))
    left = depth_series(both.where(F.col(start) < F.col(end)), keys, start, end, F.col("__w")).where("depth = 1")
    return union_intervals(left.select(*keys, F.col("t").alias(start), F.col("until").alias(end)), keys, start, end, 0).drop("n_merged")


def scored_region(ref: DataFrame, whole: DataFrame, keys: list[str], label: str, collar, skip_overlap: bool, start: str = "start", end: str = "end", eps: float | int = EPS) -> DataFrame:
    """Where a lenient score counts: ``whole`` less a collar on both sides of each reference edge and, if
    so chosen, less what two or more labels of the reference share."""
    edge = F.explode(F.array(start, end)).alias("t")
    holes = ref.select(*keys, edge).select(*keys, (F.col("t") - collar).alias(start), (F.col("t") + collar).alias(end))
    if skip_overlap:
        holes = holes.unionByName(timeline(ref, keys, label, 2, None, start, end, eps))
    return without(whole, holes, keys, start, end)


def transplanted(labels: DataFrame, speech: DataFrame, keys: list[str], label: str, width, fallback: str, start: str = "start", end: str = "end", eps: float | int = EPS) -> DataFrame:
    """Labels where the other system hears speech; where it does and no label holds, the fallback column of
    ``speech`` (that system's own label, mapped)."""
    heard = union_intervals(speech, keys, start, end, eps).drop("n_merged")
    kept = restrict(labels.select(*keys, label, start, end), heard, keys, width, start, end)
    covered = union_intervals(labels, keys, start, end, eps).drop("n_merged")
    own = union_intervals(speech.withColumn(label, F.col(fallback)), [*keys, label], start, end, eps).drop("n_merged")
    gaps = without(heard, covered, keys, start, end)
    return kept.unionByName(restrict(own, gaps, keys, width, start, end).select(*kept.columns))
