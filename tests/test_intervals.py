import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from turnwise.operators import intervals as iv


def frame(spark, data, schema="clip string, speaker string, idx long, start long, end long"):
    return spark.createDataFrame(data, schema)


def some(n, seed, keys=2, speakers=3, span=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(span)
        out.append((f"c{r.randrange(keys)}", f"p{r.randrange(speakers)}", i, s, s + r.randrange(1, 12)))
    return out


def points(data, clip):
    """For each unit of time the speakers that hold."""
    out = {}
    for c, p, _, s, e in data:
        if c == clip:
            for t in range(s, e):
                out.setdefault(t, []).append(p)
    return out


def test_union_and_sweep_against_points(spark):
    data = some(60, 1)
    df = frame(spark, data)
    got = {r["clip"]: r for r in iv.sweep(df, ["clip"], "speaker", eps=0).collect()}
    for clip in ("c0", "c1"):
        p = points(data, clip)
        assert got[clip]["union_len"] == len(p)
        assert got[clip]["overlap_len"] == sum(len(set(x)) >= 2 for x in p.values())
        assert got[clip]["label_len"] == sum(len(set(x)) for x in p.values())


def test_touching_intervals_merge_and_gap_blocks(spark):
    df = frame(spark, [("c", "a", 0, 0, 5), ("c", "a", 1, 5, 7), ("c", "a", 2, 9, 10)])
    assert rows(iv.union_intervals(df, ["clip", "speaker"], eps=0)) == [("c", "a", 0, 7, 2), ("c", "a", 9, 10, 1)]
    # another speaker in between keeps turns apart
    df = frame(spark, [("c", "a", 0, 0, 5), ("c", "b", 1, 5, 6), ("c", "a", 2, 6, 7), ("c", "a", 3, 8, 9)])
    assert rows(iv.merge_gaps(df, ["clip"], "speaker", 1)) == [("c", "a", 0, 5, 1), ("c", "a", 6, 9, 2), ("c", "b", 5, 6, 1)]


def merge_sequentially(turns, gap):
    out = []
    for p, s, e in turns:
        if out and out[-1][0] == p and s - out[-1][2] <= gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([p, s, e])
    return sorted(map(tuple, out))


def test_gap_merge_against_the_sequential_definition(spark):
    for seed in range(3):
        data = some(40, seed, keys=1, speakers=2)
        got = iv.merge_gaps(frame(spark, data), ["clip"], "speaker", 2).select("speaker", "start", "end")
        assert sorted(map(tuple, got.collect())) == merge_sequentially([(p, s, e) for _, p, i, s, e in sorted(data, key=lambda x: (x[3], x[2]))], 2)


def test_interval_join_finds_each_pair_once_in_any_bin_width(spark):
    data = some(50, 3)
    df = frame(spark, data)
    want = sorted((a[2], b[2], min(a[4], b[4]) - max(a[3], b[3])) for a in data for b in data if a[0] == b[0] and a[3] < b[4] and b[3] < a[4])
    for width in (1, 4, 1000):
        got = iv.interval_join(df, df, ["clip"], width).select("l.idx", F.col("r.idx").alias("r"), "shared")
        assert sorted(map(tuple, got.collect())) == want


def test_pairs_with_empty_intervals_inside_others(spark):
    """Empty ones, one at another's edge, equal empty ones, one that ends before it starts, and one without an end."""
    data = some(40, 4) + [("c0", "p0", 40 + i, t, t) for i, t in enumerate((0, 7, 7, 20, 33, 60))] + [("c0", "p0", 50, 30, 26), ("c1", "p1", 51, 3, None)]
    pair = lambda a, b: a[:1] == b[:1] and None not in (a[4], b[4]) and a[3] < b[4] and b[3] < a[4] and (a[3], a[4], a[2]) < (b[3], b[4], b[2])
    want = sorted((a[2], b[2], min(a[4], b[4]) - b[3]) for a in data for b in data if pair(a, b))
    assert any(a >= 40 or b >= 40 for a, b, _ in want)
    for width in (1, 4, 1000):
        got = iv.overlap_pairs(frame(spark, data), ["clip"], "idx", width, empty=True).select("l.idx", F.col("r.idx").alias("r"), "shared")
        assert sorted(map(tuple, got.collect())) == want
        lasting = iv.overlap_pairs(frame(spark, data), ["clip"], "idx", width).select("l.idx", F.col("r.idx").alias("r"), "shared")
        assert sorted(map(tuple, lasting.collect())) == [x for x in want if x[2] > 0]


def test_assignment_ties_gaps_and_no_turns(spark):
    words = spark.createDataFrame([("c", 0, 0, 4), ("c", 1, 20, 22), ("d", 2, 0, 1), ("c", 3, 6, 6)], "clip string, word_idx long, start long, end long")
    turns = spark.createDataFrame([("c", 0, "a", 0, 2), ("c", 1, "b", 2, 4), ("c", 2, "e", 10, 17)], "clip string, turn_idx long, speaker string, start long, end long")
    got = {r["word_idx"]: (r["speaker"], r["shared"]) for r in iv.assign_max_overlap(words, turns, ["clip"], 5).collect()}
    assert got == {0: ("a", 2), 1: ("e", 0), 2: ("SPEAKER_UNKNOWN", 0), 3: ("b", 0)}


def test_error_regions_use_multisets(spark):
    ref = frame(spark, [("c", "A", 0, 0, 10), ("c", "B", 1, 0, 10)])
    hyp = frame(spark, [("c", "A", 0, 0, 10), ("c", "A", 1, 0, 10)])
    r = iv.error_regions(ref, hyp, ["clip"]).collect()
    assert [(x["miss"], x["fa"], x["confusion"], x["correct"]) for x in r] == [(0, 0, 1, 1)]


def test_der_total_counts_overlap_once_for_each_speaker(spark):
    ref = frame(spark, [("c", "A", 0, 0, 10), ("c", "A", 1, 20, 30), ("c", "B", 2, 5, 15)])
    r = iv.error_regions(ref, ref, ["clip"]).selectExpr("sum(n_ref * (until - t)) AS total", "sum(correct * (until - t)) AS ok").first()
    assert (r["total"], r["ok"]) == (30, 30)


def test_lenient_region_and_restriction_against_points(spark):
    ref, hyp = some(14, 1, keys=1, span=200), some(14, 2, keys=1, span=200)
    r, h = frame(spark, ref), frame(spark, hyp)
    whole = spark.createDataFrame([("c0", 0, 230)], "clip string, start long, end long")
    region = iv.scored_region(r, whole, ["clip"], "speaker", 3, True, eps=0)
    p, q = points(ref, "c0"), points(hyp, "c0")
    want = set(range(230)) - {t for t, x in p.items() if len(set(x)) > 1}
    for _, _, _, a, b in ref:
        for edge in (a, b):
            want -= set(range(edge - 3, edge + 3))
    assert {t for x in region.collect() for t in range(x["start"], x["end"])} == want
    regions = iv.error_regions(iv.restrict(r, region, ["clip"], 10), iv.restrict(h, region, ["clip"], 10), ["clip"])
    got = sum((x["miss"] + x["fa"] + x["confusion"]) * (x["until"] - x["t"]) for x in regions.collect())
    error = 0
    for t in want:
        a, b = Counter(p.get(t, [])), Counter(q.get(t, []))
        error += max(sum(a.values()), sum(b.values())) - sum((a & b).values())
    assert got == error


def test_empty_tables_keep_their_schema(spark):
    df = frame(spark, [])
    assert iv.union_intervals(df, ["clip"], eps=0).count() == 0
    assert iv.sweep(df, ["clip"], "speaker", eps=0).count() == 0
    assert iv.interval_join(df, df, ["clip"], 5).count() == 0


def test_split_long_and_grid(spark):
    df = frame(spark, [("c", "a", 0, 0, 29), ("c", "a", 1, 0, 60)])
    got = iv.split_long(df, 29, 28).select("idx", "piece", "p_start", "p_end")
    assert rows(got) == [(0, 0, 0, 29), (1, 0, 0, 29), (1, 1, 28, 57), (1, 2, 56, 60)]
    v = spark.createDataFrame([(0.25,), (0.75,), (-0.3,)], "x double").select(iv.to_grid(F.col("x"), 0.5))
    assert [r[0] for r in v.collect()] == [0.0, 1.0, -0.5]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_alignment_is_least(a, b):
    from turnwise.functions.align import distance, edit_counts

    h, s, d, i = edit_counts(a, b)
    assert h + s + d == len(a) and h + s + i == len(b)
    best = list(range(len(b) + 1))
    for x, w in enumerate(a, 1):
        row = [x]
        for y, v in enumerate(b, 1):
            row.append(min(best[y] + 1, row[y - 1] + 1, best[y - 1] + (w != v)))
        best = row
    assert s + d + i == distance(a, b) == best[-1]


def test_time_bins_change_nothing(spark):
    """Unions, depths and error regions by time bins of any width are those of one window for each clip."""
    r = random.Random(12)
    data = [(c, f"s{r.randrange(3)}", s, s + r.randrange(1, 40)) for c in ("a", "b") for s in (r.randrange(500) for _ in range(120))] + [("c", "s0", 0, 999)]
    df = spark.createDataFrame(data, "clip string, speaker string, start long, end long")
    hyp = df.withColumns({"start": F.col("start") + 3, "end": F.col("end") + 5})
    for width in (7, 50, 10_000):
        for f in (
            lambda w: iv.union_intervals(df, ["clip", "speaker"], eps=0, width=w),
            lambda w: iv.depth_series(df, ["clip"], width=w),
            lambda w: iv.timeline(df, ["clip"], "speaker", 2, eps=0, width=w),
            lambda w: iv.error_regions(df, hyp, ["clip"], width=w),
        ):
            assert rows(f(width)) == rows(f(None))
