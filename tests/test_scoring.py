"""Scores against brute force, and what reads and writes besides the queries."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from turnwise.operators import fusion, guards, qc, scoring
from turnwise.sources import readers, writers


def timeline(turns, n):
    """Sets of speakers by whole second."""
    out = [set() for _ in range(n)]
    for speaker, s, e in turns:
        for t in range(s, e):
            out[t].add(speaker)
    return out


def brute(ref, hyp, n, where):
    """Parts under the best of all mappings, by second; none where nothing is scored."""
    a, b = timeline(ref, n), timeline(hyp, n)
    labels, targets = sorted({x[0] for x in hyp}), sorted({x[0] for x in ref})
    targets = targets + [None] * len(labels)
    best = None
    for p in itertools.permutations(targets, len(labels)):
        to = {x: y if y is not None else f"#{x}" for x, y in zip(labels, p)}
        parts = [0, 0, 0, 0, 0]
        for t in where:
            r, h = a[t], {to[x] for x in b[t]}
            ok = len(r & h)
            parts = [u + v for u, v in zip(parts, (max(len(r) - len(h), 0), max(len(h) - len(r), 0), min(len(r), len(h)) - ok, ok, len(r)))]
        if best is None or parts[3] > best[3]:
            best = parts
    return best


def test_scores_against_brute_force(spark):
    r = random.Random(5)
    ref, hyp, n = [], [], 60
    for c in range(6):
        turns = lambda names: [(r.choice(names), s, min(n, s + r.randrange(1, 15))) for s in (r.randrange(n - 1) for _ in range(8))]
        ref += [(f"c{c}", *t) for t in turns("AB" if c % 2 else "ABC")]
        hyp += [(m, f"c{c}", *t) for m in ("m1", "m2") for t in turns("xyz")]
    turn = "clip_id string, speaker string, start int, end int"
    as_double = lambda df: df.withColumns({c: F.col(c).cast("double") for c in ("start", "end")})
    whole = spark.createDataFrame([(f"c{c}", 0.0, float(n)) for c in range(6)], "clip_id string, start double, end double")
    out = scoring.score_all(as_double(spark.createDataFrame(ref, turn)), as_double(spark.createDataFrame(hyp, f"model string, {turn}")), whole, 7.0)
    got = {(x["model"], x["clip_id"]): x for x in out.collect()}
    assert len(got) == 12
    for (m, c), x in got.items():
        a, b = [t[1:] for t in ref if t[0] == c], [t[2:] for t in hyp if t[:2] == (m, c)]
        want = brute(a, b, n, range(n))
        assert np.allclose([x[p] for p in scoring.PARTS], want) and np.isclose(x["der"], sum(want[:3]) / want[4])
        seconds = timeline(a, n)
        for name, where in (("overlap", [t for t in range(n) if len(seconds[t]) > 1]), ("single", [t for t in range(n) if len(seconds[t]) == 1])):
            part = brute(a, b, n, where)
            assert (x[f"{name}_der"] is None) == (part[4] == 0)
            assert part[4] == 0 or np.isclose(x[f"{name}_der"], sum(part[:3]) / part[4])
        speakers, found = sorted({t[0] for t in a}), sorted({t[0] for t in b})
        held = lambda turns, s: {t for p, u, v in turns if p == s for t in range(u, v)}
        error = [[1 - len(held(a, s) & held(b, f)) / len(held(a, s) | held(b, f)) for f in found] + [1.0] * len(speakers) for s in speakers]
        least = min(sum(error[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(error[0])), len(speakers)))
        assert np.isclose(x["jer"], least / len(speakers))


def test_fusion_is_made_once(spark, tmp_path):
    t = spark.createDataFrame([(c, s, 0, "a", 0.0, 5.0) for c in ("c1", "c2") for s in ("s0", "s1")], "clip_id string, system string, turn_idx long, speaker string, start double, end double")
    clips = spark.createDataFrame([("c1", 5.0), ("c2", 5.0)], "clip_id string, duration double")
    for _ in range(2):
        side = fusion.materialized(t, ["s0", "s1"], clips, str(tmp_path / "f"))
        assert rows(side.select("clip_id", "status", "n_turns", "n_speakers")) == [("c1", "ok", 1, 1), ("c2", "ok", 1, 1)]
    assert spark.read.parquet(str(tmp_path / "f/turns")).count() == 2
    assert fusion.materialized(t, ["s0", "s1"], clips, str(tmp_path / "f"), threshold=0.9).count() == 2


def test_adoption_reference_and_export(spark, tmp_path):
    t = spark.createDataFrame([("c1", 0, "A B", 0.0, 1.5), ("c1", 1, "C", 1.5, 2.0)], "clip_id string, turn_idx long, speaker string, start double, end double")
    side = writers.adopt_rttm(t, str(tmp_path / "own"), "other", "elsewhere").collect()
    assert [(x["model"], x["clip_id"], x["n_turns"], x["n_speakers_hyp"], x["max_end"], x["imported_from"]) for x in side] == [("other", "c1", 2, 2, 2.0, "elsewhere")]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/c1.json").write_text('{"clip_id": "c1", "duration": 2.0, "texts": ["hi", "ho"]}')
    ref = readers.reference(spark, str(tmp_path / "own/rttm/*/*/*.txt"), str(tmp_path / "texts"))
    assert rows(ref.select("clip_id", "speaker", "start", "end", "text", "duration")) == [("c1", "A_B", 0.0, 1.5, "hi", 2.0), ("c1", "C", 1.5, 2.0, "ho", 2.0)]
    (tmp_path / "texts/c2.json").write_text('{"clip_id": "c2", "duration": 2.0, "texts": []}')
    with pytest.raises(ValueError, match="c2"):
        readers.reference(spark, str(tmp_path / "own/rttm/*/*/*.txt"), str(tmp_path / "texts"))
    (tmp_path / "index.json").write_text('{"clip_id": "c1", "n_turns": 1}\n')
    (tmp_path / "clips.json").write_text('{"clip_id": "c1", "turns": [{"speaker": "A", "start": 0, "end": 1}]}\n')
    got = readers.export(spark, str(tmp_path / "index.json"), str(tmp_path / "clips.json"), spark.createDataFrame([("c1", "seen")], "clip_id string, note string"))
    assert got.first()["note"] == "seen"
    (tmp_path / "index.json").write_text('{"clip_id": "c1", "n_turns": 2}\n')
    with pytest.raises(ValueError, match="c1"):
        readers.export(spark, str(tmp_path / "index.json"), str(tmp_path / "clips.json"))
    regions = spark.createDataFrame([("c1", 0.0, 1.0, 1)], "clip_id string, t double, until double, miss int")
    scores = spark.createDataFrame([("c1", 0.5)], "clip_id string, der double")
    writers.write_export(regions, scores, ["clip_id"], ["t"], str(tmp_path / "out"), regions.limit(0))
    assert spark.read.json(str(tmp_path / "out/index")).first()["verified"]
    with pytest.raises(ValueError):
        writers.write_export(regions, scores, ["clip_id"], ["t"], str(tmp_path / "out"), regions)


def test_grid_and_regroup(spark):
    df = lambda columns, *r: spark.createDataFrame(r, columns)
    got = readers.grid(
        df("system string", ("a",), ("b",)), df("model string", ("x",), ("y",)), df("clip_id string", ("1",), ("2",)),
        df("system string, clip_id string", ("a", "1"), ("b", "2"), ("c", "1")), df("model string, clip_id string", ("x", "1"), ("y", "1"), ("x", "3")),
    )
    assert rows(got) == [("a", "x", "1"), ("a", "y", "1")]
    by = readers.by_clip(df("clip_id string, model string, der double", ("1", "x", 0.5), ("1", "y", 0.1)), "clip_id", "model", "der").first()
    assert {k: v["der"] for k, v in by["rows"].items()} == {"x": 0.5, "y": 0.1}


def test_cache_answers_only_what_is_new(spark, tmp_path):
    asked = []

    def answer(misses):
        found = [r["request_key"] for r in misses.collect()]
        asked.append(len(found))
        return spark.createDataFrame([(k, f"re {k[:4]}") for k in found], "request_key string, response string")

    r = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "a"), ("ma", "")], "model string, text string").withColumn("request_key", guards.request_key(F.col("model"), F.col("text")))
    for _ in range(2):
        out = guards.answered(r, str(tmp_path / "cache"), answer)
        assert out.count() == 4 and out.where("response is null").count() == 0
    assert asked == [3, 0]


def test_admission(spark):
    df = spark.createDataFrame([("c", 1.0, 3)], "clip_id string, duration double, ref_speakers int")
    assert guards.admitted(df, ["clip_id", "duration"], ["ref_speakers"]).columns == ["clip_id", "duration", "oracle"]
    assert guards.admitted(df, ["clip_id", "duration"], ["ref_speakers"], True).first()["oracle"]
    for odd in (df, df.drop("ref_speakers").withColumn("x", F.lit(1))):
        with pytest.raises(ValueError):
            guards.admitted(odd, ["clip_id", "duration"])


def test_pilot_spans_groups_and_fits_its_budget(spark):
    r = random.Random(2)
    data = [(f"c{i:02}", "abc"[i % 3], r.random(), float(r.randrange(100)), float(r.randrange(50, 400))) for i in range(30)]
    df = spark.createDataFrame(data, "clip_id string, script string, overlap double, n_seg double, dur double")
    got = qc.pilot(df, "script", "overlap", "n_seg", "dur", 8, 1200.0, seed=4)
    assert got == qc.pilot(df.repartition(5), "script", "overlap", "n_seg", "dur", 8, 1200.0, seed=4)
    assert sum(x["dur"] for x in got) <= 1200 and {x["script"] for x in got} == set("abc") and len({x["clip_id"] for x in got}) == len(got)
    first = qc.pilot(df, "script", "overlap", "n_seg", "dur", 3, 1e9)
    for group, q in zip("abc", (0.9, 0.5, 0.1)):
        ordered = sorted((d for d in data if d[1] == group), key=lambda d: (d[2], d[0]))
        assert ordered[int(q * (len(ordered) - 1))][0] in {x["clip_id"] for x in first}
    assert [x["v"] for x in qc.widened([{"v": 5}], [{"v": 6}, {"v": 0}, {"v": 9}], 3, "v")] == [5, 0, 9]
