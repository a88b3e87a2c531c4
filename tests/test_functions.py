import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from turnwise.functions import align, text
from turnwise.operators import fusion, guards, metrics
from turnwise.sources import readers, writers


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(0)
    for _ in range(200):
        c = rng.integers(0, 6, (rng.integers(1, 6), rng.integers(1, 6))).astype(float)
        x = align.assign(c)
        assert abs(sum(c[i, j] for i, j in enumerate(x) if j >= 0) - align.assign_brute(c)) < 1e-9


def test_cp_counts_pad_and_map():
    total, mapping = align.cp_counts({"A": ["x", "y"], "B": ["z"]}, {"1": ["z"], "2": ["x", "y"], "3": ["q"]})
    assert total == (3, 0, 0, 1) and mapping == {"1": "B", "2": "A"}


def test_normalizer_is_idempotent_and_drops_glosses():
    for raw in ("नमस्कार (hello) दुनिया", "Foo<laugh>bar", "a​b", "it's—ok", "", "फोन(phone)वर", "ÀB"):
        once = text.normalize(raw)
        assert text.normalize(once) == once
    assert text.normalize("नमस्कार (hello) दुनिया") == "नमस्कार दुनिया"
    assert text.normalize("फोन (phone)वर") == "फोनवर" and text.normalize("फोन(phone)-वर आहे") == "फोनवर आहे"


def test_native_normalizer_agrees_without_glosses(spark):
    data = ["Hello, World!", "नमस्कार। दुनिया", "<tag> x​y  z", None, "a b"]
    df = spark.createDataFrame([(x,) for x in data], "t string")
    for r in df.select("t", text.normalized_native(F.col("t")).alias("n")).collect():
        assert r["n"] == text.normalize(r["t"])


def test_dominant_script_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("ab नम",), ("नम ab",), ("é",), ("12",), (None,)], "t string")
    s = df.select(text.dominant_script(F.col("t")).alias("s")).collect()
    assert [r["s"]["script"] for r in s] == ["Latin", "Devanagari", "Latin", "Latin", "Latin"]
    assert [r["s"]["share"] for r in s] == [0.5, 0.5, 1.0, 0.0, 0.0]


def test_fusion_votes_and_passes_one_system_through():
    a = [("x", 0.0, 10.0)]
    assert fusion.fuse([a, [], []], [1, 1, 1], 20) == a
    got = fusion.fuse([a, [("p", 0.0, 5.0)], [("q", 0.0, 4.0), ("r", 12.0, 13.0)]], [1, 1, 1], 20)
    assert got == [("x", 0.0, 5.0)]


def test_lag_profile_finds_the_shift():
    ref, hyp = [(2.0, 4.0), (6.0, 7.0)], [(1.5, 3.5), (5.5, 6.5)]
    p = fusion.lag_profile(ref, hyp, 1000, 100)
    assert int(p.argmax()) - 100 == 50 and p.max() == 1.0
    early = fusion.lag_profile([(-3.0, -2.0), *ref], hyp, 1000, 100)
    assert (early == p).all()


def test_jaccard_error():
    assert fusion.jaccard_error({"A": [(0, 10)]}, {"1": [(0, 5)]}) == pytest.approx(0.5)
    assert fusion.jaccard_error({}, {}) is None


def test_pooling_is_not_a_mean_of_rates(spark):
    df = spark.createDataFrame([("m", 0.0, 10.0), ("m", 500.0, 1000.0)], "model string, err double, total double")
    r = metrics.pooled(df, ["model"], ["err"], "total").first()
    assert r["err_rate"] == pytest.approx(500 / 1010)
    empty = spark.createDataFrame([("m", 0.0, 0.0)], "model string, err double, total double")
    assert metrics.pooled(empty, ["model"], ["err"], "total").count() == 0


def test_bootstrap_holds_the_mean(spark):
    df = spark.range(500).selectExpr("id AS row", "double(id % 7) AS x")
    r = metrics.bootstrap(df, "x", 200, 1).first()
    assert r["low"] < r["mean"] < r["high"] and r["n"] == 500
    assert r == metrics.bootstrap(df, "x", 200, 1).first()


def test_packed_csv_and_rttm(spark, tmp_path):
    csv = tmp_path / "s.csv"
    csv.write_text('youtube_link,video_id,start_sec,end_sec,diarization_segments,asr_segments\nu,v,0.5,10,"A B [0 - 1.5] | | x | C [2 - 2]","[0 - 1.5] hi [there] | [2 - 2] yo"\n')
    df = readers.segments_csv(spark, str(csv))
    assert df.first()["clip_id"] == "v__0_10"
    labels, texts = readers.parsed_labels(df, "clip_id", "diarization_segments"), readers.parsed_texts(df, "clip_id", "asr_segments")
    assert [r["parsed"] for r in labels.orderBy("pos").collect()] == [True, False, True]
    good, bad = readers.zipped(labels, texts, "clip_id")
    assert rows(good) == [("v__0_10", 0, "A B", 0.0, 1.5, "hi [there]")] and bad.count() == 1
    turns = good.select("clip_id", F.lit("sys").alias("system"), F.col("seg_idx").alias("turn_idx"), "speaker", "start", "end")
    writers.write_rttm(turns, str(tmp_path / "out"))
    back = readers.rttm(spark, str(tmp_path / "out/*/*/*.txt"))
    assert rows(back.select("clip_id", "speaker", "start", "end")) == [("v__0_10", "A_B", 0.0, 1.5)]


def test_missing_columns_and_double_keys_raise(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("video_id,start_sec\nv,1\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.segments_csv(spark, str(p))


def test_logs_skip_bad_lines_and_absent_files_are_empty(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert rows(readers.jsonl(spark, str(p), "a long")) == [(1,), (2,)]
    assert readers.json_or_default(spark, str(tmp_path / "none.json"), "a long").count() == 0


def test_guards(spark):
    df = spark.createDataFrame([("v__1_2", 1)], "clip_id string, gt_turns long")
    with pytest.raises(ValueError):
        guards.without_truth(df)
    assert guards.selected(df, ["v"], None, []).count() == 1 and guards.selected(df, ["w"], None, []).count() == 0
    counts = spark.createDataFrame([("a", 3)], "clip_id string, n long")
    side = spark.createDataFrame([("a", 3), ("b", None), ("c", 0)], "clip_id string, n_turns long")
    assert rows(guards.complete(counts, side, ["clip_id"], "n", "n_turns")) == [("a", True), ("b", False), ("c", True)]


def test_streaming_windows(spark, sf, tmp_path):
    from turnwise.streaming import events as ev

    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(str(tmp_path / "in"))
    src = ev.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = ev.windowed(src, "ts", ["event_type"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) FROM w").first()[0] == batch.count()
    finally:
        q.stop()


def plain_distance(u, v):
    row = list(range(len(v) + 1))
    for i, x in enumerate(u, 1):
        new = [i]
        for j, y in enumerate(v, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_of_all_neighbours(spark, sf):
    from turnwise.plans import QUERIES

    w = {r["item_id"]: r["text"].split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {i: plain_distance(w[i], w[i + 1]) for i in w if i + 1 in w}
    assert any(len(w[i]) > 30 for i in want)
    assert {r["ref"]: r["errors"] for r in QUERIES["token_edit_distance"](spark, sf).collect()} == want


def test_banded_distance_against_the_plain_one():
    import random

    from turnwise.functions.align import distance_within

    r = random.Random(2)
    for _ in range(400):
        u = [r.choice("abcd") for _ in range(r.randrange(0, 60))]
        v = [r.choice("abcd") if r.random() < 0.2 else x for x in u if r.random() > 0.1] + ["e"] * r.randrange(0, 4)
        want = plain_distance(u, v)
        for most in (0, 1, want - 1, want, want + 1, 70):
            if most >= 0:
                assert distance_within(u, v, most) == (want if want <= most else None), (u, v, most)


def test_edit_guards_judge_every_document(spark, sf):
    from turnwise.plans import QUERIES

    n = sum(r["n"] for r in QUERIES["edit_guards"](spark, sf).collect())
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_edit_verdict_scripts_growth_and_budget(spark):
    from pyspark.sql import functions as F

    from turnwise.operators import guards

    long = " ".join(f"w{i}" for i in range(100))
    hindi = "नमस्कार दुनिया " * 20
    cases = [
        (long, long.replace("w50", "नमस्ते"), [], "script"),
        (hindi, hindi + "வணக்கம்", [], "new_script"),
        (hindi, hindi, [], "ok"),
        ("a b c", "a b c d e", [], "ok"),  # ceil(1.05 * 3) + 1 = 5
        ("a b c", "a b c d e f", [], "growth"),
        (long, " ".join(f"x{i}" if i < 25 else f"w{i}" for i in range(100)), [], "ok"),
        (long, " ".join(f"x{i}" if i < 26 else f"w{i}" for i in range(100)), [], "unlicensed"),
        (long, " ".join(f"x{i}" if i < 26 else f"w{i}" for i in range(100)), [0], "ok"),
        (long, " ".join(f"x{i}" if i < 26 else f"w{i}" for i in range(100)), [90], "unlicensed"),
    ]
    df = spark.createDataFrame([(i, a, b, p) for i, (a, b, p, _) in enumerate(cases)], "i int, a string, b string, p array<int>")
    got = df.select("i", guards.edit_verdict(F.col("a"), F.col("b"), F.col("p")).alias("v")).orderBy("i").collect()
    # the case of three words and two more exceeds the budget of one change
    assert [r["v"]["reason"] for r in got] == ["unlicensed" if i == 3 else c[3] for i, c in enumerate(cases)]


def test_fused_turns_takes_every_event(spark, sf, monkeypatch):
    from turnwise.plans import text_queries

    monkeypatch.setattr(text_queries.fusion, "fused", lambda t, systems, clips: t)
    assert text_queries.fused_turns(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_token_lookup_of_every_language(spark, sf):
    from turnwise.plans import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").where(r"text rlike '\\S'")
    assert QUERIES["token_lookup"](spark, sf).count() == docs.count() > docs.where("lang = 'en'").count()


def test_bootstrap_interval(spark):
    """Counts are Poisson(1), rows are drawn alike however they are dealt, and the interval is that of the mean."""
    import numpy as np

    from turnwise.operators import metrics

    k = metrics.poisson_counts(np.arange(2000), 500, 7)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and abs((k == 0).mean() - np.exp(-1)) < 0.005
    x = np.random.default_rng(1).normal(3, 2, 1000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(None, 1.0), (5000, None)], "row long, d double")
    one, two = (metrics.bootstrap(d, "d", 2000, 3).first() for d in (df.repartition(1), df.repartition(5)))
    assert np.allclose(one, two) and one["n"] == 1000
    error = x.std() / 1000**0.5
    assert abs(one["low"] - (x.mean() - 1.96 * error)) < 0.3 * error and abs(one["high"] - (x.mean() + 1.96 * error)) < 0.3 * error
