"""Scores, rankings, guards and text checks on inline rows with the results that they must have."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.operators import fusion, guards, qc, scoring, transcripts
from turnwise.operators import intervals as iv
from turnwise.plans.registry import query, values

WIDTH = 10.0


def inline(spark, columns: str, rows: list[tuple]):
    return spark.createDataFrame(rows, columns)


def rounded(df, digits: int = 9):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# a reference of two speakers, and systems that are right, find one speaker, and hear one throughout
REF = [("c1", "A", 0.0, 10.0), ("c1", "A", 20.0, 30.0), ("c1", "B", 5.0, 15.0)]
HYP = [
    ("m1", "c1", "x", 0.0, 10.0), ("m1", "c1", "x", 20.0, 30.0), ("m1", "c1", "y", 5.0, 15.0),
    ("m2", "c1", "z", 0.0, 12.0), ("m2", "c1", "z", 20.0, 25.0), ("m3", "c1", "w", 0.0, 30.0),
]
TURN = "clip_id string, speaker string, start double, end double"


SCORES = (
    "model VARCHAR, clip_id VARCHAR, miss DOUBLE, fa DOUBLE, confusion DOUBLE, correct DOUBLE, total DOUBLE, der DOUBLE, jer DOUBLE, n_ref BIGINT, n_hyp BIGINT, "
    "count_error BIGINT, count_correct INT, lenient_miss DOUBLE, lenient_fa DOUBLE, lenient_confusion DOUBLE, lenient_correct DOUBLE, lenient_total DOUBLE, "
    "lenient_der DOUBLE, overlap_der DOUBLE, overlap_total DOUBLE, single_der DOUBLE, single_total DOUBLE"
)
#: What they score.
SCORED = [
    ("m1", "c1", 0.0, 0.0, 0.0, 30.0, 30.0, 0.0, 0.0, 2, 2, 0, 1, 0.0, 0.0, 0.0, 18.5, 18.5, 0.0, 0.0, 10.0, 0.0, 20.0),
    ("m2", "c1", 13.0, 0.0, 2.0, 15.0, 30.0, 0.5, 0.659090909, 2, 1, -1, 0, 7.5, 0.0, 1.75, 9.25, 18.5, 0.5, 0.5, 10.0, 0.5, 20.0),
    ("m3", "c1", 5.0, 5.0, 5.0, 20.0, 30.0, 0.5, 0.666666667, 2, 1, -1, 0, 0.0, 4.5, 4.5, 14.0, 18.5, 0.486486486, 0.5, 10.0, 0.25, 20.0),
]


@query(values(SCORES, SCORED))
def score_all(spark, d):
    ref, hyp = inline(spark, TURN, REF), inline(spark, f"model string, {TURN}", HYP)
    return rounded(scoring.score_all(ref, hyp, inline(spark, "clip_id string, start double, end double", [("c1", 0.0, 30.0)]), WIDTH))


def _scores(spark):
    return inline(spark, SCORES.replace("VARCHAR", "string"), SCORED)


@query(values("ranking VARCHAR, rank INT, model VARCHAR, clip_id VARCHAR, value DOUBLE", [
    ("der", 1, "m2", "c1", 0.5), ("der", 2, "m3", "c1", 0.5), ("jer", 1, "m3", "c1", 0.666666667), ("jer", 2, "m2", "c1", 0.659090909),
    ("confusion", 1, "m3", "c1", 5), ("confusion", 2, "m2", "c1", 2), ("miss", 1, "m2", "c1", 13), ("miss", 2, "m3", "c1", 5),
    ("fa", 1, "m3", "c1", 5), ("fa", 2, "m1", "c1", 0), ("overlap_der", 1, "m2", "c1", 0.5), ("overlap_der", 2, "m3", "c1", 0.5),
    ("abs_count_error", 1, "m2", "c1", 1), ("abs_count_error", 2, "m3", "c1", 1), ("error_share", 1, "m2", "c1", 1), ("error_share", 2, "m3", "c1", 1),
]))
def worst_clips(spark, d):
    return rounded(scoring.worst(_scores(spark), 2))


@query(values(
    "model VARCHAR, der DOUBLE, miss_percent DOUBLE, fa_percent DOUBLE, confusion_percent DOUBLE, overlap_der DOUBLE, single_der DOUBLE, clips_miss BIGINT, clips_fa BIGINT, clips_confusion BIGINT",
    [("m1", 0, None, None, None, 0, 0, 0, 0, 0), ("m2", 0.5, 86.666667, 0, 13.333333, 0.5, 0.5, 1, 0, 0), ("m3", 0.5, 33.333333, 33.333333, 33.333333, 0.5, 0.25, 1, 0, 0)],
))
def error_composition(spark, d):
    return rounded(scoring.composition(_scores(spark)), 6)


@query(values("model VARCHAR, der DOUBLE, der_oracle DOUBLE, cost DOUBLE", [("m1", 0, 0.5, -0.5), ("m2", 0.5, 0.5, 0)]))
def oracle_gap(spark, d):
    """The cost of not knowing; the second run lacks m3, and m1 does worse in it."""
    pooled = scoring.pooled_scores(_scores(spark))
    other = F.when(F.col("model") == "m3", "m1").when(F.col("model") == "m2", "m2")
    return rounded(scoring.oracle_gap(pooled, pooled.withColumn("model", other).where("model is not null")))


@query(values("label VARCHAR, target VARCHAR, amount DOUBLE", [("z", "A", 15), ("z", "B", 7), ("w", "A", 20), ("w", "B", 10), ("x", "A", 20), ("x", "B", 5), ("y", "A", 5), ("y", "B", 10)]))
def overlap_matrix(spark, d):
    ref = inline(spark, TURN, REF)
    hyp = inline(spark, f"model string, {TURN}", HYP).drop("model")
    return scoring.overlap_matrix(ref, hyp, ["clip_id"], WIDTH).drop("clip_id")


@query(values("part VARCHAR, integral DOUBLE, told DOUBLE", [("fa", 5, 4)]))
def region_check(spark, d):
    """The regions of the third system against scores that tell one second less of false alarms."""
    hyp = inline(spark, f"model string, {TURN}", HYP).where("model = 'm3'").drop("model").withColumn("speaker", F.lit("A"))
    regions = iv.error_regions(inline(spark, TURN, REF), hyp, ["clip_id"])
    told = _scores(spark).where("model = 'm3'").withColumn("fa", F.col("fa") - 1)
    return scoring.disagreements(regions, told, ["clip_id"]).drop("clip_id")


@query(values("clip_id VARCHAR, n INT, miss INT", [("a", 0, 0), ("b", 4, 1)]))
def role_residual(spark, d):
    regions = inline(spark, "clip_id string, n int, miss int", [("a", 2, 1), ("b", 4, 1)])
    roles = inline(spark, "clip_id string, n int, miss int", [("a", 1, 1), ("a", 2, 0)])
    return scoring.residual(regions, roles, ["clip_id"], ["n", "miss"]).select("clip_id", F.col("n").cast("int").alias("n"), F.col("miss").cast("int").alias("miss"))


@query(values("kind VARCHAR, audited BIGINT, right BIGINT, precision DOUBLE", [("gap", 2, 1, 0.5), ("turn", 0, 0, None)]))
def detector_precision(spark, d):
    rows = inline(spark, "kind string, verdict string", [("gap", "yes"), ("gap", "no"), ("gap", " "), ("turn", None)])
    return scoring.precision(rows, "verdict", "yes", ["kind"])


# transcripts: a system that has its own segments, one whose words are given to turns, and the floor of those turns
SEGMENT = "clip_id string, seg_idx long, speaker string, start double, end double, text string"
SAID = [("c1", 0, "A", 0.0, 3.0, "a b c"), ("c1", 1, "B", 3.0, 5.0, "d e")]
COUNTS = "hits BIGINT, substitutions BIGINT, deletions BIGINT, insertions BIGINT, cp_errors BIGINT, ref_words BIGINT, wrong_speaker BIGINT, attributed BIGINT, di_cp_errors BIGINT"


def _ref_words(spark):
    rows = [("c1", i, w, "A" if i < 3 else "B") for i, w in enumerate("abcde")]
    return inline(spark, "clip_id string, word_idx long, token string, speaker string", rows)


def _turns(spark):
    return inline(spark, f"system string, turn_idx long, {TURN}", [("s2", 0, "c1", "p", 0.0, 2.0), ("s2", 1, "c1", "q", 2.0, 5.0)])


@query(values(f"system VARCHAR, clip_id VARCHAR, {COUNTS}", [("s1", "c1", 4, 1, 0, 0, 1, 5, 0, 5, 1), ("s2", "c1", 4, 0, 1, 0, 3, 5, 1, 4, 1)]))
def transcript_score_all(spark, d):
    segments = inline(spark, f"system string, {SEGMENT}", [("s1", "c1", 0, "x", 0.0, 3.0, "a b c"), ("s1", "c1", 1, "y", 3.0, 5.0, "d f")])
    words = inline(spark, "system string, clip_id string, word_idx long, text string, start double, end double", [("s2", "c1", i, w, float(i), i + 1.0) for i, w in enumerate("abcd")])
    by = inline(spark, "system string, strategy string", [("s1", "segment"), ("s2", "longform")])
    hyp = transcripts.hypothesis_words(segments, words, _turns(spark), by, tx.tokens(F.col("text")), WIDTH)
    return transcripts.score_all(_ref_words(spark), hyp)


@query(values(f"system VARCHAR, clip_id VARCHAR, {COUNTS}", [("s2", "c1", 5, 0, 0, 0, 2, 5, 1, 5, 0)]))
def oracle_floor(spark, d):
    segments = inline(spark, SEGMENT, SAID).withColumn("tokens", tx.tokens(F.col("text")))
    return transcripts.oracle_floor(segments, _turns(spark), "tokens", WIDTH)


@query(values("clip_id VARCHAR, n BIGINT, n_changed BIGINT, helpful BIGINT, harmful BIGINT, neutral BIGINT", [("c1", 4, 3, 1, 1, 1), ("c2", 2, 0, 0, 0, 0)]))
def edit_effects(spark, d):
    table = lambda texts: inline(spark, "clip_id string, word_idx long, token string", [(c, i, w) for c, t in texts for i, w in enumerate(t.split())])
    return transcripts.edit_effects(table([("c1", "a b c d"), ("c2", "u v")]), table([("c1", "a x c y"), ("c2", "u w")]), table([("c1", "a b z q"), ("c2", "u w")]), ["clip_id"])


@query(values("region VARCHAR, C BIGINT, S BIGINT, D BIGINT, error_rate DOUBLE", [("clean", 1, 1, 0, 0.5), ("overlap", 1, 0, 1, 0.5)]))
def ops_by_overlap(spark, d):
    words = inline(spark, "clip_id string, word_idx long, start double, end double", [("c1", i, i + 0.0, i + 1.0) for i in range(4)])
    turns = inline(spark, TURN, [("c1", "A", 0.0, 3.0), ("c1", "B", 1.0, 3.0)])
    ops = inline(spark, "clip_id string, op string, i long, j long", [("c1", "C", 0, 0), ("c1", "C", 1, 1), ("c1", "D", 2, None), ("c1", "S", 3, 2)])
    return transcripts.ops_by_overlap(ops, words, turns, ["clip_id"], WIDTH)


@query(values("clip_id VARCHAR, speaker VARCHAR, start DOUBLE, end DOUBLE, way VARCHAR", [
    ("c1", "a", 0, 10, "majority"), ("c1", "a", 0, 10, "overlap"), ("c1", "b", 4, 10, "overlap"), ("c1", "a", 0, 10, "rank"),
]))
def fusion_options(spark, d):
    """Three systems, of which one hears a second speaker: by majority, with a lower bar for further speakers,
    and weighted by rank of agreement."""
    rows = [("c1", s, i, "a", 0.0, 10.0) for i, s in enumerate(("s0", "s1", "s2"))] + [("c1", "s0", 9, "b", 4.0, 10.0)]
    t = inline(spark, "clip_id string, system string, turn_idx long, speaker string, start double, end double", rows)
    clips = inline(spark, "clip_id string, duration double", [("c1", 10.0)])
    ways = {"majority": {}, "overlap": {"overlap_threshold": 0.3}, "rank": {"rank_weighted": True, "threshold": 0.6}}
    parts = [fusion.fused(t, ["s0", "s1", "s2"], clips, **o).select("clip_id", "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.lit(w).alias("way")) for w, o in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(values("clip_id VARCHAR, chunk INT, own_start DOUBLE, own_end DOUBLE, start DOUBLE, end DOUBLE, n_kept BIGINT", [("c1", 0, 0, 28, 0, 29, 2), ("c1", 1, 28, 56, 27, 57, 1), ("c1", 2, 56, 60, 55, 60, 0)]))
def padded_chunks(spark, d):
    grid = iv.padded_grid(inline(spark, "clip_id string, duration double", [("c1", 60.0), ("c2", 0.0)]), 28.0, 1.0)
    words = inline(spark, "clip_id string, chunk int, start double, end double", [("c1", 0, 1.0, 2.0), ("c1", 0, 27.9, 28.4), ("c1", 0, 28.0, 28.5), ("c1", 1, 27.9, 28.4), ("c1", 1, 28.0, 28.5), ("c1", 2, 55.0, 56.5)])
    n = iv.kept_of_chunks(words, grid, ["clip_id"]).groupBy("clip_id", "chunk").agg(F.count("*").alias("n_kept"))
    return grid.drop("duration").join(n, ["clip_id", "chunk"], "left").na.fill(0, ["n_kept"])


@query(values("clip_id VARCHAR, peak_lag DOUBLE, spread DOUBLE, n_models BIGINT, agreed BOOLEAN", [("a", 1.25, 0.5, 2, "true"), ("b", 0, 3, 2, "false")]))
def lags_over_models(spark, d):
    rows = [("m1", "a", 1.0), ("m2", "a", 1.5), ("m1", "b", -1.5), ("m2", "b", 1.5)]
    p = inline(spark, "model string, clip_id string, peak_lag double", rows).withColumns({c: F.lit(0.5) for c in ("peak_iou", "zero_iou", "margin")})
    return qc.over_models(p).select("clip_id", "peak_lag", "spread", "n_models", "agreed")


# text ------------------------------------------------------------------------------------------------------

#: Hard cases of the normalizer, each beside what is spoken.
GLOSSED = [
    ("आणि तुमचं सगळ्यांचं कॉफी(coffee) क्रिकेट(cricket) आणि बरंच काही", "आणि तुमचं सगळ्यांचं कॉफी क्रिकेट आणि बरंच काही"),
    ("चॅनल(channel)-वरचा पहिला आपला पाहुणा", "चॅनलवरचा पहिला आपला पाहुणा"),
    ("ସେକ୍ସନରେ(section)-ରେ ଯାଉଛି", "ସେକ୍ସନରେ ଯାଉଛି"),
    ("आठ(8)-नऊ(9) वर्षांनी", "आठ नऊ वर्षांनी"),
    ("एक(1) सीसीबीके(CCBK) स्पेशल(special)-चा भाग", "एक सीसीबीके स्पेशलचा भाग"),
    ("ஹாய் (hi) ஹலோ (hello) அண்ட் (and) வெல்கம் (welcome)", "ஹாய் ஹலோ அண்ட் வெல்கம்"),
    ("தேங்க்யூ [thankyou] அண்ட்[and] உங்களோட சப்ஸ்கிரைபர்ஸ்[subscribers]-ஓட", "தேங்க்யூ அண்ட் உங்களோட சப்ஸ்கிரைபர்ஸ்ஓட"),
    ("ये लैपटॉप {laptop} में कुछ प्रॉब्लम {problem} है।", "ये लैपटॉप में कुछ प्रॉब्लम है"),
    ("ଆଦିତ୍ୟ ସେ ଷ୍ଟାରଡମ୍ ((Stardom)) ଫିଲିଙ୍ଗ୍ (Feeling) ହେଲାଣି", "ଆଦିତ୍ୟ ସେ ଷ୍ଟାରଡମ୍ ଫିଲିଙ୍ଗ୍ ହେଲାଣି"),
    ("ସବୁ ପ୍ରକାର ଆପଣଙ୍କର ଫାସିଲିଟିଜ((facilities) ଅଛି", "ସବୁ ପ୍ରକାର ଆପଣଙ୍କର ଫାସିଲିଟିଜ ଅଛି"),
    ("நான் சென்னையை வந்தேன் <laughter> ரொம்ப நல்லா", "நான் சென்னையை வந்தேன் ரொம்ப நல்லா"),
    ("ஷோக்கு(show)-க்கு போயிட்டு", "ஷோக்கு போயிட்டு"),
    ("<unintelligible>", ""),
    ("ਮੇਲੇ ਵਾਲੇ ਦਿਨ ਪਕੋੜੇ ਬਣਾਏ।", "ਮੇਲੇ ਵਾਲੇ ਦਿਨ ਪਕੋੜੇ ਬਣਾਏ"),
    ("વિઘે 15 મણ જીરું ની ફોરમુલ્યા?", "વિઘે 15 મણ જીરું ની ફોરમુલ્યા"),
    ("चॅनल(channel)-वर।", "चॅनलवर"),
    (None, ""),
]


def _glossed(spark):
    return inline(spark, "id int, text string", [(i, t) for i, (t, _) in enumerate(GLOSSED)])


@query(values("id INT, norm VARCHAR", [(i, t) for i, (_, t) in enumerate(GLOSSED)]))
def normalize_with_glosses(spark, d):
    return _glossed(spark).select("id", tx.normalized(F.col("text")).alias("norm"))


@query(values(
    "total BIGINT, speech BIGINT, raw BIGINT, gloss_kept BIGINT, final BIGINT, residual_latin BIGINT, removed BIGINT, gloss_share DOUBLE, residual_share DOUBLE",
    [(4, 3, 8, 10, 6, 1, 4, 0.4, 0.166667)],
))
def normalization_report(spark, d):
    texts = ["चॅनल(channel)-वर आहे", "ஹாய் (hi) <laughter> ok", "आठ(8) दिन", "<unintelligible>"]
    return tx.normalization_report(inline(spark, "text string", [(t,) for t in texts]))


@query(values("id INT, round BIGINT, square BIGINT, curly BIGINT, joined BIGINT, glosses BIGINT, unbalanced BIGINT", [
    (0, 2, 0, 0, 0, 2, 0), (1, 1, 0, 0, 1, 1, 0), (2, 1, 0, 0, 1, 1, 0), (3, 2, 0, 0, 1, 2, 0), (4, 3, 0, 0, 1, 3, 0), (5, 4, 0, 0, 0, 4, 0), (6, 0, 3, 0, 1, 3, 0),
    (7, 0, 0, 2, 0, 2, 0), (8, 2, 0, 0, 0, 2, 0), (9, 1, 0, 0, 0, 1, 1), (10, 0, 0, 0, 0, 0, 0), (11, 1, 0, 0, 1, 1, 0), (12, 0, 0, 0, 0, 0, 0), (13, 0, 0, 0, 0, 0, 0),
    (14, 0, 0, 0, 0, 0, 0), (15, 1, 0, 0, 1, 1, 0), (16, 0, 0, 0, 0, 0, 0),
]))
def gloss_counters(spark, d):
    return _glossed(spark).select("id", tx.gloss_counters(F.col("text")).alias("x")).select("id", "x.*")


@query(values("id INT, language VARCHAR", [(0, "ta"), (1, "mr"), (2, "hi"), (3, "hi"), (4, "hi")]))
def function_word_language(spark, d):
    rows = [(0, "ta", "आणि आहे"), (1, "hi_or_mr", "मी आणि तो आहे"), (2, "hi_or_mr", "और मैं आहे"), (3, "hi_or_mr", "मी मैं"), (4, "", "आणि आहे")]
    t = inline(spark, "id int, hint string, text string", rows)
    return t.select("id", tx.language_by_words(tx.tokens(F.col("text")), F.col("hint")).alias("language"))


@query(values("id INT, editable BOOLEAN", [(0, "true"), (1, "false"), (2, "false"), (3, "false"), (4, "true")]))
def editable_segments(spark, d):
    rows = [(0, "a", None), (1, " \n", None), (2, None, None), (3, "a", "too short"), (4, "a", "")]
    t = inline(spark, "id int, text string, skipped string", rows)
    return t.select("id", tx.is_editable(F.col("text"), F.col("skipped")).alias("editable"))


# guards ----------------------------------------------------------------------------------------------------


#: before, after, licensed places, what is to come of it
EDITS = [
    ("नमस्कार दुनिया आज", "नमस्कार दुनिया आज", [], "ok"), ("नमस्कार दुनिया", "", [], "empty"), ("नमस्कार दुनिया आज", "வணக்கம் உலகம் இன்று", [], "script"),
    ("नमस्कार दुनिया आज", "नमस्कार दुनिया today", [], "latin"), ("एक दो", "एक दो तीन चार पाँच", [], "growth"), ("एक दो तीन", "एक दो তিন", [], "new_script"),
    ("एक दो तीन चार पाँच छह सात आठ", "एक दो तीन चार पाँच छह साथ आठवाँ", [], "ok"), ("एक दो तीन चार पाँच छह सात आठ", "एक दो तीन चार पाँच छः साथ आठवाँ", [], "unlicensed"),
    ("एक दो तीन चार पाँच छह सात आठ", "एक दो तीन चार पाँच छः साथ आठवाँ", [5], "ok"),
]


@query(values("id INT, reason VARCHAR", [(i, r) for i, (*_, r) in enumerate(EDITS)]))
def edit_rules(spark, d):
    t = inline(spark, "id int, before string, after string, free array<int>", [(i, a, b, f) for i, (a, b, f, _) in enumerate(EDITS)])
    return t.select("id", guards.edit_verdict(F.col("before"), F.col("after"), F.col("free"))["reason"].alias("reason"))


@query(values("word VARCHAR, verdict VARCHAR", [
    ("coffee", "accepted"), ("ok", "abstained_or_null"), ("tea", "abstained_or_null"), ("new york", "multi_word"), ("nine", "contains_digit"),
    ("hi", "still_latin"), ("party", "wrong_script"), ("कॉफी", "unchanged"),
]))
def mapping_rules(spark, d):
    rows = [("coffee", " कॉफी "), ("ok", None), ("tea", " "), ("new york", "न्यू यॉर्क"), ("nine", "९"), ("hi", "hello"), ("party", "పార్టీ"), ("कॉफी", "कॉफी")]
    t = inline(spark, "word string, value string", rows).withColumn("script", F.lit("Devanagari"))
    return guards.mapping_verdicts(t).select("word", "verdict")


@query(values("window INT, idx INT, applied BOOLEAN", [(0, 0, "true"), (0, 1, "false"), (0, 2, "true"), (0, 3, "true"), (1, 0, "false"), (1, 1, "false"), (1, 2, "false"), (1, 3, "false")]))
def trusted_windows(spark, d):
    rows = [("c", 0, 0, True), ("c", 0, 1, False), ("c", 0, 2, True), ("c", 0, 3, True), ("c", 1, 0, True), ("c", 1, 1, False), ("c", 1, 2, False), ("c", 1, 3, True)]
    return guards.windows_kept(inline(spark, "clip_id string, window int, idx int, ok boolean", rows), ["clip_id"]).select("window", "idx", "applied")


@query(values("idx INT, said VARCHAR", [(0, "a b c"), (1, "b c d"), (2, "x")]))
def double_deletions(spark, d):
    rows = [("c", 0, "a b c", "a"), ("c", 1, "b c d", "d"), ("c", 2, "x y", "x")]
    t = inline(spark, "clip_id string, idx int, before string, after string", rows).withColumns({c: F.split(c, " ") for c in ("before", "after")})
    pairs = inline(spark, "clip_id string, a int, b int", [("c", 0, 1)])
    return guards.without_double_deletions(t, pairs, ["clip_id"]).select("idx", F.array_join("final", " ").alias("said"))


@query(values("window INT, core VARCHAR, visible VARCHAR, split VARCHAR", [
    (0, "0,1,2,3", "0,1,2,3,4,5,7", ""), (1, "4,5,6", "0,3,4,5,6,7", ""), (2, "7", "1,6,7", ""),
]))
def edit_windows(spark, d):
    """Cores of three to four, one neighbour for context. Segment 3 overlaps 2 and so joins the first core;
    7 overlaps 1, and 0 overlaps 5, so each is seen with the other: no pair is split."""
    seg = inline(spark, "clip_id string, idx long, start double, end double", [("c", i, float(i), i + 0.5) for i in range(8)])
    pairs = inline(spark, "clip_id string, a long, b long", [("c", 2, 3), ("c", 1, 7), ("c", 0, 5)])
    out = guards.windows(seg, pairs, core=3, most=4, context=1)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    split = F.array_join(F.transform("split_pairs", lambda p: F.concat(p["a"].cast("string"), F.lit("-"), p["b"].cast("string"))), ",")
    return out.select("window", text("core").alias("core"), text("visible").alias("visible"), split.alias("split"))


@query(values("clip_id VARCHAR", [("b",)]))
def retry_list(spark, d):
    results = inline(spark, "clip_id string, status string, permanent boolean", [("a", "ok", None), ("b", "failed", None), ("c", "failed", True)])
    return guards.retryable(inline(spark, "clip_id string", [("a",), ("b",), ("c",), ("d",)]), results, ["clip_id"])


@query(values("clip_id VARCHAR, bytes BIGINT, state VARCHAR", [("a", 5, "present"), ("b", 0, "empty"), ("c", None, "missing"), ("d", 7, "unexpected")]))
def file_inventory(spark, d):
    files = inline(spark, "clip_id string, bytes long", [("a", 5), ("b", 0), ("d", 7)])
    return guards.inventory(inline(spark, "clip_id string", [("a",), ("b",), ("c",)]), files)


@query(values("error VARCHAR, client VARCHAR, n BIGINT", [("gone", "web", 2), ("gone", "app", 1), ("other", "web", 1)]))
def failures_by_client(spark, d):
    rows = inline(spark, "error string, client string", [("gone", "web"), ("gone", "web"), ("gone", "app"), ("other", "web")])
    return rows.groupBy("error", "client").agg(F.count("*").alias("n"))
