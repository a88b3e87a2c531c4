"""Scores of transcripts for all systems, the floor that turns alone set, and what edits do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import tokens as tk
from turnwise.functions.align import align
from turnwise.operators import fusion
from turnwise.operators import intervals as iv

KEYS = ["system", "clip_id"]


def hypothesis_words(segments: DataFrame, words: DataFrame, turns: DataFrame, strategies: DataFrame, tokens, width) -> DataFrame:
    """system, clip_id, word_idx, token, speaker. Systems of strategy ``segment`` speak for themselves:
    their segments' tokens in order. Of others the words (with times) go to the turn of the system's own
    segmentation that they overlap most."""
    by = strategies.select("system", "strategy")
    own = segments.join(by.where("strategy = 'segment'").select("system"), "system", "left_semi")
    said = tk.word_stream(own, KEYS, "speaker", "start", "seg_idx", tokens).select(*KEYS, "word_idx", "token", "speaker")
    long = words.join(by.where("strategy <> 'segment'").select("system"), "system", "left_semi")
    heard = iv.assign_max_overlap(long, turns, KEYS, width).select(*KEYS, "word_idx", "speaker")
    timed = long.select(*KEYS, "word_idx", F.col("text").alias("token")).join(heard, [*KEYS, "word_idx"])
    return said.unionByName(timed.select(*said.columns))


def score_all(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """From ref (clip_id, word_idx, token, speaker) and hyp (with system): counts for each system and clip
    that it has, those of the speaker-agnostic error (di_cp_) beside them."""
    pairs = hyp.select(*KEYS).distinct()
    side = lambda df, name: df.select(*KEYS, F.lit(name).alias("side"), "word_idx", "token", "speaker")
    stream = side(pairs.join(ref, "clip_id"), "ref").unionByName(side(hyp, "hyp"))
    out = fusion.transcript_scores(stream, KEYS)
    return out.withColumn("di_cp_errors", F.col("substitutions") + F.col("deletions") + F.col("insertions"))


def pooled(scores: DataFrame) -> DataFrame:
    """By system: clips, and rates of summed counts."""
    n = ("substitutions", "deletions", "insertions", "cp_errors", "di_cp_errors", "ref_words", "wrong_speaker", "attributed")
    s = scores.groupBy("system").agg(F.count("*").alias("n_clips"), *(F.sum(c).alias(c) for c in n))
    rate = lambda c: F.try_divide(c, F.col("ref_words"))
    wer = rate(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return s.withColumns({"wer": wer, "cpwer": rate(F.col("cp_errors")), "di_cpwer": rate(F.col("di_cp_errors")), "wder": F.try_divide("wrong_speaker", "attributed")})


def oracle_floor(segments: DataFrame, turns: DataFrame, tokens: str, width) -> DataFrame:
    """Counts of a system that has every word right and its speakers from ``turns`` (system, clip_id, ...):
    the reference's words, spread over their segments, go to the turn that they overlap most."""
    systems = turns.select("system", "clip_id").distinct()
    timed = iv.unrolled(segments, tokens)
    number = F.row_number().over(Window.partitionBy("clip_id").orderBy("start", "seg_idx", "pos")) - 1
    words = timed.select("clip_id", "speaker", "token", F.col("t_start").alias("start"), F.col("t_end").alias("end"), number.cast("long").alias("word_idx"))
    asked = systems.join(words.drop("speaker"), "clip_id")
    heard = iv.assign_max_overlap(asked.select(*KEYS, "word_idx", "start", "end"), turns, KEYS, width)
    hyp = asked.select(*KEYS, "word_idx", "token").join(heard.select(*KEYS, "word_idx", "speaker"), [*KEYS, "word_idx"])
    return score_all(words.select("clip_id", "word_idx", "token", "speaker"), hyp)


def edit_effects(ref: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, n_changed, helpful, harmful, neutral: each changed place of the hypothesis by whether its word
    was right, aligned with the reference, before and after. All are (keys, word_idx, token); a clip whose
    hypotheses differ in length raises, since its places cannot be told."""
    parts = [df.select(*keys, F.lit(s).alias("side"), "word_idx", "token") for s, df in (("ref", ref), ("before", before), ("after", after))]
    stream = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["n", "n_changed", "helpful", "harmful", "neutral"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_idx")
        said, old, new = (pdf.loc[pdf["side"] == s, "token"].tolist() for s in ("ref", "before", "after"))
        if len(old) != len(new):
            raise ValueError(f"{key}: {len(old)} words before and {len(new)} after")
        right = [{j for op, _, j in align(said, words) if op == "C"} for words in (old, new)]
        changed = [j for j, (x, y) in enumerate(zip(old, new)) if x != y]
        gain = [(j in right[1]) - (j in right[0]) for j in changed]
        counts = (len(old), len(changed), gain.count(1), gain.count(-1), gain.count(0))
        return pd.DataFrame([(*key, *counts)], columns=[*keys, *names])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema if f.name in keys)
    return stream.groupBy(*keys).applyInPandas(one, ", ".join([types, *(f"{n} long" for n in names)]))


def ops_by_overlap(ops: DataFrame, words: DataFrame, turns: DataFrame, keys: list[str], width) -> DataFrame:
    """Counts of operations by whether one speaker or several speak in the middle of the reference word
    (words: keys, word_idx, start, end; turns: the reference's)."""
    at = words.select(*keys, "word_idx", ((F.col("start") + F.col("end")) / 2).alias("at"))
    live = iv.active_at(at, turns, keys, width, "at", "speaker").select(*keys, "at", F.size("labels").alias("n")).distinct()
    region = F.when(F.coalesce("n", F.lit(0)) > 1, "overlap").otherwise("clean")
    regions = at.join(live, [*keys, "at"], "left").select(*keys, "word_idx", region.alias("region"))
    return fusion.ops_by_region(ops, regions, keys, "region")
