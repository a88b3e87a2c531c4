"""Writers: RTTM, CSV, logs and per-clip JSON. Spark's commit protocol publishes a job's files at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import safe_label


def rttm_line(clip: Column, start: Column, end: Column, speaker: Column) -> Column:
    """With three decimals as Python rounds them."""

    @F.pandas_udf("string")
    def run(c: pd.Series, s: pd.Series, d: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([f"SPEAKER {a} 1 {b:.3f} {x:.3f} <NA> <NA> {y} <NA> <NA>" for a, b, x, y in zip(c, s, d, p)])

    return run(clip, start, end - start, safe_label(speaker))


def write_rttm(turns: DataFrame, path: str) -> None:
    """A folder for each system and clip, the lines of a clip in order."""
    line = rttm_line(F.col("clip_id"), F.col("start"), F.col("end"), F.col("speaker"))
    rows = turns.select("system", F.col("clip_id").alias("clip"), "start", "speaker", line.alias("value"))
    rows = rows.repartition("system", "clip").sortWithinPartitions("system", "clip", "start", "speaker")
    rows.select("system", "clip", "value").write.partitionBy("system", "clip").mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def clip_documents(regions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One JSON text for each key: its rows in order."""
    fields = [c for c in regions.columns if c not in keys]
    row = F.struct(*order, *(c for c in fields if c not in order))
    return regions.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("document"))


def adopt_rttm(turns: DataFrame, path: str, system: str, source: str) -> DataFrame:
    """Turns of files from elsewhere, written as a system's own with a sidecar for each clip: status, numbers
    of turns and speakers, the last end, and where they came from. Returns the sidecars."""
    own = turns.withColumn("system", F.lit(system))
    write_rttm(own, f"{path}/rttm")
    side = own.groupBy("clip_id").agg(F.count("*").alias("n_turns"), F.countDistinct("speaker").alias("n_speakers_hyp"), F.max("end").alias("max_end"))
    side = side.select(F.lit(system).alias("model"), "clip_id", F.lit("ok").alias("status"), F.lit(False).alias("oracle"), "n_turns", "n_speakers_hyp", "max_end", F.lit(source).alias("imported_from"))
    side.write.mode("overwrite").json(f"{path}/sidecars")
    return side.sparkSession.read.schema(side.schema).json(f"{path}/sidecars")


def write_export(regions: DataFrame, scores: DataFrame, keys: list[str], order: list[str], path: str, disagreements: DataFrame) -> None:
    """One JSON document for each key, an index of keys with their scores, and what the check of regions
    against scores found wrong: nothing, or it raises before anything is written."""
    wrong = disagreements.limit(5).collect()
    if wrong:
        raise ValueError(f"regions do not add up to the scores: {wrong}")
    docs = clip_documents(regions, keys, order)
    docs.write.mode("overwrite").json(f"{path}/clips")
    index = scores.join(docs.select(*keys, F.length("document").alias("n_chars")), keys, "left")
    index.withColumn("verified", F.lit(True)).write.mode("overwrite").json(f"{path}/index")
