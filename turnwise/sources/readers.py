"""Readers: packed CSV, RTTM, JSON payloads, sidecars and logs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise import schemas

_SPAN = r"\[\s*([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)\s*\]"
LABEL_PIECE = rf"^(.*?)\s*{_SPAN}$"
TEXT_PIECE = rf"(?s)^{_SPAN}\s*(.*)$"


def clip_id(video: Column, start: Column, end: Column) -> Column:
    """Halves are rounded to even."""
    return F.concat(video, F.lit("__"), F.bround(start).cast("long").cast("string"), F.lit("_"), F.bround(end).cast("long").cast("string"))


def segments_csv(spark: SparkSession, path: str) -> DataFrame:
    """The packed ground-truth table. Columns are taken by name; missing ones and double keys raise."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    wanted = spark.createDataFrame([], schemas.SEGMENT_CSV).schema
    missing = [f.name for f in wanted if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    df = raw.select(*(F.col(f.name).cast(f.dataType) for f in wanted))
    df = df.withColumn("clip_id", clip_id(F.col("video_id"), F.col("start_sec"), F.col("end_sec")))
    double = df.groupBy("clip_id").count().where("count > 1").limit(5).collect()
    if double:
        raise ValueError(f"clip_id is not unique: {', '.join(r[0] for r in double)}")
    return df


def pieces(df: DataFrame, key: str, packed: str) -> DataFrame:
    """key, pos, piece: the trimmed, not empty pieces of a pipe-packed column."""
    p = df.select(key, F.posexplode(F.split(F.coalesce(packed, F.lit("")), r"\|")).alias("raw_pos", "piece"))
    p = p.withColumn("piece", F.trim("piece")).where("piece <> ''")
    return p.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("raw_pos")) - 1).alias("pos"), "piece")


def parsed_labels(df: DataFrame, key: str, packed: str) -> DataFrame:
    """speaker, start, end of ``name [a - b]`` pieces; parsed says whether a piece has that form."""
    p = pieces(df, key, packed).withColumn("parsed", F.col("piece").rlike(LABEL_PIECE))
    part = lambda i: F.when(F.col("parsed"), F.regexp_extract("piece", LABEL_PIECE, i))
    return p.select(key, "pos", "piece", "parsed", part(1).alias("speaker"), part(2).cast("double").alias("start"), part(3).cast("double").alias("end"))


def parsed_texts(df: DataFrame, key: str, packed: str) -> DataFrame:
    """start, end, text of ``[a - b] text`` pieces; brackets later in a text are text."""
    p = pieces(df, key, packed).withColumn("parsed", F.col("piece").rlike(TEXT_PIECE))
    part = lambda i: F.when(F.col("parsed"), F.regexp_extract("piece", TEXT_PIECE, i))
    return p.select(key, "pos", "piece", "parsed", part(1).cast("double").alias("start"), part(2).cast("double").alias("end"), part(3).alias("text"))


def zipped(labels: DataFrame, texts: DataFrame, key: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(segments, bad segments): the parsed pieces of both lists by position among the parsed.

    A clip whose lists differ in length raises if strict, else is cut to the shorter. Segments that end
    where they begin or before are bad."""
    w = Window.partitionBy(key).orderBy("pos")
    number = lambda df: df.where("parsed").withColumn("seg_idx", (F.row_number().over(w) - 1).cast("long"))
    a, b = number(labels), number(texts).select(F.col(key), "seg_idx", "text")
    if strict:
        na, nb = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb")))
        odd = na.join(nb, key, "full").where("not (na <=> nb)").limit(5).collect()
        if odd:
            raise ValueError(f"labels and texts differ in number: {', '.join(str(r[key]) for r in odd)}")
    both = a.join(b, [key, "seg_idx"]).select(key, "seg_idx", "speaker", "start", "end", "text")
    bad = both.where("end <= start").withColumn("reason", F.lit("end <= start"))
    return both.where("end > start"), bad


def rttm(spark: SparkSession, path: str, system_from: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Turns of RTTM files, in the order of their lines; the system is the folder's name.

    Whole files are read, since only that keeps line numbers; lines of under eight fields or of another
    kind are skipped. Ends are rounded to six decimals."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select("file", "line", f.alias("f")).where((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    at = lambda i: F.get("f", F.lit(i))
    start, dur = at(3).cast("double"), at(4).cast("double")
    w = Window.partitionBy("file").orderBy("line")
    return rows.select(
        at(1).alias("clip_id"), F.regexp_extract("file", system_from, 1).alias("system"), (F.row_number().over(w) - 1).cast("long").alias("turn_idx"),
        at(7).alias("speaker"), start.alias("start"), F.round(start + dur, 6).alias("end"),
    )


def asr_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row for each payload of either strategy; absent fields are null, a corrupt file is dropped."""
    return spark.read.json(path, schema=schemas.ASR_PAYLOAD, multiLine=True, mode="DROPMALFORMED")


def payload_words(payloads: DataFrame) -> DataFrame:
    p = payloads.select("clip_id", "system", F.posexplode("words").alias("word_idx", "w"))
    return p.select("clip_id", "system", F.col("word_idx").cast("long"), F.col("w.t").alias("text"), F.col("w.s").alias("start"), F.col("w.e").alias("end"))


def payload_segments(payloads: DataFrame) -> DataFrame:
    p = payloads.select("clip_id", "system", F.posexplode("segments").alias("seg_idx", "x"))
    return p.select("clip_id", "system", F.col("seg_idx").cast("long"), "x.speaker", "x.start", "x.end", "x.text", "x.skipped", "x.lang")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.SIDECAR, multiLine=True)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one object a line; lines that are none are skipped."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def json_or_default(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One file's rows; none if it is absent or corrupt."""
    try:
        return spark.read.json(path, schema=schema, multiLine=True, mode="DROPMALFORMED")
    except Exception as e:  # only an absent path counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def reference(spark: SparkSession, rttm_path: str, json_path: str) -> DataFrame:
    """Stored references: turns of RTTM files beside the texts and length of the clip's JSON. Clips that have
    one of the two only raise."""
    turns = rttm(spark, rttm_path).select("clip_id", "turn_idx", "speaker", "start", "end")
    texts = spark.read.json(json_path, schema="clip_id string, duration double, texts array<string>", multiLine=True)
    odd = turns.select("clip_id").distinct().join(texts.select("clip_id", F.lit(1).alias("n")), "clip_id", "full").where("n is null")
    lone = odd.unionByName(texts.join(turns, "clip_id", "left_anti").select("clip_id", F.lit(None).cast("int").alias("n"))).limit(5).collect()
    if lone:
        raise ValueError(f"without turns or without texts: {', '.join(r['clip_id'] for r in lone)}")
    return turns.join(texts, "clip_id").withColumn("text", F.get("texts", F.col("turn_idx").cast("int"))).drop("texts")


def export(spark: SparkSession, index_path: str, clips_path: str, adopted: DataFrame | None = None) -> DataFrame:
    """Documents of an export by its index (clip_id, n_turns). Raises where a document is missing or has
    another number of turns than the index says; ``adopted`` (clip_id, note) fills notes that are absent."""
    index = spark.read.json(index_path, schema="clip_id string, n_turns long")
    docs = spark.read.json(clips_path, schema="clip_id string, note string, turns array<struct<speaker:string,start:double,end:double>>")
    both = index.join(docs, "clip_id", "left")
    odd = both.where("turns is null or size(turns) <> n_turns").limit(5).collect()
    if odd:
        raise ValueError(f"index and documents differ: {', '.join(r['clip_id'] for r in odd)}")
    if adopted is None:
        return both
    a = adopted.select("clip_id", F.col("note").alias("__note"))
    return both.join(a, "clip_id", "left").withColumn("note", F.coalesce("note", "__note")).drop("__note")


def grid(systems: DataFrame, models: DataFrame, clips: DataFrame, transcripts: DataFrame, turns: DataFrame) -> DataFrame:
    """system, model, clip_id that have both a transcript (system, clip_id) and turns (model, clip_id). The
    three lists are small; what exists is looked up by semi joins."""
    every = transcripts.join(systems, "system", "left_semi").join(clips, "clip_id", "left_semi").select("system", "clip_id").distinct()
    found = turns.join(models, "model", "left_semi").select("model", "clip_id").distinct()
    return every.join(found, "clip_id").select("system", "model", "clip_id")


def by_clip(rows: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    """key and a map from each row's name to its fields; a name that comes twice raises."""
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, F.struct(*fields).alias("row"))))).alias("rows"))
