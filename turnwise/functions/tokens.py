"""Token tables: streams, vocabularies, n-grams, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exploded(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def vocabulary(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def speaker_texts(df: DataFrame, keys: list[str], speaker: str, start: str, idx: str, tokens: Column) -> DataFrame:
    """Tokens of each speaker in order of start, then of idx."""
    rows = df.select(*keys, speaker, F.struct(F.col(start).alias("s"), F.col(idx).alias("i"), tokens.alias("t")).alias("x"))
    said = rows.groupBy(*keys, speaker).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return said.select(*keys, speaker, F.flatten(F.transform("x", lambda x: x["t"])).alias("tokens"))


def word_stream(df: DataFrame, keys: list[str], speaker: str, start: str, idx: str, tokens: Column) -> DataFrame:
    """One row for each word: word_idx over the whole stream, token, speaker."""
    rows = df.select(*keys, speaker, F.col(start).alias("s"), F.col(idx).alias("i"), F.posexplode(tokens).alias("p", "token"))
    w = Window.partitionBy(*keys).orderBy("s", "i", "p")
    return rows.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("word_idx"), "token", speaker)


def ngram_coverage(tokens: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Share of positions under the most frequent n-gram, the first in order on ties; 0 under n tokens.

    Grams are made by lead() within a text and counted with partial aggregation."""
    w = Window.partitionBy(*keys).orderBy("pos")
    parts = [F.lead("token", k).over(w) for k in range(n)]
    size = tokens.groupBy(*keys).agg(F.count("*").alias("n_tokens"))
    grams = tokens.select(*keys, "pos", F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts)).alias("gram")).where("gram is not null")
    counts = grams.groupBy(*keys, "gram").agg(F.count("*").alias("c"))
    top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "gram")).alias("x")).select(*keys, F.col("x.gram").alias("gram"), (-F.col("x.c")).alias("n_top"))
    at = grams.join(top, [*keys, "gram"]).select(*keys, "pos", "n_top")
    prev = F.lag("pos").over(w)
    new = F.least(F.lit(n), F.coalesce(F.col("pos") - prev, F.lit(n)))
    covered = at.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("covered"), F.max("n_top").alias("n_top"))
    out = size.join(covered, keys, "left")
    return out.select(*keys, "n_tokens", F.coalesce("n_top", F.lit(0)).alias("n_top"), (F.coalesce("covered", F.lit(0)) / F.col("n_tokens")).alias("coverage"))


def looked_up(tokens: DataFrame, table: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """Tokens with their replacement where the table has one. The table is broadcast if a count of it, up
    to ``most`` rows, proves it small; else Spark joins as its statistics say."""
    small = table.limit(most + 1).count() <= most
    return tokens.join(F.broadcast(table) if small else table, on, "left").withColumn("new_token", F.coalesce("repl", "token"))


def rebuilt(tokens: DataFrame, keys: list[str], column: str) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("t"))))
    return tokens.groupBy(*keys).agg(F.array_join(F.transform(x, lambda p: p["t"]), " ").alias("text"))
