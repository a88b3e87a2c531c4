"""Quality rules: a threshold table compiled into one projection, without user functions.

Defined cases: a null or empty text has no words, so it fails the base rule; a null doc_id stays
null; repeated rows are each judged; columns besides doc_id and text are ignored or, in
``keep_clean``, passed on as they are (names with ``__`` in front are reserved for the working).
Windows are compared by 64-bit hashes of their five words, within one text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import GAP, text_of

SYMBOLS = "#*$%&|<>"
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in a is that it for on with as was at by an be this are from or not "
            "der die und den von zu das mit sich des auf ist im dem nicht ein eine "
            "de la le et les un une que est pour qui dans par sur au pas du ou "
            "el en y los se del las por con no su para es al lo".split()
        )
    )
)


@dataclass(frozen=True)
class Rule:
    """``low`` * over <= 100 * count <= ``high`` * over, judged where n_words >= ``from_words``."""

    name: str
    count: str
    over: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=2000),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("capitals", "n_capitals", "word_chars", high=40),
    Rule("echoes", "n_echoes", "n_words", high=20),
    Rule("stop_words", "n_stop_words", "n_words", low=2, from_words=100),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=50),
)
MIN_WORDS, MAX_REPEAT = 10, 20


def _sorted_pairs(grams: Column) -> Column:
    """(window, place) pairs in order where a window occurs twice; null elsewhere."""
    pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.array_sort(pairs))


def _places_of_repeats(pairs: Column) -> Column:
    twice = F.filter(
        pairs, lambda x, k: (F.get(pairs, k - 1)["g"] == x["g"]) | (F.get(pairs, k + 1)["g"] == x["g"])
    )
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words under windows of five that start at these sorted places."""
    end = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return F.coalesce(end, F.lit(0).cast("long"))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, then every count that a rule may name. Narrow: no shuffle, whole texts."""
    text = F.col("__text")
    base = docs.select(*keep, text_of().alias("__text"))
    split = base.select(
        *keep,
        text,
        F.filter(F.split(text, GAP), lambda w: w != "").alias("__words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    words, n = F.col("__words"), F.size("__words")
    hashed = split.select(
        *keep,
        text,
        words,
        F.col("__lines"),
        F.when(
            n >= 5,
            F.transform(
                F.sequence(F.lit(0), n - 5),
                lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("__grams"),
    )
    # one column for each step: lambdas then read a finished array, not its expression again
    paired = hashed.select(*keep, text, words, F.col("__lines"), _sorted_pairs(F.col("__grams")).alias("__pairs"))
    placed = paired.select(*keep, text, words, F.col("__lines"), _places_of_repeats(F.col("__pairs")).alias("__at"))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("__at")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter(words, lambda w, i: F.get(words, i - 1) == w)).cast("long").alias("n_echoes"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # a generator of one row: conditions on counts stay above it, while through projections they would be
    # pushed down, and each array computed again for every element that looks into it
    return placed.select(*keep, F.explode_outer(F.array(counts)).alias("__m")).select(*keep, "__m.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    passed = F.lit(True)
    for r in rules:
        count, over = 100 * F.col(r.count), F.col(r.over)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (count >= r.low * over)
        if r.high is not None:
            ok = ok & (count <= r.high * over)
        passed = passed & (ok | (F.col("n_words") < r.from_words))
    return passed


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *keep: str) -> DataFrame:
    keep = keep or ("doc_id",)
    return measured(docs, *keep).select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def keep_clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs["text"])
    return measured(row, "__row").where(~base_failed() & verdict(rules)).select("__row.*")


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdict as text, for the comparison in SQL."""
    parts = []
    for r in rules:
        ok = [f"100 * {r.count} >= {r.low} * {r.over}"] if r.low is not None else []
        ok += [f"100 * {r.count} <= {r.high} * {r.over}"] if r.high is not None else []
        parts.append(f"(({' AND '.join(ok)}) OR n_words < {r.from_words})")
    return " AND ".join(parts)


def measured_sql(table: str = "documents") -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
    t AS (SELECT doc_id, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                 list_filter(string_split(coalesce(text, ''), chr(10)),
                             lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
          FROM {table}),
    g AS (SELECT doc_id, i, words[i:i+4] AS gram
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5)),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
              SELECT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p
              FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1)
            GROUP BY doc_id),
    m AS (SELECT t.doc_id, len(words)::BIGINT AS n_words,
                 length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                 len(lines)::BIGINT AS n_lines,
                 length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_capitals,
                 len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i-1]))::BIGINT AS n_echoes,
                 len(list_filter(words, lambda w: lower(w) IN ({stops})))::BIGINT AS n_stop_words
          FROM t LEFT JOIN rep USING (doc_id))"""


OP5_SQL = f"""
WITH {measured_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
       (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND {rules_sql()}) AS kept
FROM m"""
