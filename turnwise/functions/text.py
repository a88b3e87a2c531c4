"""Text scalars: normalizer, glosses, tokens, scripts, fingerprints.

Native Column expressions wherever Spark has the semantics; Arrow functions for Unicode normalization
and names and for Python's rounding.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = r"<[^>]{0,40}>"
#: Fixed value: a gloss is a bracketed run of up to 41 characters that begins with an ASCII letter or digit.
GLOSS = r"[(\[{]\s*[A-Za-z0-9][^)\]}]{0,40}?\s*[)\]}]"
_GLOSS = re.compile(rf"\s?{GLOSS}")
#: An ending that a hyphen joins to a gloss, up to a space or the end: without one the hyphen joins two words.
_GLOSS_ENDING = re.compile(rf"(?P<word>[^\s()\[\]{{}}]*)\s?{GLOSS}-(?P<ending>[^\s(\[{{]+)(?!\S)")
_ZERO_WIDTH = "​‌‍⁠﻿"
#: First and last letters of the blocks that scripts are told by.
SCRIPTS = {
    "Devanagari": (0x0900, 0x097F),
    "Bengali": (0x0980, 0x09FF),
    "Gurmukhi": (0x0A00, 0x0A7F),
    "Gujarati": (0x0A80, 0x0AFF),
    "Oriya": (0x0B00, 0x0B7F),
    "Tamil": (0x0B80, 0x0BFF),
    "Telugu": (0x0C00, 0x0C7F),
    "Kannada": (0x0C80, 0x0CFF),
    "Malayalam": (0x0D00, 0x0D7F),
    "Arabic": (0x0600, 0x06FF),
}


def _said(m: re.Match) -> str:
    """The word with its ending, which the word may have already."""
    word, ending = m["word"], m["ending"]
    bare = ending
    while bare and unicodedata.category(bare[-1])[0] in "PS":
        bare = bare[:-1]
    return word if word and bare and word.endswith(bare) else word + ending


def strip_glosses(text: str) -> str:
    """Takes out bracketed Latin glosses; a hyphened ending behind one goes to the word before it."""
    for pattern, put in ((_GLOSS_ENDING, _said), (_GLOSS, "")):
        n = 1
        while n:  # glosses within glosses
            text, n = pattern.subn(put, text)
    return text


def normalize(text: str | None, glosses: bool = True) -> str:
    """NFC; tags to spaces; glosses out; zero-width characters out; punctuation and symbols to spaces;
    lower case; single spaces."""
    if not text:
        return ""
    t = re.sub(TAG, " ", unicodedata.normalize("NFC", text))
    t = strip_glosses(t) if glosses else t
    t = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in t if c not in _ZERO_WIDTH)
    return " ".join(t.lower().split())


def normalized(column: Column, glosses: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalize(t, glosses))

    return run(column)


def normalized_native(text: Column) -> Column:
    """The steps that Spark has: tags, zero-width characters, punctuation, case, spaces. For texts in NFC
    without glosses the result is the same."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, " ")
    t = F.translate(t, _ZERO_WIDTH, "")
    t = F.lower(F.regexp_replace(t, r"[\p{P}\p{S}]", " "))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def is_speech(text: Column) -> Column:
    """Not blank, and not made of tags alone."""
    t = F.coalesce(text, F.lit(""))
    return t.rlike(r"(?U)\S") & ~t.rlike(rf"(?U)^(?:\s*{TAG}\s*)+$")


def safe_label(label: Column) -> Column:
    return F.array_join(tokens(F.trim(label)), "_")


def script_counts(text: Column) -> Column:
    """MAP from script to its letters in the text; Latin: the ASCII letters."""
    t = F.coalesce(text, F.lit(""))
    pairs = []
    for name, (lo, hi) in SCRIPTS.items():
        pairs += [F.lit(name), F.regexp_count(t, F.lit(rf"[\p{{L}}&&[\x{{{lo:04X}}}-\x{{{hi:04X}}}]]"))]
    return F.create_map(F.lit("Latin"), F.regexp_count(t, F.lit("[A-Za-z]")), *pairs)


def dominant_script(text: Column) -> Column:
    """STRUCT<script, share>: most letters, on ties the script that is met first; share of all letters.
    Without letters of any listed script: Latin, and 1.0 if there is a letter, else 0.0."""
    t = F.coalesce(text, F.lit(""))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    cells = []
    classes = {"Latin": "[A-Za-z]"} | {n: rf"[\p{{L}}&&[\x{{{lo:04X}}}-\x{{{hi:04X}}}]]" for n, (lo, hi) in SCRIPTS.items()}
    for name, c in classes.items():
        n = F.regexp_count(t, F.lit(c))
        cells.append(F.struct(n.alias("n"), (-F.regexp_instr(t, F.lit(c))).alias("first"), F.lit(name).alias("script")))
    best = F.array_max(F.array(*cells))
    return F.get(
        F.transform(
            F.array(best),
            lambda b: F.when(b["n"] > 0, F.struct(b["script"].alias("script"), (b["n"] / letters).alias("share"))).otherwise(
                F.struct(F.lit("Latin").alias("script"), (letters > 0).cast("double").alias("share"))
            ),
        ),
        0,
    )


def token_script(column: Column) -> Column:
    """First word of the Unicode name of a token's first letter."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        def one(w: str | None) -> str | None:
            letter = next((c for c in w or "" if unicodedata.category(c)[0] == "L"), None)
            return unicodedata.name(letter, "?").split()[0] if letter else None

        return words.map(one)

    return run(column)


def is_latin(token: Column) -> Column:
    return token.rlike(r"\p{L}") & ~token.rlike(r"[\p{L}&&[^\x00-\x7F]]")


def has_digit(token: Column) -> Column:
    return token.rlike(r"[\p{Nd}²³¹⁰-⁹₀-₉]")


def bucket(error: Column) -> Column:
    return F.when(error < 0, "under").when(error > 0, "over").otherwise("exact")


def classify_error(message: Column, rules: list[tuple[str, bool, list[str]]], other: str = "other") -> Column:
    """STRUCT<class, permanent> of the first rule with a part that the message holds, case ignored."""
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.struct(F.lit(other).alias("class"), F.lit(False).alias("permanent"))
    for name, permanent, parts in reversed(rules):
        hit = F.lit(False)
        for p in parts:
            hit = hit | m.contains(p.lower())
        out = F.when(hit, F.struct(F.lit(name).alias("class"), F.lit(permanent).alias("permanent"))).otherwise(out)
    return out


def segmentation_key(turns: Column) -> Column:
    """Fingerprint of ARRAY<STRUCT<start, end, speaker>>: speaker:start:end with two decimals as Python
    rounds them, sorted by start, end, speaker."""
    import hashlib

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(turns) -> str:
            turns = sorted((t["start"], t["end"], t["speaker"]) for t in turns)
            said = ";".join(f"{p}:{s:.2f}:{e:.2f}" for s, e, p in turns)
            return f"seg{len(turns)}-{hashlib.sha1(said.encode()).hexdigest()[:10]}"

        return rows.map(one)

    return run(turns)


def settings_key(**parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("?"))) for k, v in sorted(parts.items()))).cast("binary"))


def gloss_counters(text: Column) -> Column:
    """STRUCT of glosses by bracket, whether round ones do not pair up, and endings joined to a gloss."""
    t = F.coalesce(text, F.lit(""))
    #: Fixed values.
    styles = {"round": r"\([^)]{0,40}\)", "square": r"\[[^\]]{0,40}\]", "curly": r"\{[^}]{0,40}\}", "joined": r"[)\]]-\S", "glosses": GLOSS}
    lone = F.regexp_count(t, F.lit(r"\(")) != F.regexp_count(t, F.lit(r"\)"))
    return F.struct(*(F.regexp_count(t, F.lit(p)).cast("long").alias(n) for n, p in styles.items()), lone.cast("long").alias("unbalanced"))


#: Function words that tell Marathi from Hindi.
MARATHI = ("आणि", "आहे", "आहेत", "मी", "नाही", "होतं", "काय", "तर", "पण", "त्याच्या", "मला", "तुम्ही", "हे", "का", "म्हणून", "असं")
HINDI = ("और", "है", "हैं", "मैं", "नहीं", "था", "क्या", "तो", "लेकिन", "उसके", "मुझे", "आप", "ये", "क्यों", "इसलिए", "ऐसा")


def language_by_words(words: Column, hint: Column, unsure: str = "hi_or_mr") -> Column:
    """The hint, or where it leaves two languages open, the one with more function words; Hindi on ties and
    without a hint."""
    n = lambda of: F.size(F.filter(words, lambda w: w.isin(*of)))
    told = F.when(F.trim(F.coalesce(hint, F.lit(""))) == "", "hi").otherwise(hint)
    return F.when(told != unsure, told).when(n(MARATHI) > n(HINDI), "mr").otherwise("hi")


def is_editable(text: Column, skipped: Column) -> Column:
    """Not blank, and not skipped for a reason."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)\S") & (F.coalesce(skipped, F.lit("")) == "")


def normalization_report(segments: DataFrame, text: str = "text") -> DataFrame:
    """One row: segments, those with speech, their tokens as they stand, without punctuation, and without
    glosses too, and what is left in Latin letters."""
    t = segments.select(F.col(text).alias("t"), is_speech(F.col(text)).alias("speech"))
    said = F.when(F.col("speech"), F.col("t"))
    t = t.select("speech", said.alias("t"), normalized(said, False).alias("with_glosses"), normalized(said).alias("final"))
    count = lambda c: F.sum(F.size(tokens(F.coalesce(c, F.lit(""))))).cast("long")
    out = t.agg(
        F.count("*").alias("total"), F.count_if("speech").alias("speech"), count(F.col("t")).alias("raw"), count(F.col("with_glosses")).alias("gloss_kept"),
        count(F.col("final")).alias("final"), F.sum(F.regexp_count("final", F.lit("[a-z]+"))).cast("long").alias("residual_latin"),
    )
    share = F.coalesce(F.try_divide(F.col("gloss_kept") - F.col("final"), F.col("gloss_kept")), F.lit(0.0))
    return out.withColumns({"removed": F.col("gloss_kept") - F.col("final"), "gloss_share": F.round(share, 4), "residual_share": F.round(F.col("residual_latin") / F.greatest("final", F.lit(1)), 6)})


def latin_share(text: str) -> float:
    """ASCII letters of all letters."""
    n = sum(c.isalpha() for c in text)
    return sum(c.isascii() and c.isalpha() for c in text) / n if n else 0.0
