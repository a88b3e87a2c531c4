"""Text, token streams, alignment and transcript scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.functions import tokens as tk
from turnwise.functions.align import distance
from turnwise.operators import fusion, guards
from turnwise.plans.registry import query, read, values
from turnwise.sources import readers

WORDS = r"regexp_extract_all({c}, '\S+')"
#: Inline rows in the scripts that the tables lack.
INDIC = ["नमस्कार दुनिया", "வணக்கம் உலகம் ok", "ಕನ್ನಡ ভাষা", "hello नमस्ते wörld", "été", "123 ...", "", "مرحبا بك", "తెలుగు മലയാളം తెలుగు", "ગુજરાતી ਪੰਜਾਬੀ ଓଡ଼ିଆ"]
_N = r"""regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]{0,40}>', ' ', 'g'), '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g')"""


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace({_N}, '[\p{{P}}\p{{S}}]', ' ', 'g')), '\s+', ' ', 'g'))) AS norm FROM documents""")
def normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.normalized_native(F.col("text")).cast("binary")).alias("norm"))


@query(r"""SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '\S') AND NOT regexp_full_match(text, '(\s*<[^>]{0,40}>\s*)+')) AS speech, count(*) AS n FROM documents GROUP BY lang""")
def speech_filter(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count_if(tx.is_speech(F.col("text"))).alias("speech"), F.count("*").alias("n"))


def _script_sql() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(INDIC))
    parts = [("Latin", "[A-Za-z]")]
    cells = []
    for name, (lo, hi) in tx.SCRIPTS.items():
        parts.append((name, rf"[\x{{{lo:04X}}}-\x{{{hi:04X}}}]"))
    for name, c in parts:
        letters = rf"list_filter(regexp_extract_all(text, '{c}'), lambda x: regexp_matches(x, '\p{{L}}'))"
        first = f"list_min(list_transform({letters}, lambda x: strpos(text, x)))"
        cells.append(f"SELECT k, id, text, '{name}' AS script, len({letters}) AS n, {first} AS first FROM src")
    return rf"""WITH src AS (SELECT 'inline' AS k, * FROM (VALUES {rows}) v(id, text) UNION ALL SELECT 'doc', doc_id, text FROM documents),
c AS ({' UNION ALL '.join(cells)}), b AS (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY n DESC, first, script) AS r FROM c)
SELECT k, id, CASE WHEN n > 0 THEN script ELSE 'Latin' END AS script, round(CASE WHEN n > 0 THEN n / len(regexp_extract_all(text, '\p{{L}}'))::DOUBLE
  WHEN regexp_matches(text, '\p{{L}}') THEN 1.0 ELSE 0.0 END, 9) AS share FROM b WHERE r = 1"""


@query(_script_sql())
def script_profile(spark, d):
    inline = spark.createDataFrame(list(enumerate(INDIC)), "id bigint, text string").select(F.lit("inline").alias("k"), "id", "text")
    docs = read(spark, d, "documents").select(F.lit("doc").alias("k"), F.col("doc_id").alias("id"), "text")
    s = tx.dominant_script(F.col("text"))
    return inline.unionByName(docs).select("k", "id", s.alias("s")).select("k", "id", "s.script", F.round("s.share", 9).alias("share"))


@query(values("token VARCHAR, script VARCHAR, latin BOOLEAN, digit BOOLEAN", [(t, s, str(l), str(n)) for t, s, l, n in [
    ("नमस्कार", "DEVANAGARI", False, False), ("दुनिया", "DEVANAGARI", False, False), ("வணக்கம்", "TAMIL", False, False), ("உலகம்", "TAMIL", False, False),
    ("ok", "LATIN", True, False), ("ಕನ್ನಡ", "KANNADA", False, False), ("ভাষা", "BENGALI", False, False), ("hello", "LATIN", True, False),
    ("नमस्ते", "DEVANAGARI", False, False), ("wörld", "LATIN", False, False), ("été", "LATIN", False, False), ("123", None, False, True), ("...", None, False, False),
    ("مرحبا", "ARABIC", False, False), ("بك", "ARABIC", False, False), ("తెలుగు", "TELUGU", False, False), ("മലയാളം", "MALAYALAM", False, False),
    ("తెలుగు", "TELUGU", False, False), ("ગુજરાતી", "GUJARATI", False, False), ("ਪੰਜਾਬੀ", "GURMUKHI", False, False), ("ଓଡ଼ିଆ", "ORIYA", False, False),
]]))
def token_scripts(spark, d):
    rows = spark.createDataFrame([(t,) for t in INDIC], "text string").select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return rows.select("token", tx.token_script(F.col("token")).alias("script"), tx.is_latin(F.col("token")).alias("latin"), tx.has_digit(F.col("token")).alias("digit"))


@query(rf"""SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({WORDS.format(c='lower(text)')}) AS token FROM documents) GROUP BY 1, 2""")
def vocab_counts(spark, d):
    t = tk.exploded(read(spark, d, "documents"), tx.tokens(F.lower("text")), "lang")
    return tk.vocabulary(t, ["lang"])


@query(rf"""WITH w AS (SELECT doc_id, {WORDS.format(c='text')} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i+1:i+5], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL), top AS (SELECT doc_id, gram, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, gram) AS r FROM c) WHERE r = 1),
p AS (SELECT doc_id, count(DISTINCT q) AS covered FROM (SELECT g.doc_id, unnest(range(i, i + 5)) AS q FROM g JOIN top USING (doc_id, gram)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_tokens, coalesce(c, 0)::BIGINT AS n_top, round(coalesce(covered, 0) / len(w)::DOUBLE, 9) AS coverage
FROM w LEFT JOIN top USING (doc_id) LEFT JOIN p USING (doc_id) WHERE len(w) > 0""")
def ngram_max_coverage(spark, d):
    t = tk.exploded(read(spark, d, "documents"), tx.tokens(F.col("text")), "doc_id")
    return tk.ngram_coverage(t, ["doc_id"]).withColumn("coverage", F.round("coverage", 9))


@query(rf"""SELECT conv_id, role, md5(string_agg(array_to_string({WORDS.format(c='text')}, ' '), ' ' ORDER BY turn)) AS said, sum(len({WORDS.format(c='text')}))::BIGINT AS n
  FROM conversations GROUP BY 1, 2""")
def speaker_streams(spark, d):
    s = tk.speaker_texts(read(spark, d, "conversations"), ["conv_id"], "role", "turn", "turn", tx.tokens(F.col("text")))
    return s.select("conv_id", "role", F.md5(F.array_join("tokens", " ").cast("binary")).alias("said"), F.size("tokens").cast("long").alias("n"))


_STREAM = rf"""s AS (SELECT conv_id, turn, role, unnest({WORDS.format(c='text')}) AS token, generate_subscripts({WORDS.format(c='text')}, 1) AS p FROM conversations),
st AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS word_idx, token, role FROM s)"""


@query(f"WITH {_STREAM} SELECT conv_id, word_idx, token, role FROM st")
def word_streams(spark, d):
    return tk.word_stream(read(spark, d, "conversations"), ["conv_id"], "role", "turn", "turn", tx.tokens(F.col("text")))


_LOOKUP = rf"""WITH t AS (SELECT doc_id, unnest({WORDS.format(c='text')}) AS token, generate_subscripts({WORDS.format(c='text')}, 1) AS p FROM documents),
x AS (SELECT DISTINCT token, upper(token) AS repl FROM t WHERE token IN ('the', 'of', 'and', 'idiot')),
j AS (SELECT doc_id, p, coalesce(repl, token) AS n, (repl IS NOT NULL)::INT AS hit FROM t LEFT JOIN x USING (token))
SELECT doc_id, md5(string_agg(n, ' ' ORDER BY p)) AS text, sum(hit)::BIGINT AS n_changed FROM j GROUP BY doc_id"""


@query(_LOOKUP)
def token_lookup(spark, d):
    return _documents_looked_up(spark, read(spark, d, "documents"))


def _documents_looked_up(spark, docs):
    t = tk.exploded(docs, tx.tokens(F.col("text")), "doc_id")
    table = spark.createDataFrame([(w, w.upper()) for w in ("the", "of", "and", "idiot")], "token string, repl string")
    j = tk.looked_up(t, table, ["token"])
    n = j.groupBy("doc_id").agg(F.count("repl").alias("n_changed"))
    return tk.rebuilt(j, ["doc_id"], "new_token").join(n, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "n_changed")


@query("""WITH s AS (SELECT conv_id, sha1(string_agg(role || ':' || turn || ':' || length(text), ';' ORDER BY turn, role)) AS h, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, 'seg' || n || '-' || left(h, 10) AS mark FROM s""")
def segmentation_fingerprint(spark, d):
    part = F.concat_ws(":", "role", F.col("turn").cast("string"), F.length("text").cast("string"))
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("p")))).alias("x"))
    said = F.array_join(F.transform("x", lambda x: x["p"]), ";")
    return g.select("conv_id", F.concat(F.lit("seg"), F.size("x").cast("string"), F.lit("-"), F.left(F.sha1(said.cast("binary")), F.lit(10))).alias("mark"))


@query("""WITH t AS (SELECT user_id, event_id / 7.0::DOUBLE AS s, event_id / 7.0::DOUBLE + value AS e, event_type AS p FROM events)
SELECT user_id, 'seg' || count(*) || '-' || left(sha1(string_agg(p || ':' || printf('%.2f', s) || ':' || printf('%.2f', e), ';' ORDER BY s, e, p)), 10) AS mark FROM t GROUP BY user_id""")
def segmentation_keys(spark, d):
    """With two decimals, as stored fingerprints have them."""
    t = read(spark, d, "events").select("user_id", F.struct((F.col("event_id") / 7.0).alias("start"), (F.col("event_id") / 7.0 + F.col("value")).alias("end"), F.col("event_type").alias("speaker")).alias("x"))
    return t.groupBy("user_id").agg(F.collect_list("x").alias("x")).select("user_id", tx.segmentation_key(F.col("x")).alias("mark"))


_PAIR = r"""b AS (SELECT item_id, regexp_extract_all(text, '\S+') AS a FROM benchmark),
p AS (SELECT x.item_id AS ref, y.item_id AS hyp, x.a AS r, y.a AS h FROM b x JOIN b y ON y.item_id = x.item_id + 1)"""


@query(rf"""WITH RECURSIVE {_PAIR},
dp(ref, hyp, r, h, i, row) AS (SELECT ref, hyp, r, h, 0, range(0, len(h) + 1) FROM p
 UNION ALL SELECT ref, hyp, r, h, i + 1, (SELECT list_reduce(list_prepend([i + 1], list_transform(range(1, len(h) + 1), lambda j:
   [least(row[j + 1] + 1, row[j] + CASE WHEN r[i + 1] = h[j] THEN 0 ELSE 1 END)])), lambda acc, x: list_concat(acc, [least(x[1], acc[len(acc)] + 1)]))) FROM dp WHERE i < len(r))
SELECT ref, hyp, len(r)::BIGINT AS n_ref, row[len(h) + 1]::BIGINT AS errors, round(row[len(h) + 1] / len(r)::DOUBLE, 9) AS wer FROM dp WHERE i = len(r)""")
def token_edit_distance(spark, d):
    return _neighbour_errors(_benchmark_words(spark, d))


def _benchmark_words(spark, d):
    return read(spark, d, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("w"))


def _neighbour_errors(b):
    x, y = (b.select(F.col("item_id").alias(n), F.col("w").alias(f"{n}_w")) for n in ("ref", "hyp"))

    @F.pandas_udf("long")
    def errors(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([distance(list(u), list(v)) for u, v in zip(r, h)])

    p = x.join(y, F.col("hyp") == F.col("ref") + 1).select("ref", "hyp", F.size("ref_w").cast("long").alias("n_ref"), errors("ref_w", "hyp_w").alias("errors"))
    return p.withColumn("wer", F.round(F.when(F.col("n_ref") > 0, F.col("errors") / F.col("n_ref")).when(F.col("errors") > 0, F.lit(float("inf"))).otherwise(0.0), 9))


def _two_sides(spark, d):
    """The conversations as reference; as hypothesis each ninth word is lost and roles are swapped in a fifth of them."""
    s = tk.word_stream(read(spark, d, "conversations"), ["conv_id"], "role", "turn", "turn", tx.tokens(F.col("text"))).withColumnRenamed("role", "speaker")
    swap = F.when((F.col("conv_id") % 5 == 0) & (F.col("word_idx") % 3 == 0), F.when(F.col("speaker") == "user", "assistant").otherwise("user")).otherwise(F.col("speaker"))
    h = s.where("word_idx % 9 <> 4").withColumn("speaker", swap)
    return s.withColumn("side", F.lit("ref")).unionByName(h.withColumn("side", F.lit("hyp")))


@query()
def transcript_scores(spark, d):
    """Counts for WER, cpWER and WDER of each conversation."""
    return fusion.transcript_scores(_two_sides(spark, d), ["conv_id"])


@query(f"""WITH {_STREAM} SELECT role AS region, sum((word_idx % 9 <> 4)::INT)::BIGINT AS "C", 0::BIGINT AS "S", sum((word_idx % 9 = 4)::INT)::BIGINT AS "D",
  round(sum((word_idx % 9 = 4)::INT)::DOUBLE / count(*)::DOUBLE, 9) AS error_rate FROM st GROUP BY 1""")
def region_ops(spark, d):
    """Operations by the speaker of the reference word; words are made distinct, so that the alignment is, too."""
    s = _two_sides(spark, d).withColumn("token", F.concat("token", F.lit("#"), F.col("word_idx").cast("string")))
    regions = s.where("side = 'ref'").select("conv_id", "word_idx", F.col("speaker").alias("region"))
    out = fusion.ops_by_region(fusion.aligned(s.select("conv_id", "side", "word_idx", "token"), ["conv_id"]), regions, ["conv_id"], "region")
    return out.withColumn("error_rate", F.round("error_rate", 9))


@query()
def cp_error(spark, d):
    s = transcript_scores(spark, d)
    return s.agg(*(F.sum(c).alias(c) for c in ("cp_errors", "ref_words", "wrong_speaker", "attributed"))).select(
        "*", (F.col("cp_errors") / F.col("ref_words")).alias("cpwer"), F.try_divide("wrong_speaker", "attributed").alias("wder")
    )


@query(rf"""WITH t AS (SELECT doc_id, {WORDS.format(c='text')} AS w, {WORDS.format(c="regexp_replace(text, '[#*$%&|<>]', '', 'g')")} AS v FROM documents),
p AS (SELECT doc_id, w, v, unnest(range(1, len(w) + 1)) AS i FROM t WHERE len(w) = len(v))
SELECT t.doc_id, len(t.w) = len(t.v) AS comparable, count(i) AS n, coalesce(sum((p.w[i] <> p.v[i])::INT), 0)::BIGINT AS n_changed,
  coalesce(sum((p.w[i] = lower(p.w[i]) AND p.v[i] <> p.w[i])::INT), 0)::BIGINT AS n_lower FROM t LEFT JOIN p USING (doc_id) GROUP BY ALL""")
def edit_attribution(spark, d):
    doc = read(spark, d, "documents")
    w, v = tx.tokens(F.col("text")), tx.tokens(F.regexp_replace("text", r"[#*$%&|<>]", ""))
    b = doc.select("doc_id", w.alias("w"), v.alias("v"))
    # words that signs alone made up are gone after the edit: then places do not compare, and the row says so
    alike = F.size("w") == F.size("v")
    p = b.select("doc_id", alike.alias("comparable"), F.when(alike, F.arrays_zip("w", "v")).otherwise(F.array().cast("array<struct<w:string,v:string>>")).alias("x"))
    changed = F.filter("x", lambda x: x["w"] != x["v"])
    size = lambda c: F.size(c).cast("long")
    return p.select("doc_id", "comparable", size("x").alias("n"), size(changed).alias("n_changed"), size(F.filter(changed, lambda x: x["w"] == F.lower(x["w"]))).alias("n_lower"))


@query()
def edit_guards(spark, d):
    doc = read(spark, d, "documents")
    after = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.regexp_replace("text", "the", "thé"))
    v = guards.edit_verdict(F.col("text"), after, F.array().cast("array<int>"))
    return doc.select("doc_id", v.alias("v")).groupBy("v.ok", "v.reason").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'moron') THEN 'abuse'
  WHEN contains(lower(text), '%%%') THEN 'noise' ELSE 'other' END AS class, contains(lower(text), 'license') AS permanent FROM documents""")
def guard_reasons(spark, d):
    rules = [("legal", True, ["License"]), ("abuse", False, ["idiot", "moron"]), ("noise", False, ["%%%"])]
    return read(spark, d, "documents").select("doc_id", tx.classify_error(F.col("text"), rules).alias("x")).select("doc_id", "x.class", "x.permanent")


_PACK = """k AS (SELECT o_custkey AS k, string_agg(o_orderpriority || ' [' || o_orderkey || '.5 - ' || (o_orderkey + 3) || ']', ' | ' ORDER BY o_orderkey) || ' | bad piece | ' AS packed
  FROM orders GROUP BY 1)"""


@query(rf"""WITH {_PACK}, p AS (SELECT k, trim(x) AS piece FROM (SELECT k, unnest(string_split(packed, '|')) AS x FROM k) WHERE trim(x) <> ''),
m AS (SELECT k, piece, regexp_extract(piece, '^(.*?)\s*\[\s*([0-9]+(?:\.[0-9]+)?)\s*-\s*([0-9]+(?:\.[0-9]+)?)\s*\]$', ['name', 'a', 'b']) AS r FROM p)
SELECT k, nullif(r.name, '') AS speaker, try_cast(nullif(r.a, '') AS DOUBLE) AS start, try_cast(nullif(r.b, '') AS DOUBLE) AS "end", r.a <> '' AS parsed FROM m""")
def split_pipe_parse(spark, d):
    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    piece = F.concat("o_orderpriority", F.lit(" ["), key.cast("string"), F.lit(".5 - "), (key + 3).cast("string"), F.lit("]"))
    packed = o.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", piece.alias("p")))).alias("x"))
    packed = packed.select("k", F.concat(F.array_join(F.transform("x", lambda x: x["p"]), " | "), F.lit(" | bad piece | ")).alias("packed"))
    return readers.parsed_labels(packed, "k", "packed").select("k", "speaker", "start", "end", "parsed")


@query(r"""SELECT event_id, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events""")
def json_field(spark, d):
    got = F.from_json(F.regexp_extract("props", r"(?s)\{.*\}", 0), "k double", {"mode": "PERMISSIVE"})
    return read(spark, d, "events").select("event_id", got["k"].alias("k"))


@query(r"""SELECT doc_id, try_cast(n_chars::VARCHAR || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END AS DOUBLE) AS v FROM documents""")
def numeric_coercion(spark, d):
    raw = F.concat(F.col("n_chars").cast("string"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""))
    return read(spark, d, "documents").select("doc_id", raw.try_cast("double").alias("v"))


@query(r"""SELECT conv_id, mode, n FROM (SELECT conv_id, role AS mode, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, role) AS r FROM conversations GROUP BY 1, 2) WHERE r = 1""")
def majority_label(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return c.groupBy("conv_id").agg(F.min(F.struct((-F.col("n")).alias("c"), "role")).alias("x")).select("conv_id", F.col("x.role").alias("mode"), (-F.col("x.c")).alias("n"))


@query()
def fused_turns(spark, d):
    """Events of three users' groups as three systems, fused by votes."""
    e = read(spark, d, "events")
    start = (F.col("event_id") % 997) * 1.0
    t = e.select(
        F.col("event_type").alias("clip_id"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("system"), F.col("event_id").alias("turn_idx"),
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("speaker"), start.alias("start"), (start + F.col("value") / 20).alias("end"),
    )
    clips = t.select("clip_id").distinct().withColumn("duration", F.lit(1000.0))
    return fusion.fused(t, ["s0", "s1", "s2"], clips)
