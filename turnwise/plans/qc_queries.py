"""Restricted scores, summaries, samples and lag checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.operators import intervals as iv
from turnwise.operators import qc
from turnwise.plans.interval_queries import _SIDES, WIDTH
from turnwise.plans.registry import event_turns, query, read
from turnwise.sources import writers


@query(f"""WITH {_SIDES}, dr AS (SELECT clip, t, sum((r > 0)::INT) AS speakers FROM run GROUP BY clip, t),
q AS (SELECT reg.*, dr.speakers FROM reg JOIN dr USING (clip, t) WHERE reg.until IS NOT NULL AND dr.speakers >= 2)
SELECT clip, sum((miss + fa + confusion) * (until - t))::BIGINT AS error, sum(nr * (until - t))::BIGINT AS total FROM q GROUP BY clip""")
def overlap_region_errors(spark, d):
    t = event_turns(spark, d)
    ref, hyp = t.where("idx % 2 = 0"), t.where("idx % 2 = 1")
    region = iv.timeline(ref, ["clip"], "speaker", 2, eps=0)
    r = iv.error_regions(iv.restrict(ref, region, ["clip"], WIDTH), iv.restrict(hyp, region, ["clip"], WIDTH), ["clip"])
    n = F.col("until") - F.col("t")
    return r.groupBy("clip").agg(F.sum((F.col("miss") + F.col("fa") + F.col("confusion")) * n).alias("error"), F.sum(F.col("n_ref") * n).alias("total"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < 400) AS n_ok, bool_and(value < 400) AS all_ok, max(abs(value)) AS most,
  round(avg(value / (1 + event_id % 50)), 6) AS rate_mean, round(min(value / (1 + event_id % 50)), 6) AS rate_min, round(max(value / (1 + event_id % 50)), 6) AS rate_max,
  round(avg(value / (1 + event_id % 50)) * 1000.0, 3) AS projected FROM events GROUP BY 1""")
def run_summary(spark, d):
    e = read(spark, d, "events").withColumn("length", 1 + F.col("event_id") % 50)
    s = qc.summary(e, ["event_type"], "value", "length", F.col("value") < 400, 1000.0)
    return s.withColumns({c: F.round(c, 6) for c in ("rate_mean", "rate_min", "rate_max")}).withColumn("projected", F.round("projected", 3))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w FROM conversations),
p AS (SELECT conv_id, turn, unnest(range(0, len(w))) AS pos, len(w) AS n FROM t)
SELECT conv_id, turn, pos::INTEGER AS pos, round(turn * 10.0 + pos * (8.0 / n), 9) AS t_start, round(turn * 10.0 + (pos + 1) * (8.0 / n), 9) AS t_end FROM p""")
def unrolled_words(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8.0).alias("end"), tx.tokens(F.col("text")).alias("w"))
    return iv.unrolled(c, "w").select("conv_id", "turn", "pos", F.round("t_start", 9).alias("t_start"), F.round("t_end", 9).alias("t_end"))


@query("""WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id, n_chars FROM r WHERE r IN (floor(0.1::DOUBLE * (n - 1)), floor(0.5::DOUBLE * (n - 1)), floor(0.9::DOUBLE * (n - 1)))""")
def stratified_sample(spark, d):
    return qc.stratified(read(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "n_chars", "doc_id", [0.1, 0.5, 0.9])


@query()
def lag_assessment(spark, d):
    """Events as activity of 50 clips; in every third the hypothesis is 1.5 s late."""
    e = read(spark, d, "events").select((F.col("user_id") % 50).cast("string").alias("clip_id"), "event_id", "value")
    start = (F.col("event_id") * 37 % 500) * 0.1
    ref = e.select("clip_id", start.alias("start"), (start + F.col("value") / 500 + 0.1).alias("end"))
    late = F.when(F.col("clip_id").cast("int") % 3 == 0, 1.5).otherwise(0.0)
    hyp = ref.select("clip_id", (F.col("start") - late).alias("start"), (F.col("end") - late).alias("end"))
    clips = ref.select("clip_id").distinct().withColumn("duration", F.lit(55.0))
    return qc.assessed(qc.lags(ref, hyp, clips))


@query()
def duplicate_words(spark, d):
    """Words that neighbouring turns of a conversation share in runs of three."""
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("idx"), F.col("turn").alias("start"), (F.col("turn") + 2).alias("end"), tx.tokens(F.col("text")).alias("tokens"))
    return qc.duplicate_positions(iv.overlap_pairs(c, ["conv_id"], "idx", 4), ["conv_id"])


@query(r"""SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1""")
def clip_documents(spark, d):
    """Each user's events as one JSON document, read again."""
    docs = writers.clip_documents(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])
    back = docs.select("user_id", F.from_json("document", "array<struct<event_id: bigint, value: double>>").alias("x"))
    return back.select("user_id", F.size("x").cast("long").alias("n"), F.get("x", F.lit(0))["event_id"].alias("first"))


COLLAR = 5_000_000
_ZONES = f"""z AS (SELECT clip, t - {COLLAR} AS s, t + {COLLAR} AS e FROM (SELECT DISTINCT clip, t FROM ev WHERE r <> 0)),
z0 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM z),
z1 AS (SELECT *, sum(n) OVER (PARTITION BY clip ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM z0),
zm AS (SELECT clip, min(s) AS s, max(e) AS e FROM z1 GROUP BY clip, g)"""


@query(f"""WITH {_SIDES}, {_ZONES}, dr AS (SELECT clip, t, sum((r > 0)::INT) AS speakers FROM run GROUP BY clip, t),
q AS (SELECT reg.* FROM reg JOIN dr USING (clip, t) WHERE reg.until IS NOT NULL AND dr.speakers < 2 AND (nr > 0 OR nh > 0)),
ov AS (SELECT q.clip, q.t, sum(least(zm.e, q.until) - greatest(zm.s, q.t)) AS o FROM q JOIN zm ON zm.clip = q.clip AND zm.s < q.until AND q.t < zm.e GROUP BY q.clip, q.t)
SELECT q.clip, sum((miss + fa + confusion) * (q.until - q.t - coalesce(o, 0)))::BIGINT AS error, sum(nr * (q.until - q.t - coalesce(o, 0)))::BIGINT AS total
FROM q LEFT JOIN ov ON q.clip = ov.clip AND q.t = ov.t GROUP BY q.clip""")
def lenient_errors(spark, d):
    t = event_turns(spark, d)
    ref, hyp = t.where("idx % 2 = 0"), t.where("idx % 2 = 1")
    whole = t.groupBy("clip").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    region = iv.scored_region(ref, whole, ["clip"], "speaker", COLLAR, True, eps=0)
    r = iv.error_regions(iv.restrict(ref, region, ["clip"], WIDTH), iv.restrict(hyp, region, ["clip"], WIDTH), ["clip"])
    n = F.col("until") - F.col("t")
    return r.groupBy("clip").agg(F.sum((F.col("miss") + F.col("fa") + F.col("confusion")) * n).alias("error"), F.sum(F.col("n_ref") * n).alias("total"))


@query(f"""WITH {_SIDES}, hh AS (SELECT clip, t, sum(h) AS nh FROM run GROUP BY clip, t), rr AS (SELECT clip, t, sum(r) AS nr FROM run GROUP BY clip, t),
k AS (SELECT run.clip, run.speaker, run.t, lead(run.t) OVER (PARTITION BY run.clip, run.speaker ORDER BY run.t) AS until, r, h, hh.nh, rr.nr
  FROM run JOIN hh USING (clip, t) JOIN rr USING (clip, t))
SELECT clip, speaker, sum((until - t) * CASE WHEN nr > 0 THEN r * (nh > 0)::INT ELSE (h > 0)::INT END)::BIGINT AS len FROM k WHERE until IS NOT NULL
GROUP BY clip, speaker HAVING sum((until - t) * CASE WHEN nr > 0 THEN r * (nh > 0)::INT ELSE (h > 0)::INT END) > 0""")
def transplanted_time(spark, d):
    t = event_turns(spark, d)
    labels, speech = t.where("idx % 2 = 0"), t.where("idx % 2 = 1").withColumn("own", F.col("speaker"))
    out = iv.transplanted(labels, speech, ["clip"], "speaker", WIDTH, "own", eps=0)
    return out.groupBy("clip", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("len"))
