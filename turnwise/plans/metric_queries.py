"""Pooled ratios, rankings, concentration, comparison and strata over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions.text import bucket
from turnwise.operators import guards
from turnwise.operators import metrics as m
from turnwise.plans.registry import query, read

# Money in whole cents: sums are exact in any order.
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
CUT = "CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)"
TAX = "CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)"
BASE = f"SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, {CENTS} AS price, {CUT} AS cut, {TAX} AS tax FROM lineitem"


def lines(spark, d):
    r = lambda e: F.round(e * 100).cast("long")
    p = F.col("l_extendedprice")
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        r(p).alias("price"), r(p * F.col("l_discount")).alias("cut"), r(p * F.col("l_tax")).alias("tax"),
    )


def orders(spark, d):
    return read(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


ORD = "o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"


@query(f"""WITH l AS ({BASE}), x AS (SELECT n_name AS nation, price, cut, tax FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT nation, sum(price)::BIGINT AS price, sum(cut)::BIGINT AS cut, sum(tax)::BIGINT AS tax, count(*) AS n_rows FROM x GROUP BY nation)
SELECT nation, price, cut, tax, n_rows, round(cut / price::DOUBLE, 9) AS cut_rate, round(tax / price::DOUBLE, 9) AS tax_rate,
  round(cut / sum(cut) OVER ()::DOUBLE, 9) AS cut_share FROM g ORDER BY cut_rate DESC, nation LIMIT 10""")
def pooled_discount_by_nation(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    x = lines(spark, d).join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    g = m.shares(m.pooled(x, ["nation"], ["cut", "tax"], "price"), [], ["cut"])
    for k in ("cut_rate", "tax_rate", "cut_share"):
        g = g.withColumn(k, F.round(k, 9))
    return m.ranked(g, F.col("cut_rate").desc(), 10, "nation")


@query(f"""WITH l AS ({BASE}) SELECT l_returnflag AS flag, sum(cut)::BIGINT AS cut, sum(price)::BIGINT AS price, count(*) AS n_rows,
  round(sum(cut)::DOUBLE / sum(price)::DOUBLE, 9) AS pooled, round(avg(cut / price::DOUBLE), 9) AS mean_of_rates FROM l GROUP BY 1""")
def pooled_vs_mean_rate(spark, d):
    x = lines(spark, d).withColumns({"rate": F.col("cut") / F.col("price"), "flag": F.col("l_returnflag")})
    p = m.pooled(x, ["flag"], ["cut"], "price", ["rate"])
    return p.select("flag", "cut", "price", "n_rows", F.round("cut_rate", 9).alias("pooled"), F.round("rate_mean", 9).alias("mean_of_rates"))


@query(f"""WITH l AS ({BASE}), g AS (SELECT p_brand AS brand, p_type AS type, sum(price)::BIGINT AS price FROM l JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT brand, type, price, round(price / sum(price) OVER (PARTITION BY brand)::DOUBLE, 9) AS price_share FROM g""")
def revenue_share_enrich(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    g = lines(spark, d).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("brand", "type").agg(F.sum("price").alias("price"))
    return m.shares(g, ["brand"], ["price"]).withColumn("price_share", F.round("price_share", 9))


@query(f"""WITH {ORD}, g AS (SELECT c_mktsegment AS segment, sum(cents)::BIGINT AS cents, count(*) AS n FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT segment, cents, n, round((cents / sum(cents) OVER ()::DOUBLE) / (n / sum(n) OVER ()::DOUBLE), 9) AS over FROM g""")
def over_representation(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    g = orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    s = m.shares(g, [], ["cents", "n"])
    return s.select("segment", "cents", "n", F.round(F.try_divide("cents_share", "n_share"), 9).alias("over"))


@query(f"""WITH l AS ({BASE}), g AS (SELECT l_orderkey, sum(cut)::BIGINT AS cut, sum(tax)::BIGINT AS tax, sum(price % 1000)::BIGINT AS odd FROM l GROUP BY 1)
SELECT l_orderkey, CASE WHEN cut + tax = 0 THEN 'none' WHEN cut >= tax AND cut >= odd THEN 'cut' WHEN tax >= odd THEN 'tax' ELSE 'odd' END AS dominant FROM g""")
def dominant_component(spark, d):
    g = lines(spark, d).groupBy("l_orderkey").agg(F.sum("cut").alias("cut"), F.sum("tax").alias("tax"), F.sum(F.col("price") % 1000).alias("odd"))
    return g.select("l_orderkey", m.dominant({"cut": "cut", "tax": "tax", "odd": "odd"}, F.col("cut") + F.col("tax") > 0).alias("dominant"))


@query(f"""WITH l AS ({BASE}), g AS (SELECT l_returnflag AS flag, l_partkey AS part, sum(price)::BIGINT AS price FROM l GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER o AS rank, sum(price) OVER (PARTITION BY flag ORDER BY price DESC, part ROWS UNBOUNDED PRECEDING)::BIGINT AS running,
  sum(price) OVER (PARTITION BY flag) AS total FROM g WINDOW o AS (PARTITION BY flag ORDER BY price DESC, part))
SELECT flag, part, price, rank, running, round(running / total::DOUBLE, 9) AS running_share FROM w WHERE rank <= 100""")
def pareto_parts(spark, d):
    g = lines(spark, d).groupBy(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part")).agg(F.sum("price").alias("price"))
    return m.pareto(g, ["flag"], "price", "part").where("rank <= 100").withColumn("running_share", F.round("running_share", 9))


@query(f"""WITH {ORD}, w AS (SELECT o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderstatus ORDER BY cents DESC, o_orderkey) AS rank,
  sum(cents) OVER (PARTITION BY o_orderstatus ORDER BY cents DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS running, sum(cents) OVER (PARTITION BY o_orderstatus) AS total FROM o)
SELECT status, min(rank) AS n_needed, min(running)::BIGINT AS reached FROM w WHERE running / total::DOUBLE >= 0.8 GROUP BY status""")
def prefix_to_80pct(spark, d):
    return m.prefix_reaching(orders(spark, d).withColumnRenamed("o_orderstatus", "status"), ["status"], "cents", "o_orderkey")


@query(f"""WITH {ORD}, g AS (SELECT c_mktsegment AS segment, c_custkey, sum(cents)::BIGINT AS cents FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT segment, c_custkey, cents, rank FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY cents DESC, c_custkey) AS rank FROM g) WHERE rank <= 15""")
def topn_per_segment(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    g = orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment", "c_custkey").agg(F.sum("cents").alias("cents"))
    return m.top_per_group(g, ["segment"], [F.col("cents").desc(), "c_custkey"], 15)


@query(f"""WITH {ORD}, x AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE cents END AS cents FROM o)
SELECT o_orderkey, cents FROM x ORDER BY cents DESC NULLS LAST, o_orderkey LIMIT 200""")
def rank_nulls_last(spark, d):
    x = orders(spark, d).withColumn("cents", F.when(~F.col("o_orderpriority").startswith("1"), F.col("cents")))
    return m.ranked(x, F.col("cents").desc_nulls_last(), 200, "o_orderkey", columns=["o_orderkey", "cents", "absent"])


_METRICS = ("cut", "tax", "price")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS ranking, l_orderkey, v FROM (SELECT l_orderkey, sum({c})::BIGINT AS v FROM ({BASE}) GROUP BY 1 ORDER BY v DESC, l_orderkey LIMIT 20)""" for c in _METRICS))
def all_rankings(spark, d):
    g = lines(spark, d).groupBy("l_orderkey").agg(*(F.sum(c).alias(c) for c in _METRICS))
    parts = [m.ranked(g.select(F.lit(c).alias("ranking"), "l_orderkey", F.col(c).alias("v")), F.col("v").desc(), 20, "l_orderkey") for c in _METRICS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_WIDE = f"""{ORD}, g AS (SELECT o_custkey AS item, o_orderstatus AS st, avg(cents) AS v FROM o GROUP BY 1, 2),
w AS (SELECT item, max(v) FILTER (WHERE st = 'F') AS a, max(v) FILTER (WHERE st = 'O') AS b FROM g GROUP BY item)"""


def _wide(spark, d):
    return m.compared(orders(spark, d), "o_custkey", "o_orderstatus", "F", "O", "cents")


@query(f"""WITH {_WIDE} SELECT item, round(a, 4) AS a, round(b, 4) AS b, round(a - b, 4) AS delta,
  CASE WHEN a IS NULL OR b IS NULL THEN 'n/a' WHEN a < b THEN 'F' WHEN b < a THEN 'O' ELSE 'tie' END AS better FROM w""")
def pivot_compare_status(spark, d):
    return _wide(spark, d).select(F.col("o_custkey").alias("item"), *(F.round(c, 4).alias(c) for c in ("a", "b", "delta")), "better")


@query(f"""WITH {_WIDE}, x AS (SELECT item, a - b AS d FROM w) SELECT count(*) FILTER (WHERE d < -1e-9) AS a_wins, count(*) FILTER (WHERE d > 1e-9) AS b_wins,
  count(*) FILTER (WHERE abs(d) <= 1e-9) AS ties, count(*) FILTER (WHERE d IS NULL) AS not_compared, round(avg(abs(d)), 3) AS mean_abs_delta,
  arg_max(item, abs(d)) AS largest_at FROM x""")
def head_to_head(spark, d):
    return m.head_to_head(_wide(spark, d), "o_custkey", "F", "O").withColumn("mean_abs_delta", F.round("mean_abs_delta", 3))


@query(f"""WITH {ORD}, x AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'under' WHEN c_acctbal > 0 THEN 'over' ELSE 'exact' END AS stratum FROM o JOIN customer ON o_custkey = c_custkey)
SELECT o_orderstatus AS status, stratum, count(*) AS n, sum(cents)::BIGINT AS cents, round(sum(CASE WHEN o_orderpriority LIKE '1%' THEN cents ELSE 0 END)::DOUBLE / sum(cents)::DOUBLE, 9) AS urgent
FROM x GROUP BY 1, 2""")
def stratify_balance(spark, d):
    x = orders(spark, d).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("stratum", bucket(F.col("c_acctbal")))
    urgent = F.sum(F.when(F.col("o_orderpriority").startswith("1"), F.col("cents")).otherwise(0))
    g = x.groupBy(F.col("o_orderstatus").alias("status"), "stratum").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), urgent.alias("u"))
    out = g.select("status", "stratum", "n", "cents", F.round(F.try_divide("u", "cents"), 9).alias("urgent"))
    return out.orderBy("status", F.when(F.col("stratum") == "under", 0).when(F.col("stratum") == "exact", 1).otherwise(2))


@query("""SELECT o_orderstatus AS status, round(corr(o_totalprice, o_orderkey), 6) AS r, round(avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0), 4) AS even_mean,
  NULL::DOUBLE AS constant FROM orders GROUP BY 1""")
def corr_conditional(spark, d):
    o = read(spark, d, "orders").withColumn("one", F.lit(1.0))
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.round(m.correlation("o_totalprice", "o_orderkey"), 6).alias("r"),
        F.round(F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))), 4).alias("even_mean"),
        m.correlation("o_totalprice", "one").alias("constant"),
    )


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark, d):
    return m.first_per_key(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT s_suppkey, r FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER () AS n FROM supplier) WHERE (r - 1) % 7 = 0 OR r <= 3 OR r > n - 3")
def systematic_sample(spark, d):
    w = Window.orderBy("s_acctbal", "s_suppkey")
    whole = Window.orderBy("s_acctbal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = read(spark, d, "supplier").select("s_suppkey", F.row_number().over(w).alias("r"), F.count("*").over(whole).alias("n"))
    return s.where("(r - 1) % 7 = 0 or r <= 3 or r > n - 3").select("s_suppkey", "r")


@query("""WITH a AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS g FROM documents),
b AS (SELECT *, CASE WHEN g = 1 THEN 0 ELSE 1 END AS later FROM a) SELECT doc_id, lang, n_chars FROM b ORDER BY later, n_chars, doc_id LIMIT 10""")
def shortest_per_group_fill(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("n_chars", "doc_id")) == 1
    return docs.withColumn("later", (~first).cast("int")).orderBy("later", "n_chars", "doc_id").limit(10).drop("later")


@query("""SELECT lang, min(n_chars) AS low, median(n_chars)::DOUBLE AS mid, round(avg(n_chars), 6) AS mean, max(n_chars) AS high, quantile_cont(n_chars::DOUBLE, 0.35) AS q35,
  count(*) FILTER (WHERE n_chars < 500) AS short, count(DISTINCT source) AS sources FROM documents GROUP BY lang""")
def profile_medians(spark, d):
    n = F.col("n_chars")
    return read(spark, d, "documents").groupBy("lang").agg(
        F.min(n).alias("low"), F.median(n).alias("mid"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("high"), F.percentile(n, F.lit(0.35)).alias("q35"),
        F.count_if(n < 500).alias("short"), F.count_distinct("source").alias("sources"),
    )


@query("""WITH x AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT coalesce(split, 'all') AS split, count(*) AS n, sum(cents)::BIGINT AS cents FROM x GROUP BY ROLLUP (split)""")
def split_rollup(spark, d):
    x = orders(spark, d).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.withColumn("split", F.when(F.col("c_custkey") % 2 == 0, "dev").otherwise("test"))
    return x.rollup("split").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).withColumn("split", F.coalesce("split", F.lit("all")))


@query("SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_partkey IS NOT NULL)")
def orphan_keys(spark, d):
    hit = read(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, d, "part").join(hit, "p_partkey", "left_anti").select(F.col("p_partkey").alias("key"))


@query("""SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
  EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'""")
def common_items(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'O'").select("k")).subtract(o.where("o_orderpriority like '1%'").select("k"))


@query("""WITH a AS (SELECT o_orderkey, sha1(o_orderstatus || '|' || o_custkey) AS h FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey, sha1(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_custkey) AS h FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS key, CASE WHEN a.h IS NULL THEN 'absent' WHEN b.h IS NULL THEN 'no_source' WHEN a.h = b.h THEN 'ok' ELSE 'mismatch' END AS state
FROM a FULL JOIN b USING (o_orderkey)""")
def stale_audit(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_custkey")
    mark = lambda st: F.sha1(F.concat(st, F.lit("|"), F.col("o_custkey").cast("string")).cast("binary")).alias("mark")
    stored = o.where("key % 10 <> 0").select("key", mark(F.col("o_orderstatus")))
    now = o.where("key % 11 <> 0").select("key", mark(F.when(F.col("key") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return guards.audit(stored, now, ["key"])


@query("""SELECT l_shipmonth AS month, flag, n, round(n / sum(n) OVER (PARTITION BY l_shipmonth)::DOUBLE, 9) AS part FROM
 (SELECT month(l_shipdate) AS l_shipmonth, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def crosstab_normalised(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.month("l_shipdate").cast("long").alias("month"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return m.shares(g, ["month"], ["n"]).select("month", "flag", "n", F.round("n_share", 9).alias("part"))


@query()
def bootstrap_delta(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") - 250_000).alias("delta"))
    return m.bootstrap(o, "delta", 10_000, 20260822)


@query("""SELECT l.toxic, d.lang, count(*) AS n, round(avg((d.n_chars < 1000)::INT), 9) AS short_rate FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def label_lift(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    return x.groupBy("toxic", "lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("n_chars") < 1000).cast("int")), 9).alias("short_rate"))
