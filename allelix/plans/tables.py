"""Queries: averaging, ranking, pivots, comparisons, registries, set operations, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as ops
from .registry import query
from .views import table, view


@query("average_duplicates", "SELECT l_suppkey AS id, round(avg(l_extendedprice), 6) AS price, round(avg(l_quantity), 6) AS quantity, min(l_orderkey) AS first_seen FROM lineitem GROUP BY l_suppkey")
def average_duplicates(spark, d):
    a = ops.average_duplicates(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "id"), "id", ["l_extendedprice", "l_quantity"], "l_orderkey")
    return a.select("id", F.round("l_extendedprice", 6).alias("price"), F.round("l_quantity", 6).alias("quantity"), "first_seen")


@query("effective_counts", "WITH p AS (SELECT l_suppkey, count(DISTINCT l_partkey % 50) AS e, count(*) AS p FROM lineitem GROUP BY l_suppkey) SELECT count(*) AS lines, round(count(*) / sum(1.0::DOUBLE / e), 6) AS h_env, round(count(*) / sum(1.0::DOUBLE / p), 6) AS h_plot FROM p")
def effective_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("line"), (F.col("l_partkey") % 50).alias("env"))
    return ops.effective_counts(rows, "line", "env").select("lines", F.round("h_env", 6).alias("h_env"), F.round("h_plot", 6).alias("h_plot"))


RUNS = """runs AS (SELECT event_type AS model, concat('t', user_id % 7) AS trait, CAST(event_id % 5 AS INT) AS fold, event_id, CAST(round(value * 100) AS BIGINT) % 1000 / 1000.0::DOUBLE AS pearson, event_id % 97 / 97.0::DOUBLE AS r2, user_id / 8.0::DOUBLE AS seconds FROM events)"""


def _runs(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("trait"), (F.col("event_id") % 5).cast("int").alias("fold"), "event_id",
        (F.round(F.col("value") * 100).cast("long") % 1000 / F.lit(1000.0)).alias("pearson"), (F.col("event_id") % 97 / F.lit(97.0)).alias("r2"), (F.col("user_id") / F.lit(8.0)).alias("seconds"))


@query("rank_models", f"""WITH {RUNS}, a AS (SELECT model, count(DISTINCT trait) AS n_traits, round(avg(pearson), 9) AS pearson, round(avg(r2), 9) AS r2, round(avg(seconds), 9) AS seconds FROM runs GROUP BY model)
SELECT *, row_number() OVER (ORDER BY pearson DESC, r2 DESC, seconds, model) AS rank FROM a""")
def rank_models(spark, d):
    return ops.rank_models(_runs(spark, d))


BEST = "one AS (SELECT model, trait, fold, max(pearson) AS pearson, max(r2) AS r2 FROM runs GROUP BY ALL)"


@query("vote_best", f"WITH {RUNS}, {BEST}, w AS (SELECT *, row_number() OVER (PARTITION BY trait, fold ORDER BY round(pearson, 3) DESC, r2 DESC, model) AS rn FROM one) SELECT trait, model, count(*) AS wins FROM w WHERE rn = 1 GROUP BY 1, 2")
def vote_best(spark, d):
    return ops.vote_best(_runs(spark, d).groupBy("model", "trait", "fold").agg(F.max("pearson").alias("pearson"), F.max("r2").alias("r2")))


@query("rank_by_trait", f"WITH {RUNS}, {BEST} SELECT trait, model, fold, row_number() OVER (PARTITION BY trait ORDER BY pearson DESC, r2 DESC, model, fold) AS rank FROM one")
def rank_by_trait(spark, d):
    one = _runs(spark, d).groupBy("model", "trait", "fold").agg(F.max("pearson").alias("pearson"), F.max("r2").alias("r2"))
    return ops.rank_within(one, "trait", [F.desc("pearson"), F.desc("r2"), F.col("model"), F.col("fold")]).select("trait", "model", "fold", "rank")


@query("best_per_position", "SELECT chrom, CAST(floor(pos / 10000.0) AS BIGINT) AS pos, min(p) AS p FROM hits GROUP BY 1, 2", ("hits",))
def best_per_position(spark, d):
    return ops.best_per_position(view(spark, d, "hits").withColumn("pos", F.floor(F.col("pos") / 10000)))


@query("quantile_thresholds", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.005), 6) AS q005, round(quantile_cont(l_extendedprice, 0.5), 6) AS q500, round(quantile_cont(l_extendedprice, 0.995), 6) AS q995 FROM lineitem GROUP BY l_returnflag")
def quantile_thresholds(spark, d):
    q = ops.quantile_thresholds(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.005, 0.5, 0.995])
    return q.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("q005", "q500", "q995")))


@query("quantile_strata", """WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
SELECT p_brand, CAST(CASE WHEN p_retailprice <= a THEN 0 WHEN p_retailprice <= b THEN 1 WHEN p_retailprice <= c THEN 2 ELSE 3 END AS INT) AS stratum, count(*) AS n FROM part, q GROUP BY 1, 2""")
def quantile_strata(spark, d):
    p = table(spark, d, "part")
    q = p.agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    above = sum((F.col("p_retailprice") > F.col("q")[k]).cast("int") for k in range(3))
    return p.join(F.broadcast(q), F.lit(True)).groupBy("p_brand", above.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("frequent_groups", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n FROM c WHERE n >= (SELECT median(n) * 0.8 FROM (SELECT n FROM c ORDER BY n DESC, o_custkey LIMIT 10))")
def frequent_groups(spark, d):
    return ops.frequent_groups(table(spark, d, "orders"), "o_custkey", 10, 0.8)


@query("pivot_predictions", f"""WITH {RUNS} SELECT trait, fold, {", ".join(f"min(CASE WHEN model = '{m}' THEN pearson END) AS pearson__{m}, min(CASE WHEN model = '{m}' THEN r2 END) AS r2__{m}" for m in ("click", "view", "purchase"))} FROM runs GROUP BY trait, fold""")
def pivot_predictions(spark, d):
    return ops.pivot_first(_runs(spark, d), ["trait", "fold"], "model", ["click", "view", "purchase"], ["pearson", "r2"])


@query("compare_engines", f"""WITH {RUNS}, o AS (SELECT model, event_id % 500 AS k, CAST(min(round(pearson * 1000)) AS BIGINT) AS v FROM runs GROUP BY 1, 2),
s AS (SELECT a.model AS a, b.model AS b, count(*) AS n, CAST(sum(a.v) AS DOUBLE) AS sx, CAST(sum(b.v) AS DOUBLE) AS sy, CAST(sum(a.v * a.v) AS DOUBLE) AS sxx, CAST(sum(b.v * b.v) AS DOUBLE) AS syy, CAST(sum(a.v * b.v) AS DOUBLE) AS sxy, avg((a.v - b.v) * (a.v - b.v)) AS ms
  FROM o a JOIN o b ON a.k = b.k AND a.model < b.model GROUP BY 1, 2)
SELECT a, b, n, round(CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 9) AS r, round(sqrt(ms), 6) AS rmse FROM s""")
def compare_engines(spark, d):
    o = _runs(spark, d).groupBy("model", (F.col("event_id") % 500).alias("k")).agg(F.min(F.round(F.col("pearson") * 1000)).cast("long").alias("v"))
    return ops.compare_pairs(o, ["k"], "model", "v").select("a", "b", "n", F.round("r", 9).alias("r"), F.round("rmse", 6).alias("rmse"))


@query("haplotype_counts", """WITH b AS (SELECT site_id, chrom, pos, concat(chrom, ':', CAST(floor(pos / 2000.0) AS INT)) AS block FROM sites), n AS (SELECT block, count(*) AS n FROM b GROUP BY block),
h AS (SELECT block, sample_id, string_agg(CAST(g AS VARCHAR), '' ORDER BY pos, b.site_id) AS haplotype, count(*) AS k FROM geno g JOIN b ON g.site_id = b.site_id WHERE g IS NOT NULL GROUP BY 1, 2),
f AS (SELECT h.block, haplotype, count(*) AS n, count(*) FILTER (WHERE case_status = 1) AS cases FROM h JOIN n ON h.block = n.block AND h.k = n.n JOIN samples s ON s.sample_id = h.sample_id GROUP BY 1, 2)
SELECT block, haplotype, n, cases, round(greatest((cases / n::DOUBLE + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt((cases / n::DOUBLE * (1 - cases / n::DOUBLE) + 3.841458820694124 / (4 * n)) / n) / (1 + 3.841458820694124 / n), 0), 6) AS low,
  round(least((cases / n::DOUBLE + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + 1.959963984540054 * sqrt((cases / n::DOUBLE * (1 - cases / n::DOUBLE) + 3.841458820694124 / (4 * n)) / n) / (1 + 3.841458820694124 / n), 1), 6) AS high FROM f""", ("sites", "geno", "samples"))
def haplotype_counts(spark, d):
    s = view(spark, d, "sites")
    blocks = s.withColumn("block", F.concat_ws(":", "chrom", F.floor(F.col("pos") / 2000).cast("int").cast("string")))
    h = ops.haplotypes(view(spark, d, "geno"), blocks, "block").join(view(spark, d, "samples").select("sample_id", "case_status"), "sample_id")
    f = h.groupBy("block", "haplotype").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("case_status") == 1).alias("cases"))
    low, high = ops.wilson(F.col("cases"), F.col("n"))
    return f.select("block", "haplotype", "n", "cases", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("prefix_rhat", """WITH x AS (SELECT event_type AS parameter, CAST(user_id % 3 AS INT) AS chain, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS step, value AS x FROM events),
r AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS m, var_samp(x) OVER w AS v FROM x WINDOW w AS (PARTITION BY parameter, chain ORDER BY step ROWS UNBOUNDED PRECEDING)),
g AS (SELECT parameter, step, max(n) AS n, avg(v) AS w, var_samp(m) AS bm FROM r GROUP BY 1, 2)
SELECT parameter, step, round(CASE WHEN n > 1 AND w > 0 THEN greatest(sqrt(((n - 1) / n::DOUBLE * w + bm) / w), 1) END, 6) AS rhat FROM g""")
def prefix_rhat(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("parameter", "chain").orderBy("event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("parameter"), (F.col("user_id") % 3).cast("int").alias("chain"), F.col("value").alias("x"), "event_id")
    return ops.prefix_rhat(e.withColumn("step", F.row_number().over(w).cast("long"))).withColumn("rhat", F.round("rhat", 6))


@query("registry_upsert", """SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def registry_upsert(spark, d):
    e = table(spark, d, "events")
    latest = ops.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "ts", "event_id")
    return latest.select("user_id", "event_id", "event_type", ops.json_field(F.col("props"), "$.k", "long").alias("k"))


@query("site_set_operations", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM r)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM r)) AS only_a, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM r)) AS n_union""")
def site_set_operations(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    per = l.filter("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    return per.agg(F.count_if(F.col("a") & F.col("r")).alias("n_both"), F.count_if(F.col("a") & ~F.col("r")).alias("only_a"), F.count(F.lit(1)).alias("n_union"))


@query("prediction_metrics", """WITH x AS (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS y, CAST(round(l_quantity * 150000) AS BIGINT) AS f FROM lineitem),
s AS (SELECT l_suppkey, count(*) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(f) AS DOUBLE) AS sf, CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(f * f) AS DOUBLE) AS sff, CAST(sum(y * f) AS DOUBLE) AS sfy, CAST(sum((y - f) * (y - f)) AS DOUBLE) AS sse, CAST(sum(abs(y - f)) AS DOUBLE) AS sae FROM x GROUP BY l_suppkey)
SELECT l_suppkey, n, round(CASE WHEN n * syy > sy * sy AND n * sff > sf * sf THEN (n * sfy - sf * sy) / sqrt((n * sff - sf * sf) * (n * syy - sy * sy)) END, 9) AS pearson, round(CASE WHEN syy - sy * sy / n > 0 THEN 1 - sse / (syy - sy * sy / n) END, 9) AS r2, round(sse / n / 1e6, 3) AS mse, round(sae / n, 3) AS mae FROM s""")
def prediction_metrics(spark, d):
    from ..functions.stats import pearson

    x = table(spark, d, "lineitem").select("l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("y"), F.round(F.col("l_quantity") * 150000).cast("long").alias("f"))
    y, f = F.col("y"), F.col("f")
    s = x.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).cast("double").alias(a) for a, e in (("sy", y), ("sf", f), ("syy", y * y), ("sff", f * f), ("sfy", y * f), ("sse", (y - f) * (y - f)), ("sae", F.abs(y - f)))))
    st = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = pearson(*(F.col(c) for c in ("n", "sf", "sy", "sff", "syy", "sfy")))
    return s.select("l_suppkey", "n", F.round(r, 9).alias("pearson"), F.round(F.when(st > 0, 1 - F.col("sse") / st), 9).alias("r2"), F.round(F.col("sse") / F.col("n") / 1e6, 3).alias("mse"), F.round(F.col("sae") / F.col("n"), 3).alias("mae"))


@query("event_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extension: tumbling windows over event time."""
    w = table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("event_sessions", """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL '5 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return ops.sessions(table(spark, d, "events"), "user_id", "ts", "5 hours")
