"""Queries: the remaining table operators and models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions import kmers
from ..models import extra, forests, learners, mixed, sparse, structure
from ..operators import ld, more, qc
from ..sources import writers
from .core import COUNTS
from .models import _blocks, _calls, _dense
from .registry import query
from .views import table, view


@query("align_samples", "SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS idx FROM samples WHERE y > 0 AND sample_id IN (SELECT sample_id FROM geno WHERE g = 2) AND sample_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 100)", ("samples", "geno"))
def align_samples(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 100").withColumnRenamed("c_custkey", "sample_id")
    return more.align_samples(view(spark, d, "samples").filter("y > 0"), view(spark, d, "geno").filter("g = 2"), c)


@query("named_hits", "SELECT h.site_id, h.chrom, h.pos, s.snp FROM hits h LEFT JOIN (SELECT chrom, pos, min(snp) AS snp FROM sites WHERE ref <> alt GROUP BY chrom, pos) s ON h.chrom = s.chrom AND h.pos = s.pos", ("hits", "sites"))
def named_hits(spark, d):
    return more.add_names(view(spark, d, "hits"), view(spark, d, "sites").filter("ref <> alt")).select("site_id", "chrom", "pos", "snp")


@query("combination_summary", """WITH r AS (SELECT concat('rs', floor(site_id / 4)::BIGINT, CASE WHEN site_id % 3 = 0 THEN '&' ELSE '|' END, 'rs', site_id % 5) AS snp, CASE site_id % 4 WHEN 0 THEN 'combo' WHEN 1 THEN NULL WHEN 2 THEN 'single' ELSE '' END AS role, p, least(p * 3, 1) AS padj FROM hits),
f AS (SELECT * FROM r WHERE CASE WHEN role IS NOT NULL AND trim(role) <> '' THEN lower(trim(role)) = 'combo' ELSE regexp_matches(snp, '[&|*]') END),
x AS (SELECT snp, p, padj, unnest(regexp_split_to_array(snp, '[&|*]')) AS site FROM f)
SELECT snp AS combo, min(p) AS p, min(padj) AS padj, count(DISTINCT site) AS size FROM x GROUP BY snp HAVING count(DISTINCT site) >= 2""", ("hits",))
def combination_summary(spark, d):
    k = F.col("site_id")
    name = F.concat(F.lit("rs"), F.floor(k / 4).cast("string"), F.when(k % 3 == 0, "&").otherwise("|"), F.lit("rs"), (k % 5).cast("string"))
    role = F.when(k % 4 == 0, "combo").when(k % 4 == 2, "single").when(k % 4 == 3, "")
    rows = view(spark, d, "hits").select(name.alias("snp"), role.alias("role"), "p", F.least(F.col("p") * 3, F.lit(1.0)).alias("padj"))
    return more.combination_summary(rows.filter(more.is_combination(F.col("role"), F.col("snp"))))


@query("significant_table", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY p, site_id) AS rn FROM hits WHERE p <= 0.05) SELECT site_id, chrom, pos, p, row_number() OVER (ORDER BY p, site_id) AS rank FROM b WHERE rn = 1", ("hits",))
def significant_table(spark, d):
    return more.significant_table(view(spark, d, "hits"), 0.05).select("site_id", "chrom", "pos", "p", "rank")


@query("lead_windows", """WITH w AS (SELECT chrom, greatest(pos - 2500, 0) AS start, pos + 2500 AS stop FROM hits WHERE p <= 0.15), r AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS id FROM r)
SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY chrom, id""", ("hits",))
def lead_windows(spark, d):
    return more.lead_windows(view(spark, d, "hits"), 0.15, 2500)


@query("lead_r2", """WITH m AS (SELECT site_id, avg(g) AS m FROM geno GROUP BY site_id), x AS (SELECT g.site_id, sample_id, coalesce(g, m, 0) AS x FROM geno g JOIN m ON g.site_id = m.site_id),
l AS (SELECT site_id AS lead, chrom, pos FROM hits WHERE p <= 0.02), n AS (SELECT lead, s.site_id FROM l JOIN sites s ON s.chrom = l.chrom AND abs(s.pos - l.pos) <= 3000),
t AS (SELECT lead, n.site_id, count(*) AS n, sum(a.x) AS sx, sum(b.x) AS sy, sum(a.x * a.x) AS sxx, sum(b.x * b.x) AS syy, sum(a.x * b.x) AS sxy FROM n JOIN x a ON a.site_id = lead JOIN x b ON b.site_id = n.site_id AND b.sample_id = a.sample_id GROUP BY 1, 2)
SELECT lead, site_id, n, round(CASE WHEN n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9 THEN pow(n * sxy - sx * sy, 2) / ((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 6) AS r2 FROM t WHERE n >= 3 AND n * sxx - sx * sx > 1e-6 AND n * syy - sy * sy > 1e-6""", ("geno", "sites", "hits"))
def lead_r2(spark, d):
    r = more.lead_r2(view(spark, d, "geno"), view(spark, d, "sites"), view(spark, d, "hits").filter("p <= 0.02"), 3000)
    return r.filter("n >= 3 and r2 is not null and r2 <= 1.000001").select("lead", "site_id", "n", F.round("r2", 6).alias("r2"))


@query("region_ld", """WITH q AS (SELECT g.*, chrom, pos FROM geno g JOIN sites s ON g.site_id = s.site_id WHERE g IS NOT NULL AND chrom = '3' AND pos BETWEEN 1 AND 60000),
ps AS (SELECT a.site_id AS i, b.site_id AS j, count(*) AS n, CAST(sum(a.g) AS DOUBLE) AS si, CAST(sum(b.g) AS DOUBLE) AS sj, CAST(sum(a.g * a.g) AS DOUBLE) AS sii, CAST(sum(b.g * b.g) AS DOUBLE) AS sjj, CAST(sum(a.g * b.g) AS DOUBLE) AS sij FROM q a JOIN q b ON a.sample_id = b.sample_id AND b.pos > a.pos GROUP BY 1, 2)
SELECT i, j, n, round(CASE WHEN n * sii > si * si AND n * sjj > sj * sj THEN pow((n * sij - si * sj) / sqrt((n * sii - si * si) * (n * sjj - sj * sj)), 2) END, 9) AS r2 FROM ps""", ("geno", "sites"))
def region_ld(spark, d):
    region = qc.keep_sites(view(spark, d, "sites"), spans=[("3", 1, 60000)])
    return ld.r_squared(ld.pair_sums(view(spark, d, "geno"), region, 60000)).select("i", "j", "n", F.round("r2", 9).alias("r2"))


@query("benchmark_merge", """WITH a AS (SELECT l_suppkey AS k, round(avg(l_quantity), 6) AS a FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 <> 0 GROUP BY 1), r AS (SELECT l_suppkey AS k, round(avg(l_quantity), 6) AS r FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 4 <> 0 GROUP BY 1)
SELECT coalesce(a.k, r.k) AS k, a, r, round(a - r, 6) AS diff FROM a FULL JOIN r ON a.k = r.k""")
def benchmark_merge(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    one = lambda flag, m, name: l.filter((F.col("l_returnflag") == flag) & (F.col("l_suppkey") % m != 0)).groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_quantity"), 6).alias(name))
    return one("A", 3, "a").join(one("R", 4, "r"), "k", "full").withColumn("diff", F.round(F.col("a") - F.col("r"), 6))


@query("panel_size", "SELECT (SELECT count(*) FROM sites) AS n_sites, (SELECT count(*) FROM samples) AS n_samples, (SELECT count(*) FROM geno) AS n_calls, (SELECT count(*) FROM geno WHERE g IS NULL) AS n_missing", ("sites", "samples", "geno"))
def panel_size(spark, d):
    g = view(spark, d, "geno").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("g").isNull()).alias("n_missing"))
    n = view(spark, d, "sites").agg(F.count(F.lit(1)).alias("n_sites")).join(view(spark, d, "samples").agg(F.count(F.lit(1)).alias("n_samples")), F.lit(True))
    return n.join(g, F.lit(True)).select("n_sites", "n_samples", "n_calls", "n_missing")


@query("clean_chroms", """WITH c AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN concat('chr', p_size) WHEN 1 THEN concat(' Chr0', p_size, ' ') WHEN 2 THEN 'chrX' WHEN 3 THEN concat(p_size, '.0') WHEN 4 THEN 'na' ELSE concat('scaffold_', p_size) END AS raw FROM part), n AS (SELECT raw, regexp_replace(upper(trim(raw)), '^CHR', '') AS u FROM c)
SELECT raw, CASE WHEN u IN ('', 'NA', 'NULL', 'NAN') THEN NULL WHEN regexp_full_match(u, '[0-9]+([.]0+)?') THEN CAST(CAST(CAST(u AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE u END AS chrom FROM n""")
def clean_chroms(spark, d):
    k, z = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("chr"), z)).when(k == 1, F.concat(F.lit(" Chr0"), z, F.lit(" "))).when(k == 2, "chrX").when(k == 3, F.concat(z, F.lit(".0"))).when(k == 4, "na").otherwise(F.concat(F.lit("scaffold_"), z))
    return table(spark, d, "part").select(raw.alias("raw")).distinct().withColumn("chrom", more.clean_chrom(F.col("raw")))


@query("allele_codes", """SELECT ref, alt, translate(ref, 'ACGT', 'TGCA') AS complement, CASE least(ref, alt) || greatest(ref, alt) WHEN 'AA' THEN 'A' WHEN 'CC' THEN 'C' WHEN 'GG' THEN 'G' WHEN 'TT' THEN 'T' WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' ELSE 'N' END AS code, count(*) AS n FROM sites GROUP BY ALL""", ("sites",))
def allele_codes(spark, d):
    from ..operators.merge import complement

    s = view(spark, d, "sites")
    return s.groupBy("ref", "alt").agg(F.count(F.lit(1)).alias("n")).select("ref", "alt", complement(F.col("ref")).alias("complement"), more.iupac(F.col("ref"), F.col("alt")).alias("code"), "n")


@query("output_statistics", "SELECT site_id, round(CASE WHEN site_id % 5 > 0 THEN pow(beta / ((site_id % 5) / 4.0::DOUBLE), 2) ELSE 0 END, 6) AS chisq, round(-log10(least(greatest(CASE WHEN site_id % 7 = 0 THEN 1 ELSE p END, 2.2250738585072014e-308), 1)), 6) AS height FROM hits", ("hits",))
def output_statistics(spark, d):
    h = view(spark, d, "hits").withColumns({"se": F.col("site_id") % 5 / F.lit(4.0), "q": F.when(F.col("site_id") % 7 == 0, None).otherwise(F.col("p"))})
    return h.select("site_id", F.round(more.chisq_of(F.col("beta"), F.col("se")), 6).alias("chisq"), F.abs(F.round(-F.log10(more.clamp_p(F.col("q"))), 6)).alias("height"))


@query("compress_effects", """WITH r AS (SELECT *, row_number() OVER (ORDER BY abs(beta) DESC, site_id) AS r FROM hits), k AS (SELECT *, row_number() OVER (PARTITION BY chrom, floor(pos / 25000.0) ORDER BY r) AS k FROM r WHERE r > 30)
SELECT site_id, beta FROM r WHERE r <= 30 UNION ALL SELECT site_id, beta FROM k WHERE k = 1""", ("hits",))
def compress_effects(spark, d):
    return more.compress_effects(view(spark, d, "hits"), 30, 25000).select("site_id", "beta")


@query("prepared_sites", f"WITH {COUNTS} SELECT site_id, round(miss, 9) AS miss, round(maf, 9) AS maf, round(sqrt(2 * maf * (1 - maf)), 9) AS sd, freq > 0.5 AS flip, (miss <= 0.1 AND maf >= 0.2) AS keep FROM s", ("geno",))
def prepared_sites(spark, d):
    p = more.prepared_sites(qc.site_rates(qc.site_counts(view(spark, d, "geno"))), 0.2, 0.1)
    return p.select("site_id", *(F.round(c, 9).alias(c) for c in ("miss", "maf", "sd")), "flip", "keep")


@query("site_covariates", "SELECT sample_id, max(CASE WHEN chrom = '1' AND pos = 1 THEN g END) AS \"1_1\", max(CASE WHEN chrom = '4' AND pos = 2001 THEN g END) AS \"4_2001\" FROM geno JOIN sites ON geno.site_id = sites.site_id WHERE (chrom = '1' AND pos = 1) OR (chrom = '4' AND pos = 2001) GROUP BY sample_id", ("geno", "sites"))
def site_covariates(spark, d):
    return more.site_covariates(view(spark, d, "geno"), view(spark, d, "sites"), [("1", 1), ("4", 2001)])


@query("rate_table_text", f"WITH {COUNTS} SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), printf('%.6f', miss)) AS value FROM s JOIN sites ON s.site_id = sites.site_id", ("geno", "sites"))
def rate_table_text(spark, d):
    return writers.rate_table(qc.site_rates(qc.site_counts(view(spark, d, "geno"))), view(spark, d, "sites"), "miss")


@query("kmer_matrix", """WITH n AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS b FROM (SELECT DISTINCT event_type FROM events)), u AS (SELECT DISTINCT user_id, b FROM events JOIN n ON events.event_type = n.event_type)
SELECT user_id, CAST(sum(CAST(pow(2, b) AS BIGINT)) AS BIGINT) AS word FROM u GROUP BY user_id""")
def kmer_matrix(spark, d):
    """Presence rows as bit words: the event types of each user, by the types' order."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    n = e.select("event_type").distinct().withColumn("b", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    return kmers.pack_bits(e.join(F.broadcast(n), "event_type"), "user_id", "b").select("user_id", F.col("words")[0].alias("word"))


@query("sparse_mixed_scan")
def sparse_mixed_scan(spark, d):
    _, y, rows, k = _dense(spark, d)
    return extra.sparse_scan(rows, k, y, 0.05)


@query("low_rank_mixed_scan")
def low_rank_mixed_scan(spark, d):
    _, y, rows, _ = _dense(spark, d, related=False)
    wanted = view(spark, d, "sites").filter("gene_set = 'Brand#3'").select("site_id")
    z = mixed.as_matrix(rows.join(wanted, "site_id", "left_semi").toArrow().sort_by("site_id")["g"].combine_chunks()).T
    return mixed.scan(rows, extra.low_rank(z - z.mean(0), y), "fvlmm")


@query("adaptive_lasso_scan")
def adaptive_lasso_scan(spark, d):
    _, y, rows, _ = _dense(spark, d, related=False)
    return extra.conditional_scan(rows, y, 200)[0]


@query("context_scan")
def context_scan(spark, d):
    _, y, rows = _calls(spark, d)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    chosen = {r["site_id"]: (r["chrom"], r["pos"]) for r in view(spark, d, "hits").join(rows.select("site_id"), "site_id", "left_semi").orderBy("p", "site_id").limit(4).collect()}
    return extra.context_scan(rows, view(spark, d, "sites"), y, chosen, 10000)


@query("null_likelihood_ratio")
def null_likelihood_ratio(spark, d):
    _, y, blocks = _blocks(spark, d)
    lm, stat, p = extra.prefers_lm(sparse.Spectrum(blocks, y), y, x=np.ones((len(y), 1)))
    return spark.createDataFrame([(bool(lm), float(stat), float(p))], "prefers_lm boolean, statistic double, p double")


@query("mean_comparison_letters")
def mean_comparison_letters(spark, d):
    g = sorted((r["p_type"], r["m"], r["n"], r["v"]) for r in table(spark, d, "part").groupBy("p_type").agg(F.avg("p_size").alias("m"), F.count(F.lit(1)).alias("n"), F.var_samp("p_size").alias("v")).collect())
    df = sum(n - 1 for _, _, n, _ in g)
    mse = sum((n - 1) * v for _, _, n, v in g) / df
    letters = extra.tukey_letters([t for t, *_ in g], [m for _, m, *_ in g], [n for *_, n, _ in g], mse, df)
    return spark.createDataFrame([(t, float(m), n, letters[t]) for t, m, n, _ in g], "grp string, mean double, n long, letters string")


@query("network_modules")
def network_modules(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("f", "x"))
    pairs = ld.correlation_pairs(e.select("vec_id", F.col("f").cast("long").alias("f"), F.col("x").cast("double").alias("x")), "vec_id", "f", "x")
    tom = ld.topological_overlap(ld.adjacency(pairs, 2)).collect()
    n = 1 + max(r["j"] for r in tom)
    dist = np.ones((n, n))
    np.fill_diagonal(dist, 0)
    for r in tom:
        dist[r["i"], r["j"]] = dist[r["j"], r["i"]] = 1 - r["tom"]
    return spark.createDataFrame([(k, int(c)) for k, c in enumerate(structure.average_linkage(dist, 0.97))], "feature long, module int")


@query("forest_predictions")
def forest_predictions(spark, d):
    ids, y, rows = _calls(spark, d)
    sites, n = forests.numbered(rows)
    samples = view(spark, d, "samples").select("sample_id", "fold")
    fold = samples.orderBy("sample_id").toArrow()["fold"].to_numpy()
    data = learners.sample_rows(sites, ids, y).persist()
    out = learners.predict_out_of_fold(data, "enet", samples, 5).select(F.lit("enet").alias("method"), "sample_id", "y", "pred")
    for method, fit in (("rf", forests.random_forest), ("gbdt", forests.boosted_trees)):
        part = pa.table({"method": [method] * len(ids), "sample_id": np.array(ids, np.int64), "y": y, "pred": fit(sites, n, y, fold)})
        out = spark.createDataFrame(part).unionByName(out)
    return out


@query("permutation_null")
def permutation_null(spark, d):
    r = view(spark, d, "samples").select("sample_id", F.col("case_status").alias("y"))
    return more.permutation_null(view(spark, d, "geno").filter("g >= 1"), r, "site_id", 5)
