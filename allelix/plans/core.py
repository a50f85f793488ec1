"""Queries: quality control, site and sample statistics, linear scans, filters and codings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import assoc, qc
from .registry import query
from .views import table, view

COUNTS = """c AS (SELECT site_id, count(*) AS n, count(*) FILTER (WHERE g IS NULL) AS missing, count(*) FILTER (WHERE g = 1) AS het,
  count(*) FILTER (WHERE g = 2) AS hom_alt, CAST(coalesce(sum(g), 0) AS BIGINT) AS dosage FROM geno GROUP BY site_id),
r AS (SELECT *, CASE WHEN n > missing THEN dosage / (2.0::DOUBLE * (n - missing)) ELSE 0 END AS freq,
  CASE WHEN n > missing THEN het / (n - missing)::DOUBLE ELSE 0 END AS het_rate, missing / n::DOUBLE AS miss FROM c),
s AS (SELECT *, least(freq, 1 - freq) AS maf FROM r),
v AS (SELECT *, CASE WHEN miss > 0.1 THEN 'missing' WHEN n = missing THEN 'all_missing' WHEN het_rate > 0.6 THEN 'het' WHEN maf < 0.2 THEN 'maf' END AS verdict FROM s)"""
MAF, MISS, HET = 0.2, 0.1, 0.6


@query("site_rates", f"WITH {COUNTS} SELECT site_id, n, missing, round(freq, 9) AS freq, round(maf, 9) AS maf, round(miss, 9) AS miss, round(het_rate, 9) AS het_rate FROM s", ("geno",))
def site_rates(spark, d):
    r = qc.site_rates(qc.site_counts(view(spark, d, "geno")))
    return r.select("site_id", "n", "missing", *(F.round(c, 9).alias(c) for c in ("freq", "maf", "miss", "het_rate")))


@query("sample_rates", """SELECT sample_id, count(*) AS n, round(count(*) FILTER (WHERE g IS NULL) / count(*)::DOUBLE, 9) AS miss,
  round(CASE WHEN count(g) > 0 THEN count(*) FILTER (WHERE g = 1) / count(g)::DOUBLE ELSE 0 END, 9) AS het_rate FROM geno GROUP BY sample_id""", ("geno",))
def sample_rates(spark, d):
    r = qc.site_rates(qc.site_counts(view(spark, d, "geno"), "sample_id"))
    return r.select("sample_id", "n", F.round("miss", 9).alias("miss"), F.round("het_rate", 9).alias("het_rate"))


@query("joint_margins", """SELECT site_id, sample_id, count(*) AS n, count(*) FILTER (WHERE g IS NULL) AS missing, count(*) FILTER (WHERE g = 1) AS het
  FROM geno GROUP BY GROUPING SETS ((site_id), (sample_id))""", ("geno",))
def joint_margins(spark, d):
    return qc.both_margins(view(spark, d, "geno"))


@query("qc_verdicts", f"WITH {COUNTS} SELECT coalesce(verdict, 'kept') AS verdict, count(*) AS sites FROM v GROUP BY 1", ("geno",))
def qc_verdicts(spark, d):
    v = qc.qc_verdict(qc.site_rates(qc.site_counts(view(spark, d, "geno"))), MAF, MISS, HET)
    return v.groupBy(F.coalesce("verdict", F.lit("kept")).alias("verdict")).agg(F.count(F.lit(1)).alias("sites"))


@query("qc_kept_sites", f"WITH {COUNTS} SELECT site_id, round(maf, 9) AS maf FROM v WHERE verdict IS NULL", ("geno",))
def qc_kept_sites(spark, d):
    return qc.qc_filter(view(spark, d, "geno"), MAF, MISS, HET).select("site_id", F.round("maf", 9).alias("maf"))


@query("flip_to_minor", f"""WITH {COUNTS} SELECT g.site_id, g.sample_id, CAST(CASE WHEN freq > 0.5 THEN 2 - g.g ELSE g.g END AS INT) AS g, freq > 0.5 AS flipped
  FROM geno g JOIN s ON g.site_id = s.site_id""", ("geno",))
def flip_to_minor(spark, d):
    g = view(spark, d, "geno")
    return qc.flip_minor(g, qc.site_rates(qc.site_counts(g))).select("site_id", "sample_id", F.col("g").cast("int").alias("g"), "flipped")


@query("impute_mean", """SELECT site_id, sample_id, round(coalesce(g, avg(g) OVER (PARTITION BY site_id), 0), 9) AS g FROM geno""", ("geno",))
def impute_mean(spark, d):
    return qc.impute_mean(view(spark, d, "geno")).withColumn("g", F.round("g", 9))


@query("impute_mode", """WITH k AS (SELECT site_id, count(*) FILTER (WHERE g = 0) AS a, count(*) FILTER (WHERE g = 1) AS b, count(*) FILTER (WHERE g = 2) AS c FROM geno GROUP BY site_id)
SELECT geno.site_id, sample_id, CAST(coalesce(g, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END) AS INT) AS g FROM geno JOIN k ON geno.site_id = k.site_id""", ("geno",))
def impute_mode(spark, d):
    return qc.impute_mode(view(spark, d, "geno"))


@query("model_coding", """SELECT g, CAST(g AS INT) AS g_add, CAST(g >= 1 AS INT) AS g_dom, CAST(g >= 2 AS INT) AS g_rec, CAST(g = 1 AS INT) AS g_het, count(*) AS n FROM geno GROUP BY g""", ("geno",))
def model_coding(spark, d):
    g = F.col("g")
    coded = view(spark, d, "geno").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return coded.select("g", *(qc.code_model(g, m).cast("int").alias(f"g_{m}") for m in ("add", "dom", "rec", "het")), "n")


@query("logic_mask", """SELECT site_id, count(*) AS n, count(*) FILTER (WHERE g IS NULL OR g = 1) AS bad FROM geno GROUP BY site_id
  HAVING count(*) FILTER (WHERE g IS NULL OR g = 1) <= 0.4 * count(*)""", ("geno",))
def logic_mask(spark, d):
    return qc.logic_mask(view(spark, d, "geno"), 0.4)


@query("simple_snps", "SELECT site_id, ref, alt FROM sites WHERE ref <> alt", ("sites",))
def simple_snps(spark, d):
    return view(spark, d, "sites").filter(qc.is_simple_snp(F.col("ref"), F.col("alt"))).select("site_id", "ref", "alt")


@query("keep_sites_ranges", """SELECT site_id, chrom, pos FROM sites WHERE pos >= 2000 AND chrom IN ('1', '2', '3', '7')
  AND ((chrom = '1' AND pos BETWEEN 1000 AND 90000) OR (chrom = '7' AND pos BETWEEN 5000 AND 60000) OR (chrom = '9' AND pos BETWEEN 1 AND 9))""", ("sites",))
def keep_sites_ranges(spark, d):
    spans = [("1", 1000, 90000), ("7", 5000, 60000), ("9", 1, 9)]
    return qc.keep_sites(view(spark, d, "sites"), qc.expand_selector("1-3,7"), bp_min=2000, spans=spans).select("site_id", "chrom", "pos")


@query("keep_sites_exact", "SELECT s.site_id, s.snp FROM sites s WHERE EXISTS (SELECT 1 FROM features f WHERE f.chrom = s.chrom AND f.start = s.pos)", ("sites", "features"))
def keep_sites_exact(spark, d):
    exact = view(spark, d, "features").select("chrom", F.col("start").alias("pos"))
    return qc.keep_sites(view(spark, d, "sites"), exact=exact).select("site_id", "snp")


@query("rename_snps", "SELECT site_id, concat('chr', chrom, '_', pos, ':', ref) AS snp FROM sites", ("sites",))
def rename_snps(spark, d):
    named = qc.rename_snps(view(spark, d, "sites"), "chrCHR_POS:")
    return named.select("site_id", F.concat("snp", "ref").alias("snp"))


@query("project_samples", """SELECT s.sample_id, s.iid, w.ord FROM samples s JOIN (SELECT c_custkey % 50 AS sample_id, min(c_custkey) AS ord FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) w
  ON s.sample_id = w.sample_id""", ("samples",))
def project_samples(spark, d):
    wanted = table(spark, d, "customer").filter("c_custkey % 3 = 0").select((F.col("c_custkey") % 50).alias("sample_id"), F.col("c_custkey").alias("ord"))
    return qc.in_order(view(spark, d, "samples"), wanted, "sample_id").select("sample_id", "iid", "ord")


LM = """y AS (SELECT sample_id, CAST(round(y * 100) AS BIGINT) AS y FROM samples),
m AS (SELECT site_id, count(*) AS n, CAST(sum(g) AS DOUBLE) AS sg, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(g * g) AS DOUBLE) AS sgg, CAST(sum(y * y) AS DOUBLE) AS syy,
  CAST(sum(g * y) AS DOUBLE) AS sgy FROM geno JOIN y USING (sample_id) WHERE g IS NOT NULL GROUP BY site_id),
e AS (SELECT *, n - 2 AS df, sgg - sg * sg / n AS ss, sgy - sg * sy / n AS sp, syy - sy * sy / n AS st FROM m),
b AS (SELECT *, CASE WHEN df > 0 AND ss > 1e-8 THEN sp / ss END AS beta FROM e),
w AS (SELECT *, CASE WHEN df > 0 AND ss > 1e-8 THEN sqrt(greatest(st - beta * sp, 0) / (df * ss)) END AS se FROM b),
t AS (SELECT *, CASE WHEN se > 0 THEN beta / se END AS t FROM w)"""


def _cents(spark, d):
    return view(spark, d, "samples").select("sample_id", F.round(F.col("y") * 100).cast("long").alias("y"))


@query("lm_scan", f"WITH {LM} SELECT site_id, n, df, round(beta, 6) AS beta, round(se, 6) AS se, round(t * t, 6) AS chisq, round(CASE WHEN t IS NOT NULL THEN n * ln(1 + t * t / df) END, 6) AS lrt FROM t", ("geno", "samples"))
def lm_scan(spark, d):
    e = assoc.lm_estimates(assoc.lm_sums(view(spark, d, "geno"), _cents(spark, d)))
    return e.select("site_id", "n", "df", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round("chisq", 6).alias("chisq"), F.round("plrt_stat", 6).alias("lrt"))


@query("lm_scan_top", f"""WITH {COUNTS}, {LM} SELECT t.site_id, chrom, pos, round(maf, 9) AS maf, round(beta, 6) AS beta, round(t * t, 6) AS chisq
  FROM t JOIN v ON t.site_id = v.site_id JOIN sites ON t.site_id = sites.site_id WHERE verdict IS NULL AND t IS NOT NULL ORDER BY round(t * t, 6) DESC, t.site_id LIMIT 20""", ("geno", "samples", "sites"))
def lm_scan_top(spark, d):
    """The flagship: quality control, flips aside, a linear scan of the sites kept, and the 20 strongest."""
    g = view(spark, d, "geno")
    kept = qc.qc_filter(g, MAF, MISS, HET).select("site_id", F.round("maf", 9).alias("maf"))
    scan = assoc.lm_estimates(assoc.lm_sums(g.join(kept, "site_id", "left_semi"), _cents(spark, d))).filter("t is not null")
    named = scan.join(kept, "site_id").join(view(spark, d, "sites"), "site_id")
    return named.select("site_id", "chrom", "pos", "maf", F.round("beta", 6).alias("beta"), F.round("chisq", 6).alias("chisq")).orderBy(F.desc("chisq"), "site_id").limit(20)


@query("lm_multi_trait", """WITH y AS (SELECT sample_id, 'acctbal' AS trait, CAST(round(y * 100) AS BIGINT) AS y FROM samples UNION ALL SELECT sample_id, 'family', CAST(family AS BIGINT) FROM samples),
m AS (SELECT site_id, trait, count(*) AS n, CAST(sum(g) AS DOUBLE) AS sg, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(g * g) AS DOUBLE) AS sgg, CAST(sum(g * y) AS DOUBLE) AS sgy
  FROM geno JOIN y USING (sample_id) WHERE g IS NOT NULL GROUP BY site_id, trait)
SELECT site_id, trait, n, round(CASE WHEN n > 2 AND sgg - sg * sg / n > 1e-8 THEN (sgy - sg * sy / n) / (sgg - sg * sg / n) END, 6) AS beta FROM m""", ("geno", "samples"))
def lm_multi_trait(spark, d):
    s = view(spark, d, "samples")
    traits = s.select("sample_id", F.lit("acctbal").alias("trait"), F.round(F.col("y") * 100).cast("long").alias("y")).unionByName(
        s.select("sample_id", F.lit("family").alias("trait"), F.col("family").cast("long").alias("y")))
    e = assoc.lm_estimates(assoc.lm_sums_traits(view(spark, d, "geno"), traits, "trait", ["acctbal", "family"]))
    return e.select("site_id", "trait", "n", F.round("beta", 6).alias("beta"))


@query("lm_scan_pvalues")
def lm_scan_pvalues(spark, d):
    e = assoc.lm_estimates(assoc.lm_sums(view(spark, d, "geno"), _cents(spark, d)))
    p = stats.t_pvalue("t", F.col("df").cast("double"))
    lrt = stats.chi2_pvalue("plrt_stat", F.lit(1.0))
    return e.withColumns({"p": p, "plrt": lrt}).select("site_id", "n", "beta", "se", assoc.sanitize_p(F.col("beta"), F.col("se"), F.col("p")).alias("p"), "plrt")


@query("lm_scan_covariates")
def lm_scan_covariates(spark, d):
    s = view(spark, d, "samples").select("sample_id", "y", F.col("family").cast("double").alias("family"), F.col("fold").cast("double").alias("fold"))
    return assoc.lm_covariates(view(spark, d, "geno"), s, ("family", "fold"))


@query("lead_per_bin", "SELECT site_id, chrom, pos, p FROM (SELECT *, row_number() OVER (PARTITION BY chrom, floor(pos / 20000.0) ORDER BY p, site_id) AS rn FROM hits) WHERE rn = 1 ORDER BY p, site_id LIMIT 25", ("hits",))
def lead_per_bin(spark, d):
    return assoc.lead_per_bin(view(spark, d, "hits"), 20000, 25).select("site_id", "chrom", "pos", "p")


@query("sequential_qtn", """WITH l AS (SELECT site_id, chrom, pos, p FROM (SELECT *, row_number() OVER (PARTITION BY chrom, floor(pos / 5000.0) ORDER BY p, site_id) AS rn FROM hits) WHERE rn = 1 ORDER BY p, site_id LIMIT 40),
u AS (SELECT * FROM l UNION ALL SELECT site_id, chrom, pos, p / 2 FROM hits WHERE beta > 1.4)
SELECT site_id, chrom, pos, p FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY p, site_id) AS rn FROM u WHERE p <= 0.2) WHERE rn = 1""", ("hits",))
def sequential_qtn(spark, d):
    h = view(spark, d, "hits")
    saved = h.filter("beta > 1.4").withColumn("p", F.col("p") / 2)
    return assoc.sequential_qtn(assoc.lead_per_bin(h, 5000, 40), saved, 0.2)


@query("bonferroni_hits", "SELECT site_id, p FROM hits WHERE p * (SELECT count(*) FROM hits) <= 4.0", ("hits",))
def bonferroni_hits(spark, d):
    return assoc.bonferroni(view(spark, d, "hits"), 4.0).select("site_id", "p")


@query("dispatch_plan", """SELECT DISTINCT p_type AS trait, m.model, CASE WHEN m.model IN ('lm', 'lm2') THEN 'sums' WHEN m.model = 'farmcpu' THEN 'iterate' ELSE 'blocks' END AS route
  FROM part, (VALUES ('lm'), ('lmm'), ('farmcpu')) m(model)""")
def dispatch_plan(spark, d):
    models = spark.createDataFrame([("lm",), ("lmm",), ("farmcpu",)], "model string")
    traits = table(spark, d, "part").select(F.col("p_type").alias("trait")).distinct()
    return assoc.dispatch(models, traits).select("trait", "model", "route")
