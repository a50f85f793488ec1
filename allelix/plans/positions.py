"""Queries over positions: interval joins, annotation, windows, plot preparation, bulked segregants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, qc, windows
from .registry import query
from .views import table, view

GENES = "genes AS (SELECT chrom, gene, min(start) AS lo, max(stop) AS hi, arg_min(strand, (start, feature_id)) AS strand FROM features GROUP BY chrom, gene)"


@query("interval_overlap", "SELECT a.feature_id AS a_id, b.feature_id AS b_id FROM features a JOIN features b ON a.chrom = b.chrom AND b.start <= a.stop AND b.stop >= a.start WHERE a.feature = 'gene' AND b.feature = 'CDS'", ("features",))
def interval_overlap(spark, d):
    f = view(spark, d, "features")
    a = f.filter("feature = 'gene'").select("chrom", F.col("feature_id").alias("a_id"), F.col("start").alias("a_start"), F.col("stop").alias("a_stop"))
    b = f.filter("feature = 'CDS'").select("chrom", F.col("feature_id").alias("b_id"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    return intervals.overlaps(a, b).select("a_id", "b_id")


@query("interval_contained", "SELECT a.feature_id AS a_id, b.feature_id AS b_id FROM features a JOIN features b ON a.chrom = b.chrom AND b.start >= a.start AND b.stop <= a.stop WHERE a.feature = 'gene' AND b.feature = 'exon'", ("features",))
def interval_contained(spark, d):
    f = view(spark, d, "features")
    a = f.filter("feature = 'gene'").select("chrom", F.col("feature_id").alias("a_id"), F.col("start").alias("a_start"), F.col("stop").alias("a_stop"))
    b = f.filter("feature = 'exon'").select("chrom", F.col("feature_id").alias("b_id"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    return intervals.overlaps(a, b, contained=True).select("a_id", "b_id")


@query("annotate_sites", f"""WITH {GENES}, parts AS (SELECT chrom, gene, CASE feature WHEN 'CDS' THEN 1 ELSE 4 END AS rank, start, stop FROM features WHERE feature IN ('CDS', 'exon')
  UNION ALL SELECT chrom, gene, 5, lo, hi FROM genes),
hit AS (SELECT site_id, s.chrom, gene, min(rank) AS rank FROM sites s JOIN parts p ON s.chrom = p.chrom AND pos BETWEEN start AND stop GROUP BY ALL),
ex AS (SELECT site_id, string_agg(concat(CASE rank WHEN 1 THEN 'CDS' WHEN 4 THEN 'Exon' ELSE 'Intron' END, ';', hit.gene, ';', strand), ' | ' ORDER BY rank, hit.gene) AS a
  FROM hit JOIN genes ON hit.chrom = genes.chrom AND hit.gene = genes.gene GROUP BY site_id),
nr AS (SELECT site_id, string_agg(concat(CASE WHEN (lo > pos) = (strand = '+') THEN 'Upstream' ELSE 'Downstream' END, '2kb;', gene, ';', strand), ' | ' ORDER BY CASE WHEN lo > pos THEN lo - pos ELSE pos - hi END, lo, gene) AS a
  FROM sites s JOIN genes g ON s.chrom = g.chrom AND lo <= pos + 2000 AND hi >= greatest(pos - 2000, 0) WHERE lo > pos OR hi < pos GROUP BY site_id)
SELECT s.site_id, coalesce(ex.a, nr.a, 'Intergenic;NA;NA') AS annotation FROM sites s LEFT JOIN ex ON s.site_id = ex.site_id LEFT JOIN nr ON s.site_id = nr.site_id""", ("sites", "features"))
def annotate_sites(spark, d):
    return intervals.annotate(view(spark, d, "sites"), view(spark, d, "features"))


@query("broaden_genes", f"""WITH {GENES} SELECT site_id, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM sites s JOIN genes g ON s.chrom = g.chrom AND lo <= pos + 3000 AND hi >= greatest(pos - 3000, 0) GROUP BY site_id""", ("sites", "features"))
def broaden_genes(spark, d):
    return intervals.broaden(view(spark, d, "sites"), view(spark, d, "features"), 3000)


@query("merge_ranges", """WITH r AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM features),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS id FROM r)
SELECT chrom, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY chrom, id""", ("features",))
def merge_ranges(spark, d):
    return intervals.merge_ranges(view(spark, d, "features").select("chrom", "start", "stop"))


@query("first_range", "SELECT site_id, min(feature_id) AS range_id FROM sites s JOIN features f ON s.chrom = f.chrom AND pos BETWEEN start AND stop GROUP BY site_id", ("sites", "features"))
def first_range(spark, d):
    return intervals.first_range(view(spark, d, "sites"), view(spark, d, "features").withColumnRenamed("feature_id", "range_id"))


@query("genes_with_sites", f"WITH {GENES} SELECT g.chrom, gene, count(*) AS n_sites FROM genes g JOIN sites s ON s.chrom = g.chrom AND pos BETWEEN lo AND hi GROUP BY g.chrom, gene HAVING count(*) >= 2", ("sites", "features"))
def genes_with_sites(spark, d):
    return intervals.genes_with_sites(view(spark, d, "sites"), view(spark, d, "features"), 2)


@query("resolve_parents", """WITH RECURSIVE e AS (SELECT concat('x', o_orderkey) AS id, CASE WHEN o_orderkey % 9 = 0 THEN concat('g', o_custkey) ELSE concat('x', o_orderkey - o_orderkey % 3 - CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 0 END) END AS parent FROM orders),
up(id, top, d) AS (SELECT id, parent, 1 FROM e UNION ALL SELECT up.id, e.parent, d + 1 FROM up JOIN e ON up.top = e.id WHERE d < 16)
SELECT DISTINCT id, top AS root FROM up WHERE top LIKE 'g%'""")
def resolve_parents(spark, d):
    k = F.col("o_orderkey")
    up = k - k % 3 - F.when(k % 3 == 0, 3).otherwise(0)
    parent = F.when(k % 9 == 0, F.concat(F.lit("g"), F.col("o_custkey"))).otherwise(F.concat(F.lit("x"), up))
    edges = table(spark, d, "orders").select(F.concat(F.lit("x"), k).alias("id"), parent.alias("parent"))
    roots = edges.filter("parent LIKE 'g%'").select(F.col("parent").alias("id")).distinct()
    return intervals.resolve_parents(edges, roots)


@query("sliding_bp", "SELECT site_id, count(*) OVER w AS n_window, min(p) OVER w AS min_p, round(avg(p) OVER w, 9) AS mean_p FROM hits WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 3000 PRECEDING AND 3000 FOLLOWING)", ("hits",))
def sliding_bp(spark, d):
    return windows.sliding(view(spark, d, "hits"), by_bp=3000).select("site_id", "n_window", "min_p", F.round("mean_p", 9).alias("mean_p"))


@query("sliding_rows", "SELECT site_id, count(*) OVER w AS n_window, min(p) OVER w AS min_p, round(avg(p) OVER w, 9) AS mean_p FROM hits WINDOW w AS (PARTITION BY chrom ORDER BY pos, site_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", ("hits",))
def sliding_rows(spark, d):
    return windows.sliding(view(spark, d, "hits"), by_rows=2).select("site_id", "n_window", "min_p", F.round("mean_p", 9).alias("mean_p"))


@query("qq_points", "SELECT site_id, row_number() OVER (ORDER BY p, site_id) AS rank, round(-log10(row_number() OVER (ORDER BY p, site_id) / (count(*) OVER () + 1)::DOUBLE), 9) AS expected, round(-log10(p), 9) AS observed FROM hits", ("hits",))
def qq_points(spark, d):
    return windows.qq_points(view(spark, d, "hits")).select("site_id", "rank", F.round("expected", 9).alias("expected"), F.round("observed", 9).alias("observed"))


@query("holm_adjust", """WITH r AS (SELECT site_id, p, row_number() OVER (ORDER BY p, site_id) AS rn, count(*) OVER () AS n FROM hits)
SELECT site_id, round(least(max((n - rn + 1) * p) OVER (ORDER BY rn), 1), 9) AS p_holm FROM r""", ("hits",))
def holm_adjust(spark, d):
    return windows.holm(view(spark, d, "hits")).select("site_id", F.round("p_holm", 9).alias("p_holm"))


OFFSETS = """t AS (SELECT chrom, CAST(max(pos) AS BIGINT) AS top FROM hits GROUP BY chrom), gap AS (SELECT CAST(floor(sum(top) / 50.0) AS BIGINT) AS gap FROM t),
o AS (SELECT chrom, CAST(coalesce(sum(top + gap) OVER (ORDER BY CAST(chrom AS INT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM t, gap)"""


@query("chrom_offsets", f'WITH {OFFSETS} SELECT chrom, "offset" FROM o', ("hits",))
def chrom_offsets(spark, d):
    return windows.offsets(view(spark, d, "hits"))


@query("manhattan_points", f'WITH {OFFSETS} SELECT site_id, pos + "offset" AS x, round(-log10(p), 9) AS height FROM hits JOIN o ON hits.chrom = o.chrom', ("hits",))
def manhattan_points(spark, d):
    return windows.manhattan(view(spark, d, "hits")).select("site_id", "x", F.round("height", 9).alias("height"))


@query("thin_points", """SELECT site_id, p FROM (SELECT *, row_number() OVER (PARTITION BY chrom, floor(pos / 20000.0), p < 0.05 ORDER BY p, site_id) AS rn FROM hits) WHERE p < 0.05 OR rn = 1""", ("hits",))
def thin_points(spark, d):
    return windows.thin(view(spark, d, "hits"), 0.05, 20000).select("site_id", "p")


@query("natural_chrom_order", """SELECT chrom, row_number() OVER (ORDER BY CAST(chrom AS INT)) AS ord FROM (SELECT DISTINCT chrom FROM sites)""", ("sites",))
def natural_chrom_order(spark, d):
    from pyspark.sql import Window

    names = view(spark, d, "sites").select("chrom").distinct()
    return names.select("chrom", F.row_number().over(Window.orderBy(*windows.chrom_key(F.col("chrom")))).cast("long").alias("ord"))


BSA = """b AS (SELECT l_partkey AS site_id, count(*) FILTER (WHERE l_returnflag = 'A') AS dp1, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linenumber % 2 = 1) AS ad1,
  count(*) FILTER (WHERE l_returnflag = 'R') AS dp2, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber % 2 = 1) AS ad2,
  coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS gq1, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS gq2 FROM lineitem GROUP BY l_partkey),
f AS (SELECT b.*, chrom, pos, CASE WHEN dp1 <= 0 OR dp2 <= 0 THEN NULL WHEN dp1 + dp2 < 8 THEN 'low_total' WHEN dp1 + dp2 > 60 THEN 'high_total' WHEN dp1 < 5 OR dp2 < 5 THEN 'low_bulk'
  WHEN gq1 < 40 OR gq2 < 40 THEN 'low_quality' WHEN ad1 = 0 AND ad2 = 0 THEN 'no_alternate' WHEN ad1 = dp1 AND ad2 = dp2 THEN 'no_reference' ELSE 'kept' END AS stage FROM b JOIN sites s ON b.site_id = s.site_id),
i AS (SELECT *, ad1 / dp1::DOUBLE AS index1, ad2 / dp2::DOUBLE AS index2, ad2 / dp2::DOUBLE - ad1 / dp1::DOUBLE AS delta, ad1 + ad2 AS alt, dp1 + dp2 - ad1 - ad2 AS ref, dp1 + dp2 AS tot FROM f WHERE stage = 'kept'),
q AS (SELECT *, sqrt(2 * delta * delta) AS ed, 2 * (greatest(ad1, 1e-10) * ln(greatest(ad1, 1e-10) / greatest(dp1 * alt / tot::DOUBLE, 1e-10)) + greatest(dp1 - ad1, 1e-10) * ln(greatest(dp1 - ad1, 1e-10) / greatest(dp1 * ref / tot::DOUBLE, 1e-10))
  + greatest(ad2, 1e-10) * ln(greatest(ad2, 1e-10) / greatest(dp2 * alt / tot::DOUBLE, 1e-10)) + greatest(dp2 - ad2, 1e-10) * ln(greatest(dp2 - ad2, 1e-10) / greatest(dp2 * ref / tot::DOUBLE, 1e-10))) AS g FROM i)"""


def _bsa(spark, d):
    flag, odd = F.col("l_returnflag"), F.col("l_linenumber") % 2 == 1
    aggs = []
    for k, v in ((1, "A"), (2, "R")):
        aggs += [F.count_if(flag == v).alias(f"dp{k}"), F.count_if((flag == v) & odd).alias(f"ad{k}"), F.coalesce(F.max(F.when(flag == v, F.col("l_quantity"))), F.lit(0.0)).alias(f"gq{k}")]
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site_id")).agg(*aggs).join(view(spark, d, "sites").select("site_id", "chrom", "pos"), "site_id")
    return windows.bsa_drop_stage(rows, (8, 60), 5, 40)


@query("bsa_filter_stages", f"WITH {BSA} SELECT stage, count(*) AS n FROM f WHERE stage IS NOT NULL GROUP BY stage", ("sites",))
def bsa_filter_stages(spark, d):
    return _bsa(spark, d).filter("stage is not null").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("bsa_statistics", f"WITH {BSA} SELECT site_id, round(index1, 9) AS index1, round(index2, 9) AS index2, round(delta, 9) AS delta, round(ed, 9) AS ed, round(g, 6) AS g FROM q", ("sites",))
def bsa_statistics(spark, d):
    s = windows.bsa_statistics(_bsa(spark, d).filter("stage = 'kept'"))
    return s.select("site_id", *(F.round(c, 9).alias(c) for c in ("index1", "index2", "delta", "ed")), F.round("g", 6).alias("g"))


@query("bsa_smooth", f"""WITH {BSA}, sp AS (SELECT chrom, CAST(min(pos) AS BIGINT) AS lo, CAST(max(pos) AS BIGINT) AS hi FROM q GROUP BY chrom HAVING max(pos) - min(pos) >= 20000),
c AS (SELECT chrom, lo + k * 4000 AS centre FROM (SELECT *, unnest(range(1, CAST(ceil((hi - lo) / 4000.0) AS BIGINT))) AS k FROM sp)),
w AS (SELECT c.chrom, centre, q.*, pow(1 - pow(least(abs(pos - centre) / 10000.0::DOUBLE, 1), 3), 3) AS wt FROM c JOIN q ON c.chrom = q.chrom AND pos BETWEEN centre - 10000 AND centre + 10000)
SELECT chrom, centre, count(*) AS n, round(avg(delta), 6) AS delta, round(avg(pow(ed, 4)), 6) AS ed_power, round(CASE WHEN sum(wt) > 0 THEN sum(wt * g) / sum(wt) END, 6) AS g_prime FROM w GROUP BY chrom, centre HAVING count(*) >= 5""", ("sites",))
def bsa_smooth(spark, d):
    s = windows.bsa_smooth(windows.bsa_statistics(_bsa(spark, d).filter("stage = 'kept'")), 20000, 4000, 5)
    return s.select("chrom", "centre", "n", *(F.round(c, 6).alias(c) for c in ("delta", "ed_power", "g_prime")))


@query("stratified_folds", """SELECT sample_id, CAST((row_number() OVER (PARTITION BY case_status ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) - 1) % 5 AS INT) AS fold FROM samples""", ("samples",))
def stratified_folds(spark, d):
    return windows.folds(view(spark, d, "samples").drop("fold"), 5, "case_status", "sample_id").select("sample_id", "fold")


@query("spearman_by_brand", """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0::DOUBLE AS b FROM part),
s AS (SELECT p_brand, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM r GROUP BY p_brand)
SELECT p_brand, n, round(CASE WHEN n * saa > sa * sa AND n * sbb > sb * sb THEN (n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) END, 9) AS rho FROM s""")
def spearman_by_brand(spark, d):
    from ..functions.stats import pearson

    r = windows.average_rank(table(spark, d, "part").select("p_brand", "p_size", "p_retailprice"), "p_size", ["p_brand"], "a")
    r = windows.average_rank(r, "p_retailprice", ["p_brand"], "b")
    a, b = F.col("a"), F.col("b")
    s = r.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    rho = pearson(*(F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    return s.select("p_brand", "n", F.round(rho, 9).alias("rho"))


@query("standardise_hits", """SELECT chrom, pos, site_id, p FROM (SELECT *, row_number() OVER (PARTITION BY chrom, floor(pos / 3000.0) ORDER BY p, site_id) AS rn FROM hits) WHERE rn = 1""", ("hits",))
def standardise_hits(spark, d):
    h = view(spark, d, "hits").withColumn("cell", F.floor(F.col("pos") / 3000))
    return qc.order_of_first(h, ["chrom", "cell"], ["p", "site_id"]).select("chrom", "pos", "site_id", "p")
