"""Queries: merged panels, hybrids, linkage disequilibrium, kinship, relationship, distances, networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ld, merge, qc
from .core import COUNTS
from .registry import query
from .views import table, view

#: Three inputs over the same sites: the second with alleles swapped or on the other strand, the third with some that do not fit.
PANELS = """s0 AS (SELECT site_id, chrom, pos, ref, alt FROM sites WHERE ref <> alt AND site_id % 3 <> 0),
s1 AS (SELECT site_id, chrom, pos, CASE WHEN site_id % 4 = 1 THEN alt WHEN site_id % 5 = 2 THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref,
  CASE WHEN site_id % 4 = 1 THEN ref WHEN site_id % 5 = 2 THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS alt FROM sites WHERE ref <> alt),
s2 AS (SELECT site_id, chrom, pos, ref, CASE WHEN site_id % 7 = 3 THEN translate(alt, 'ACGT', 'CATG') ELSE alt END AS alt FROM sites WHERE ref <> alt AND site_id % 2 = 0),
u AS (SELECT 0 AS input, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2 WHERE ref <> alt),
f AS (SELECT chrom, pos, arg_min(ref, input) AS r, arg_min(alt, input) AS a FROM u GROUP BY chrom, pos),
m AS (SELECT u.input, u.site_id, u.chrom, u.pos, f.r, f.a, CASE WHEN u.ref = r AND u.alt = a THEN 'identity' WHEN u.ref = a AND u.alt = r THEN 'swap'
  WHEN translate(u.ref, 'ACGT', 'TGCA') = r AND translate(u.alt, 'ACGT', 'TGCA') = a THEN 'strand' WHEN translate(u.ref, 'ACGT', 'TGCA') = a AND translate(u.alt, 'ACGT', 'TGCA') = r THEN 'strand_swap' END AS map
  FROM u JOIN f ON u.chrom = f.chrom AND u.pos = f.pos)"""


def _panel_sites(spark, d):
    s = view(spark, d, "sites").select("site_id", "chrom", "pos", "ref", "alt").filter("ref <> alt")
    k, ref, alt = F.col("site_id"), F.col("ref"), F.col("alt")
    s1 = s.withColumns({"ref": F.when(k % 4 == 1, alt).when(k % 5 == 2, merge.complement(ref)).otherwise(ref), "alt": F.when(k % 4 == 1, ref).when(k % 5 == 2, merge.complement(alt)).otherwise(alt)})
    s2 = s.filter("site_id % 2 = 0").withColumn("alt", F.when(k % 7 == 3, F.translate(alt, "ACGT", "CATG")).otherwise(alt))
    return [s.filter("site_id % 3 <> 0"), s1, s2]


def _panels(spark, d):
    g = view(spark, d, "geno")
    return [merge.panel(g.filter(F.col("sample_id") % 3 == i), x, i) for i, x in enumerate(_panel_sites(spark, d))]


@query("merge_panels", f"WITH {PANELS} SELECT m.chrom, m.pos, r AS ref, a AS alt, CAST(input AS INT) AS input, sample_id, CAST(CASE WHEN map IN ('swap', 'strand_swap') THEN 2 - g ELSE g END AS INT) AS g FROM m JOIN geno g ON m.site_id = g.site_id AND g.sample_id % 3 = input WHERE map IS NOT NULL", ("sites", "geno"))
def merge_panels(spark, d):
    sites = [merge.panel_sites(x, i) for i, x in enumerate(_panel_sites(spark, d))]
    return merge.merge_panels(_panels(spark, d), sites).withColumn("g", F.col("g").cast("int"))


@query("merge_counts", f"""WITH {PANELS}, h AS (SELECT DISTINCT m.input, m.site_id, m.chrom, m.pos FROM m JOIN geno g ON m.site_id = g.site_id AND g.sample_id % 3 = input),
ff AS (SELECT chrom, pos, min(input) AS i FROM h GROUP BY chrom, pos), al AS (SELECT h.chrom, h.pos, u.ref AS r, u.alt AS a FROM ff JOIN h ON ff.chrom = h.chrom AND ff.pos = h.pos AND ff.i = h.input JOIN u ON u.site_id = h.site_id AND u.input = h.input),
mm AS (SELECT u.input, u.chrom, u.pos, CASE WHEN u.ref = r AND u.alt = a THEN 1 WHEN u.ref = a AND u.alt = r THEN 2 WHEN translate(u.ref, 'ACGT', 'TGCA') = r AND translate(u.alt, 'ACGT', 'TGCA') = a THEN 3
  WHEN translate(u.ref, 'ACGT', 'TGCA') = a AND translate(u.alt, 'ACGT', 'TGCA') = r THEN 4 END AS map FROM h JOIN u ON h.site_id = u.site_id AND h.input = u.input JOIN al ON al.chrom = u.chrom AND al.pos = u.pos)
SELECT CAST(input AS INT) AS input, count(*) AS present, (SELECT count(*) FROM ff) - count(*) AS absent, count(*) FILTER (WHERE map IS NULL) AS unaligned FROM mm GROUP BY input""", ("sites", "geno"))
def merge_counts(spark, d):
    return merge.merge_counts(_panels(spark, d))


@query("hybrids", """SELECT a.site_id, a.sample_id AS mother, b.sample_id AS father, (a.g + b.g) / 2.0::DOUBLE AS g FROM geno a JOIN geno b ON a.site_id = b.site_id
  JOIN samples sa ON sa.sample_id = a.sample_id JOIN samples sb ON sb.sample_id = b.sample_id WHERE sa.family < 3 AND sb.family BETWEEN 10 AND 12""", ("geno", "samples"))
def hybrids(spark, d):
    s = view(spark, d, "samples")
    return merge.hybrids(view(spark, d, "geno"), s.filter("family < 3"), s.filter("family between 10 and 12"))


@query("orient_to_reference", """WITH b AS (SELECT o_orderkey, CAST(o_custkey % 20 + 1 AS VARCHAR) AS chrom, CAST(o_orderkey % 100 * 1000 + 1 AS INT) AS pos, substring('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS base FROM orders),
g AS (SELECT chrom, pos, arg_min(base, o_orderkey) AS base FROM b GROUP BY chrom, pos)
SELECT site_id, base, CASE WHEN ref = base THEN 'keep' WHEN alt = base THEN 'swap' ELSE 'mismatch' END AS action, CASE WHEN ref <> base AND alt = base THEN alt ELSE ref END AS new_ref FROM sites s JOIN g ON s.chrom = g.chrom AND s.pos = g.pos""", ("sites",))
def orient_to_reference(spark, d):
    k = F.col("o_orderkey")
    b = table(spark, d, "orders").select(k, (F.col("o_custkey") % 20 + 1).cast("string").alias("chrom"), (k % 100 * 1000 + 1).cast("int").alias("pos"), F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1)).alias("base"))
    g = b.groupBy("chrom", "pos").agg(F.min_by("base", "o_orderkey").alias("base"))
    return merge.orient_to_reference(view(spark, d, "sites"), g).select("site_id", "base", "action", "new_ref")


@query("group_links", """WITH g AS (SELECT CAST(floor(site_id / 7) AS BIGINT) AS grp, chrom, pos, p FROM hits WHERE p < 0.3), e AS (SELECT grp, chrom, pos, min(p) AS p FROM g GROUP BY ALL), b AS (SELECT grp, min(p) AS min_p FROM e GROUP BY grp)
SELECT x.grp, x.chrom AS chrom_a, x.pos AS pos_a, y.chrom AS chrom_b, y.pos AS pos_b, min_p FROM e x JOIN e y ON x.grp = y.grp AND (x.chrom < y.chrom OR (x.chrom = y.chrom AND x.pos < y.pos)) JOIN b ON b.grp = x.grp""", ("hits",))
def group_links(spark, d):
    h = view(spark, d, "hits").filter("p < 0.3").withColumn("grp", F.floor(F.col("site_id") / 7))
    return merge.group_links(h, "grp")


WINDOW = 4000
PAIRS = f"""q AS (SELECT g.*, chrom, pos FROM geno g JOIN sites s ON g.site_id = s.site_id WHERE g IS NOT NULL),
ps AS (SELECT a.site_id AS i, b.site_id AS j, any_value(a.chrom) AS chrom, count(*) AS n, CAST(sum(a.g) AS DOUBLE) AS si, CAST(sum(b.g) AS DOUBLE) AS sj, CAST(sum(a.g * a.g) AS DOUBLE) AS sii, CAST(sum(b.g * b.g) AS DOUBLE) AS sjj, CAST(sum(a.g * b.g) AS DOUBLE) AS sij
  FROM q a JOIN q b ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND b.pos > a.pos AND b.pos - a.pos <= {WINDOW} GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN n * sii > si * si AND n * sjj > sj * sj THEN pow((n * sij - si * sj) / sqrt((n * sii - si * si) * (n * sjj - sj * sj)), 2) END AS r2 FROM ps)"""


def _pairs(spark, d):
    return ld.r_squared(ld.pair_sums(view(spark, d, "geno"), view(spark, d, "sites"), WINDOW))


@query("ld_pairs", f"WITH {PAIRS} SELECT i, j, n, round(r2, 9) AS r2 FROM pr", ("geno", "sites"))
def ld_pairs(spark, d):
    return _pairs(spark, d).select("i", "j", "n", F.round("r2", 9).alias("r2"))


@query("ld_scores", f"""WITH {COUNTS}, {PAIRS}, b AS (SELECT i, sum(r2) AS s FROM (SELECT i, r2 FROM pr UNION ALL SELECT j, r2 FROM pr) GROUP BY i),
w AS (SELECT site_id, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN {WINDOW} PRECEDING AND {WINDOW} FOLLOWING) AS m FROM sites)
SELECT s.site_id, round(CASE WHEN n - missing > 1 AND maf > 0 THEN 1.0 ELSE 0.0 END + coalesce(b.s, 0), 6) AS ld_score, m FROM s JOIN w ON s.site_id = w.site_id LEFT JOIN b ON s.site_id = b.i""", ("geno", "sites"))
def ld_scores(spark, d):
    rates = qc.site_rates(qc.site_counts(view(spark, d, "geno")))
    return ld.ld_scores(_pairs(spark, d), rates, view(spark, d, "sites"), WINDOW).withColumn("ld_score", F.round("ld_score", 6))


@query("ld_prune")
def ld_prune(spark, d):
    rates = qc.site_rates(qc.site_counts(view(spark, d, "geno")))
    return ld.prune(_pairs(spark, d), rates, view(spark, d, "sites"), 0.6)


@query("ld_clump")
def ld_clump(spark, d):
    return ld.clump(view(spark, d, "hits"), _pairs(spark, d), 0.3, 0.4)


KING = """kp AS (SELECT a.sample_id AS i, b.sample_id AS j, count(*) AS shared, count(*) FILTER (WHERE abs(a.g - b.g) = 2) AS ibs0, count(*) FILTER (WHERE abs(a.g - b.g) = 1) AS ibs1, count(*) FILTER (WHERE a.g = b.g) AS ibs2,
  count(*) FILTER (WHERE a.g = 1) AS het_i, count(*) FILTER (WHERE b.g = 1) AS het_j, count(*) FILTER (WHERE a.g = 1 AND b.g = 1) AS both_het FROM geno a JOIN geno b ON a.site_id = b.site_id AND a.sample_id < b.sample_id WHERE a.g IS NOT NULL AND b.g IS NOT NULL GROUP BY 1, 2)"""


@query("king_pairs", f"WITH {KING} SELECT *, round(CASE WHEN het_i + het_j > 0 THEN (both_het - 2 * ibs0) / (het_i + het_j)::DOUBLE END, 9) AS kinship FROM kp", ("geno",))
def king_pairs(spark, d):
    return ld.king(view(spark, d, "geno")).withColumn("kinship", F.round("kinship", 9))


@query("king_unrelated")
def king_unrelated(spark, d):
    """Samples removed so that no pair left is related; the graph has a vertex for each sample."""
    edges = ld.king(view(spark, d, "geno")).filter("kinship >= -0.6 and shared >= 10").select("i", "j").collect()
    gone = ld.unrelated([(r["i"], r["j"]) for r in edges])
    return spark.createDataFrame([(x,) for x in gone], "sample_id long")


GRM = f"""{COUNTS}, fr AS (SELECT site_id, freq FROM s WHERE freq > 0 AND freq < 1), sc AS (SELECT sum(2 * freq * (1 - freq)) AS total, count(*) AS m FROM fr),
z AS (SELECT g.site_id, sample_id, g - 2 * freq AS z, (g - 2 * freq) / sqrt(2 * freq * (1 - freq)) AS zs FROM geno g JOIN fr ON g.site_id = fr.site_id WHERE g IS NOT NULL)"""


@query("grm_centred", f"WITH {GRM} SELECT a.sample_id AS i, b.sample_id AS j, round(sum(a.z * b.z) / any_value(total), 6) AS k FROM z a JOIN z b ON a.site_id = b.site_id AND a.sample_id <= b.sample_id, sc GROUP BY 1, 2", ("geno",))
def grm_centred(spark, d):
    g = view(spark, d, "geno")
    return ld.grm(g, qc.site_rates(qc.site_counts(g))).withColumn("k", F.round("k", 6))


@query("grm_standardised", f"WITH {GRM} SELECT a.sample_id AS i, b.sample_id AS j, round(sum(a.zs * b.zs) / any_value(m), 6) AS k FROM z a JOIN z b ON a.site_id = b.site_id AND a.sample_id <= b.sample_id, sc GROUP BY 1, 2", ("geno",))
def grm_standardised(spark, d):
    g = view(spark, d, "geno")
    return ld.grm(g, qc.site_rates(qc.site_counts(g)), 2).withColumn("k", F.round("k", 6))


@query("sparse_grm", f"WITH {GRM}, kk AS (SELECT a.sample_id AS i, b.sample_id AS j, round(sum(a.z * b.z) / any_value(total), 6) AS k FROM z a JOIN z b ON a.site_id = b.site_id AND a.sample_id <= b.sample_id, sc GROUP BY 1, 2) SELECT * FROM kk WHERE i = j OR k > 0.02", ("geno",))
def sparse_grm(spark, d):
    g = view(spark, d, "geno")
    return ld.sparse_grm(ld.grm(g, qc.site_rates(qc.site_counts(g))).withColumn("k", F.round("k", 6)), 0.02)


@query("weights_product", f"WITH {COUNTS} SELECT sample_id, round(sum((g - 2 * freq) * beta), 6) AS v FROM geno g JOIN s ON g.site_id = s.site_id JOIN hits h ON h.site_id = g.site_id WHERE g IS NOT NULL GROUP BY sample_id", ("geno", "hits"))
def weights_product(spark, d):
    g = view(spark, d, "geno")
    return ld.site_weights_product(g, qc.site_rates(qc.site_counts(g)), view(spark, d, "hits").withColumnRenamed("beta", "w")).withColumn("v", F.round("v", 6))


@query("sequence_distances", """WITH b AS (SELECT g.site_id, sample_id AS taxon, CASE g WHEN 0 THEN ref WHEN 2 THEN alt ELSE 'N' END AS base FROM geno g JOIN sites s ON g.site_id = s.site_id),
p AS (SELECT x.taxon AS i, y.taxon AS j, count(*) AS shared, count(*) FILTER (WHERE x.base <> y.base) AS different FROM b x JOIN b y ON x.site_id = y.site_id AND x.taxon < y.taxon WHERE x.base IN ('A','C','G','T') AND y.base IN ('A','C','G','T') GROUP BY 1, 2)
SELECT i, j, shared, different, round(CASE WHEN shared < 5 THEN 1.0 WHEN 1 - 4 * (different / shared::DOUBLE) / 3 > 0 THEN least(-0.75 * ln(1 - 4 * (different / shared::DOUBLE) / 3), 1.0) ELSE 1.0 END, 9) AS distance FROM p""", ("geno", "sites"))
def sequence_distances(spark, d):
    b = view(spark, d, "geno").join(view(spark, d, "sites"), "site_id").select("site_id", F.col("sample_id").alias("taxon"), F.when(F.col("g") == 0, F.col("ref")).when(F.col("g") == 2, F.col("alt")).otherwise("N").alias("base"))
    return ld.sequence_distances(b, 5).withColumn("distance", F.round("distance", 9))


TOM = """x AS (SELECT vec_id, unnest(range(1, 65)) AS f, embedding FROM embeddings), v AS (SELECT vec_id, f, CAST(round(embedding[f] * 1000) AS BIGINT) AS x FROM x),
c AS (SELECT a.f AS i, b.f AS j, count(*) AS n, CAST(sum(a.x) AS DOUBLE) AS sx, CAST(sum(b.x) AS DOUBLE) AS sy, CAST(sum(a.x * a.x) AS DOUBLE) AS sxx, CAST(sum(b.x * b.x) AS DOUBLE) AS syy, CAST(sum(a.x * b.x) AS DOUBLE) AS sxy FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.f < b.f GROUP BY 1, 2),
r AS (SELECT i, j, n, CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END AS r FROM c)"""


def _features(spark, d):
    """The dimensions of the embeddings, as expression levels in thousandths."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("f", "x"))
    return e.select("vec_id", (F.col("f") + 1).cast("long").alias("f"), F.round(F.col("x").cast("double") * 1000).cast("long").alias("x"))


@query("correlation_pairs", f"WITH {TOM} SELECT i, j, n, round(r, 9) AS r FROM r")
def correlation_pairs(spark, d):
    return ld.correlation_pairs(_features(spark, d), "vec_id", "f", "x").withColumn("r", F.round("r", 9))


@query("topological_overlap", f"""WITH {TOM}, a AS (SELECT i, j, pow(abs(r), 2) AS a FROM r WHERE r IS NOT NULL), b AS (SELECT * FROM a UNION ALL SELECT j, i, a FROM a), k AS (SELECT i, sum(a) AS k FROM b GROUP BY i),
l AS (SELECT x.i, y.j, sum(x.a * y.a) AS l FROM b x JOIN b y ON x.j = y.i AND x.i < y.j GROUP BY 1, 2)
SELECT a.i, a.j, round((coalesce(l, 0) + a) / (least(k1.k, k2.k) + 1 - a), 9) AS tom FROM a LEFT JOIN l ON a.i = l.i AND a.j = l.j JOIN k k1 ON k1.i = a.i JOIN k k2 ON k2.i = a.j""")
def topological_overlap(spark, d):
    pairs = ld.correlation_pairs(_features(spark, d), "vec_id", "f", "x")
    return ld.topological_overlap(ld.adjacency(pairs, 2)).withColumn("tom", F.round("tom", 9))
