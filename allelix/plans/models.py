"""Queries: mixed models, structure, prediction, simulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..models import farmcpu, mixed, predict, simulate, sparse, structure
from ..operators import ld, qc
from .registry import query
from .views import table, view


def _dense(spark, d, related: bool = True):
    """Samples, their phenotype, the dense rows of the sites kept, and the relationship matrix (None unless ``related``)."""
    s = [(r["sample_id"], r["y"]) for r in view(spark, d, "samples").select("sample_id", "y").orderBy("sample_id").collect()]
    ids = [i for i, _ in s]
    geno = view(spark, d, "geno")
    kept = geno.join(qc.qc_filter(geno, 0.1, 0.5).select("site_id"), "site_id", "left_semi")
    rows = mixed.dense_rows(kept, ids)
    return ids, np.array([y for _, y in s]), rows, mixed.relationship_of_calls(kept, ids) if related else None


def _calls(spark, d):
    """Samples, their phenotype, and the kept sites' calls as ``sparse.site_rows``."""
    s = view(spark, d, "samples").select("sample_id", "y").orderBy("sample_id").toArrow()
    ids = s["sample_id"].to_pylist()
    geno = view(spark, d, "geno")
    kept = geno.join(qc.qc_filter(geno, 0.1, 0.5).select("site_id"), "site_id", "left_semi")
    return ids, s["y"].to_numpy(), sparse.site_rows(kept, ids)


def _blocks(spark, d):
    """Samples, their phenotype, and the kept sites in groups of linked samples."""
    ids, y, rows = _calls(spark, d)
    return ids, y, sparse.Blocks(rows, len(ids))


def mixed_scan(spark, d, method: str):
    _, y, blocks = _blocks(spark, d)
    return sparse.mixed_scan(blocks, sparse.Spectrum(blocks, y), method)


@query("lmm_scan")
def lmm_scan(spark, d):
    return mixed_scan(spark, d, "lmm")


@query("fvlmm_scan")
def fvlmm_scan(spark, d):
    return mixed_scan(spark, d, "fvlmm")


@query("farmcpu_scan")
def farmcpu_scan(spark, d):
    _, y, rows = _calls(spark, d)
    return farmcpu.farmcpu(rows.persist(StorageLevel.DISK_ONLY), view(spark, d, "sites"), y, (5000, 20000, 50000))[0]


@query("principal_components")
def principal_components(spark, d):
    ids, _, blocks = _blocks(spark, d)
    u, share = sparse.principal_components(blocks, 5)
    n, k = u.shape
    return spark.createDataFrame(pa.table({"sample_id": np.repeat(np.array(ids, np.int64), k), "pc": np.tile(np.arange(1, k + 1, dtype=np.int32), n), "x": u.ravel(), "explained": np.tile(share, n)}))


@query("gblup_cross_validation")
def gblup_cross_validation(spark, d):
    ids, y, blocks = _blocks(spark, d)
    return spark.createDataFrame(sparse.gblup_cross_validate(blocks, y, np.arange(len(ids)) % 5), "fold int, n long, pearson double, mse double")


@query("variance_components")
def variance_components(spark, d):
    _, y, blocks = _blocks(spark, d)
    return spark.createDataFrame(sparse.variance_shares(blocks, y), "method string, h2 double")


@query("admixture")
def admixture(spark, d):
    ids, _, rows = _calls(spark, d)
    q, ll = structure.admixture_em(rows, len(ids), 3, steps=1000)  # far above what its stopping rule needs
    return spark.createDataFrame([(i, c, float(q[r, c]), ll) for r, i in enumerate(ids) for c in range(3)], "sample_id long, k int, q double, loglik double")


@query("tree")
def tree(spark, d):
    g = view(spark, d, "geno").join(view(spark, d, "sites"), "site_id")
    base = F.when(F.col("g") == 0, F.col("ref")).when(F.col("g") == 2, F.col("alt")).otherwise("N")
    pairs = ld.sequence_distances(g.select("site_id", F.col("sample_id").alias("taxon"), base.alias("base")), 5)
    ids = [r["sample_id"] for r in view(spark, d, "samples").select("sample_id").orderBy("sample_id").collect()]
    if len(ids) > mixed.MAX_SAMPLES:
        raise ValueError(f"more than {mixed.MAX_SAMPLES} samples")
    dist = np.ones((len(ids), len(ids)))
    np.fill_diagonal(dist, 0)
    got = pairs.select("i", "j", "distance").toArrow()
    if not all(np.isin(got[c].to_numpy(), ids).all() for c in "ij"):
        raise ValueError("calls of samples that are not listed")
    i, j = (np.searchsorted(ids, got[c].to_numpy()) for c in "ij")
    dist[i, j] = dist[j, i] = got["distance"].to_numpy()
    return spark.createDataFrame([(structure.neighbour_joining(dist, [f"s{x}" for x in ids]),)], "newick string")


@query("bayes_effects")
def bayes_effects(spark, d):
    """One task for each method, over all kept sites, as a chain holds its markers in memory."""
    _, y, rows = _calls(spark, d)
    return predict.bayes_effects(rows, y, ("A", "B", "Cpi"))


@query("simulated_trait")
def simulated_trait(spark, d):
    effects = view(spark, d, "hits").select("site_id", F.col("beta").alias("effect"))
    return simulate.trait(view(spark, d, "geno"), effects, 0.5)


@query("signed_hash")
def signed_hash(spark, d):
    g = view(spark, d, "geno")
    return simulate.signed_hash(g, qc.site_rates(qc.site_counts(g)), 64)


@query("rank_to_target")
def rank_to_target(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("c"))
    long = s.select("sample_id", F.expr("stack(2, 'quantity', q, 'discount', c) as (trait, value)"))
    return predict.rank_to_target(long, {"quantity": 27.0, "discount": 0.04}, 10)


@query("logic_gate", "WITH m AS (SELECT site_id, CASE WHEN count(*) FILTER (WHERE g = 2) > count(*) FILTER (WHERE g = 0) THEN 1 ELSE 0 END AS major FROM geno GROUP BY site_id) SELECT sample_id, CAST(min(CASE g WHEN 2 THEN 1 WHEN 0 THEN 0 ELSE major END) AS INT) AS x FROM geno JOIN m ON geno.site_id = m.site_id JOIN sites s ON s.site_id = geno.site_id WHERE gene_set = 'Brand#7' GROUP BY sample_id", ("geno", "sites"))
def logic_gate(spark, d):
    wanted = view(spark, d, "sites").filter("gene_set = 'Brand#7'").select("site_id")
    return simulate.gate(view(spark, d, "geno").join(wanted, "site_id", "left_semi"))


@query("admixture_loglik", """WITH p AS (SELECT site_id, k, 0.1::DOUBLE + 0.8::DOUBLE * ((site_id * (k + 3)) % 11) / 11 AS p FROM sites, range(3) t(k)), q AS (SELECT sample_id, k, ((sample_id + k) % 3 + 1) / 6.0::DOUBLE AS q FROM samples, range(3) t(k)),
r AS (SELECT g.site_id, g.sample_id, g, greatest(least(sum(p * q), 1 - 1e-6), 1e-6) AS r FROM geno g JOIN p ON g.site_id = p.site_id JOIN q ON q.sample_id = g.sample_id AND q.k = p.k WHERE g IS NOT NULL GROUP BY 1, 2, 3)
SELECT round(sum(g * ln(r) + (2 - g) * ln(1 - r)), 4) AS loglik FROM r""", ("sites", "samples", "geno"))
def admixture_loglik(spark, d):
    k = F.explode(F.array(*(F.lit(x).cast("long") for x in range(3)))).alias("k")
    p = view(spark, d, "sites").select("site_id", k).withColumn("p", 0.1 + 0.8 * ((F.col("site_id") * (F.col("k") + 3)) % 11) / 11)
    q = view(spark, d, "samples").select("sample_id", k).withColumn("q", ((F.col("sample_id") + F.col("k")) % 3 + 1) / 6.0)
    return structure.admixture_loglik(view(spark, d, "geno"), p, q).select(F.round("loglik", 4).alias("loglik"))
