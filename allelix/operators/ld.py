"""Linkage disequilibrium: pairs in a window, scores, pruning and clumping; relationship from shared calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .blocks import pair_sums as block_sums
from .windows import with_halo

SLACK = 1 + 1e-12


def pair_sums(geno: DataFrame, sites: DataFrame, window: int) -> DataFrame:
    """(i, j, sums) for pairs of sites of a chromosome at most ``window`` bases apart, i before j, over samples with both calls.

    Calls meet by (sample, chromosome, bin): the earlier site looks into its own bin
    and the next, so the join is an equality and its keys are many.
    """
    calls = geno.filter("g is not null").join(sites.select("site_id", "chrom", "pos"), "site_id").withColumn("bin", F.floor(F.col("pos") / window))
    a = calls.select("sample_id", "chrom", F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"), F.col("site_id").alias("i"), F.col("pos").alias("pi"), F.col("g").alias("gi"))
    b = calls.select("sample_id", "chrom", "bin", F.col("site_id").alias("j"), F.col("pos").alias("pj"), F.col("g").alias("gj"))
    ahead = (F.col("pj") > F.col("pi")) | ((F.col("pj") == F.col("pi")) & (F.col("j") > F.col("i")))
    pairs = a.join(b, ["sample_id", "chrom", "bin"]).filter(ahead & (F.col("pj") - F.col("pi") <= window))
    gi, gj = F.col("gi"), F.col("gj")
    return pairs.groupBy("i", "j").agg(
        F.first("chrom").alias("chrom"), F.count(F.lit(1)).alias("n"), F.sum(gi).alias("si"), F.sum(gj).alias("sj"),
        F.sum(gi * gi).alias("sii"), F.sum(gj * gj).alias("sjj"), F.sum(gi * gj).alias("sij"),
    )


def r_squared(sums: DataFrame) -> DataFrame:
    """Pairwise-complete squared correlation; null where a site does not vary."""
    r = pearson(*(F.col(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")))
    return sums.withColumn("r2", r * r)


def ld_scores(pairs: DataFrame, rates: DataFrame, sites: DataFrame, window: int) -> DataFrame:
    """Score of each site: 1 if it varies and has two calls, plus r2 with every site in its window; and the window's size."""
    both = pairs.select("i", "r2").unionByName(pairs.select(F.col("j").alias("i"), "r2")).groupBy("i").agg(F.sum("r2").alias("s"))
    own = F.when((F.col("n") - F.col("missing") > 1) & (F.col("maf") > 0), 1.0).otherwise(0.0)
    near = F.count(F.lit(1)).over(Window.partitionBy("chrom", "_block").orderBy("pos").rangeBetween(-window, window))
    size = with_halo(sites, window, max(1_000_000, 50 * window)).withColumn("m", near).filter("_own").select("site_id", "m")
    return rates.join(size, "site_id").join(both, F.col("site_id") == F.col("i"), "left").select("site_id", (own + F.coalesce("s", F.lit(0.0))).alias("ld_score"), "m")


def _prune_chrom(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        maf = dict(zip(pdf["i"], pdf["maf_i"])) | dict(zip(pdf["j"], pdf["maf_j"]))
        gone: set = set()
        order = [*(["window"] if "window" in pdf else []), "pos_i", "i", "pos_j", "j"]
        for r in pdf[pdf["r2"] > threshold * SLACK].sort_values(order).itertuples():
            if r.i in gone or r.j in gone:
                continue
            gone.add(r.i if maf[r.i] < (1 - 1e-12) * maf[r.j] else r.j)
        return pd.DataFrame({"site_id": sorted(gone)}, dtype="int64")

    return run


def prune(pairs: DataFrame, rates: DataFrame, sites: DataFrame, threshold: float) -> DataFrame:
    """Sites that LD pruning removes: going through correlated pairs in order, the one with the smaller maf goes (ties: the later).

    Only pairs above the threshold reach a chromosome's task, as removal depends on order.
    """
    info = rates.select("site_id", "maf").join(sites.select("site_id", "pos"), "site_id")
    p = pairs.filter(F.col("r2") > threshold).select("chrom", "i", "j", "r2")
    for e in ("i", "j"):
        p = p.join(info.select(F.col("site_id").alias(e), F.col("maf").alias(f"maf_{e}"), F.col("pos").alias(f"pos_{e}")), e)
    return p.groupBy("chrom").applyInPandas(_prune_chrom(threshold), "site_id long")


def by_count(sites: DataFrame) -> DataFrame:
    """Sites with their number on the chromosome, from 0, as ``pos``: windows over it count variants.

    Ordered by one task for a chromosome, three columns of its sites only.
    """
    n = F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "site_id")) - 1
    return sites.select("site_id", "chrom", n.cast("long").alias("pos"))


def prune_count(geno: DataFrame, rates: DataFrame, sites: DataFrame, variants: int, step: int, threshold: float) -> DataFrame:
    """Sites that pruning removes in windows of so many variants, moved on by ``step``.

    A pair is decided in the first window that holds both; windows go in order, pairs of
    a window by their sites, and the rule is that of ``prune``.  A pair that no window
    holds is never compared.
    """
    numbered = by_count(sites)
    a, b = F.col("pos_i"), F.col("pos_j")
    pairs = r_squared(pair_sums(geno, numbered, max(variants - 1, 1))).filter(F.col("r2") > threshold).select("chrom", "i", "j", "r2")
    info = rates.select("site_id", "maf").join(numbered.select("site_id", "pos"), "site_id")
    for e in ("i", "j"):
        pairs = pairs.join(info.select(F.col("site_id").alias(e), F.col("maf").alias(f"maf_{e}"), F.col("pos").alias(f"pos_{e}")), e)
    first = F.greatest(F.ceil((b - variants + 1) / step), F.lit(0))
    return pairs.withColumn("window", first).filter((F.col("window") * step <= a) & (b - a < variants)).groupBy("chrom").applyInPandas(_prune_chrom(threshold), "site_id long")


def _clump_chrom(threshold: float):
    def run(hits: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for r in pairs[pairs["r2"] >= threshold].itertuples():
            near.setdefault(r.i, {})[r.j] = r.r2
            near.setdefault(r.j, {})[r.i] = r.r2
        hits = hits.sort_values(["p", "site_id"])
        pos = dict(zip(hits["site_id"], hits["pos"]))
        left, out = dict.fromkeys(hits["site_id"]), []
        for lead in hits["site_id"]:
            if lead not in left:
                continue
            members = [x for x in near.get(lead, {}) if x in left and x != lead]
            for x in [lead, *members]:
                del left[x]
            where = [pos[x] for x in [lead, *members]]
            mean = float(np.mean([near[lead][x] for x in members])) if members else float("nan")
            out.append((lead, min(where), max(where), len(where), mean, ";".join(str(x) for x in sorted([lead, *members]))))
        return pd.DataFrame(out, columns=["site_id", "start", "stop", "n_snps", "mean_r2", "members"])

    return run


def clump(hits: DataFrame, pairs: DataFrame, threshold: float, alpha: float) -> DataFrame:
    """Significant sites in order of p: each lead takes the correlated sites left in its window."""
    significant = hits.filter(F.col("p") <= alpha).select("chrom", "site_id", "pos", "p")
    kind = "site_id long, start long, stop long, n_snps long, mean_r2 double, members string"
    return significant.groupBy("chrom").cogroup(pairs.select("chrom", "i", "j", "r2").groupBy("chrom")).applyInPandas(_clump_chrom(threshold), kind)


def king(geno: DataFrame) -> DataFrame:
    """Kinship of sample pairs over shared sites: (both het - 2 opposite homozygotes) / (het_i + het_j)."""
    calls = geno.filter("g is not null").select("site_id", "sample_id", F.lit(1).alias("one"), *((F.col("g") == v).cast("int").alias(f"g{v}") for v in (0, 1, 2)))
    products = [(2, 0), (0, 2), (2, 2), (1, 3), (3, 1), (1, 1), (3, 3)]
    s = block_sums(calls, "site_id", "sample_id", ["one", "g0", "g1", "g2"], products)
    n, het_i, het_j, both, up, down, hom0, hom2 = (F.col(c).cast("long") for c in ("n", *(f"s{x}" for x in range(7))))
    pairs = s.select(
        "i", "j", n.alias("shared"), (up + down).alias("ibs0"), (n - up - down - both - hom0 - hom2).alias("ibs1"), (both + hom0 + hom2).alias("ibs2"),
        het_i.alias("het_i"), het_j.alias("het_j"), both.alias("both_het"),
    )
    return pairs.withColumn("kinship", F.try_divide((F.col("both_het") - 2 * F.col("ibs0")).cast("double"), F.col("het_i") + F.col("het_j")))


def unrelated(edges: list[tuple[int, int]]) -> list[int]:
    """Vertices removed until no edge is left: always one of most edges, of these the largest number."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    gone = []
    while any(near.values()):
        x = max(near, key=lambda v: (len(near[v]), v))
        gone.append(x)
        for y in near.pop(x):
            near[y].discard(x)
    return gone


def grm(geno: DataFrame, rates: DataFrame, method: int = 1) -> DataFrame:
    """Relationship matrix (i, j, k) with i <= j: centred products over the sum of 2p(1-p), or standardised over the number of sites.

    Missing calls count as the mean, so they add nothing.
    """
    p = rates.filter((F.col("freq") > 0) & (F.col("freq") < 1)).select("site_id", "freq")
    var = 2 * F.col("freq") * (1 - F.col("freq"))
    scale = p.agg(F.sum(var).alias("total"), F.count(F.lit(1)).alias("m"))
    z = geno.filter("g is not null").join(p, "site_id").withColumn("z", (F.col("g") - 2 * F.col("freq")) / (F.sqrt(var) if method == 2 else F.lit(1.0)))
    sums = block_sums(z, "site_id", "sample_id", ["z"], [(0, 0)], diagonal=True).withColumnRenamed("s0", "s")
    return sums.join(F.broadcast(scale), F.lit(True)).select("i", "j", (F.col("s") / (F.col("m") if method == 2 else F.col("total"))).alias("k"))


def sparse_grm(k: DataFrame, threshold: float) -> DataFrame:
    return k.filter((F.col("i") == F.col("j")) | (F.col("k") > threshold))


def site_weights_product(geno: DataFrame, rates: DataFrame, alpha: DataFrame) -> DataFrame:
    """For each sample the sum over sites of (g - 2p) times the site's weight."""
    j = geno.filter("g is not null").join(rates.select("site_id", "freq"), "site_id").join(alpha.select("site_id", "w"), "site_id")
    return j.groupBy("sample_id").agg(F.sum((F.col("g") - 2 * F.col("freq")) * F.col("w")).alias("v"))


def jc69(mismatch: Column) -> Column:
    """Jukes-Cantor distance of a mismatch rate; 1 beyond its range."""
    x = 1 - 4 * mismatch / 3
    return F.when(x > 0, F.least(-0.75 * F.log(F.greatest(x, F.lit(1e-300))), F.lit(1.0))).otherwise(1.0)


def sequence_distances(bases: DataFrame, least: int) -> DataFrame:
    """Distance of each pair of taxa over sites where both are A, C, G or T; 1 where they share too few."""
    ok = bases.filter(F.col("base").isin("A", "C", "G", "T")).select("site_id", "taxon", *((F.col("base") == x).cast("int").alias(x) for x in "ACGT"))
    s = block_sums(ok, "site_id", "taxon", list("ACGT"), [[(x, x) for x in range(4)]]).select("i", "j", F.col("n").alias("shared"), (F.col("n") - F.col("s0").cast("long")).alias("different"))
    rate = F.col("different") / F.col("shared")
    return s.withColumn("distance", F.when(F.col("shared") < least, 1.0).otherwise(jc69(rate)))


def correlation_pairs(long: DataFrame, unit: str, feature: str, value: str) -> DataFrame:
    """Pearson correlation of feature pairs over units with both."""
    cells = long.select(unit, feature, F.lit(1).alias("one"), F.col(value).cast("double").alias("x")).filter("x is not null").withColumn("xx", F.col("x") * F.col("x"))
    s = block_sums(cells, unit, feature, ["one", "x", "xx"], [(1, 0), (0, 1), (2, 0), (0, 2), (1, 1)])
    s = s.withColumn("r", pearson(F.col("n").cast("double"), *(F.col(f"s{x}") for x in range(5))))
    return s.select("i", "j", "n", "r")


def adjacency(pairs: DataFrame, power: int, signed: bool = False) -> DataFrame:
    base = 0.5 * F.col("r") + 0.5 if signed else F.abs("r")
    return pairs.filter("r is not null").select("i", "j", F.pow(base, float(power)).alias("a"))


def topological_overlap(adj: DataFrame) -> DataFrame:
    """(l_ij + a_ij) / (min(k_i, k_j) + 1 - a_ij), with l the paths of length two and k the degrees."""
    both = adj.unionByName(adj.select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    degree = both.groupBy("i").agg(F.sum("a").alias("k"))
    paths = block_sums(both, "j", "i", ["a"], [(0, 0)]).select("i", "j", F.col("s0").alias("l"))
    t = adj.join(paths, ["i", "j"], "left").join(degree.withColumnRenamed("k", "ki"), "i").join(degree.select(F.col("i").alias("j"), F.col("k").alias("kj")), "j")
    return t.select("i", "j", ((F.coalesce("l", F.lit(0.0)) + F.col("a")) / (F.least("ki", "kj") + 1 - F.col("a"))).alias("tom"))
