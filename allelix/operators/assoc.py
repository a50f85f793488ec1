"""Association scans: linear models from sums, and what follows a scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import student_p

#: A site whose centred sum of squares is not above this has no estimate.
MIN_SS = 1e-8


def lm_sums(geno: DataFrame, pheno: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Sums of g, y and their products for each site (and each column in ``extra``), over complete pairs.

    One shuffle on the site after partial sums; ``pheno`` has a row for each sample.
    """
    rows = geno.filter("g is not null").join(pheno.filter("y is not null"), "sample_id")
    g, y = F.col("g"), F.col("y")
    return rows.groupBy("site_id", *extra).agg(
        F.count(F.lit(1)).alias("n"), F.sum(g).alias("sg"), F.sum(y).alias("sy"), F.sum(g * g).alias("sgg"), F.sum(y * y).alias("syy"), F.sum(g * y).alias("sgy")
    )


def lm_sums_traits(geno: DataFrame, pheno: DataFrame, trait: str, names: list[str]) -> DataFrame:
    """``lm_sums`` for the named traits at once: ``pheno`` has a row for each sample and trait; a call is read once, not once for each trait.

    A trait of a site without complete pairs has no row.
    """
    wide = pheno.filter("y is not null").groupBy("sample_id").agg(*(F.max(F.when(F.col(trait) == t, F.col("y"))).alias(f"y{x}") for x, t in enumerate(names)))
    g, stats = F.col("g"), ("n", "sg", "sy", "sgg", "syy", "sgy")
    aggs = []
    for x in range(len(names)):
        y = F.col(f"y{x}")
        here = F.when(y.isNotNull(), g)
        aggs += [a.alias(f"{s}{x}") for s, a in zip(stats, (F.count(y), F.sum(here), F.sum(y), F.sum(here * here), F.sum(y * y), F.sum(g * y)))]
    sums = geno.filter("g is not null").join(wide, "sample_id").groupBy("site_id").agg(*aggs)
    each = F.array(*(F.struct(F.lit(t).alias(trait), *(F.col(f"{s}{x}").alias(s) for s in stats)) for x, t in enumerate(names)))
    return sums.select("site_id", F.inline(each)).filter("n > 0")


def lm_estimates(sums: DataFrame) -> DataFrame:
    """Effect, standard error, t, Wald and likelihood-ratio statistics; null where there is no estimate."""
    n, d = F.col("n").cast("double"), lambda c: F.col(c).cast("double")
    ss = d("sgg") - d("sg") * d("sg") / n
    sp = d("sgy") - d("sg") * d("sy") / n
    st = d("syy") - d("sy") * d("sy") / n
    df = F.col("n") - 2
    good = (df > 0) & (ss > MIN_SS)
    out = sums.withColumns({"df": df.cast("long"), "beta": F.when(good, sp / ss), "_ss": ss, "_st": st})
    rss = F.greatest(F.col("_st") - F.col("beta") * sp, F.lit(0.0))
    out = out.withColumn("se", F.sqrt(F.try_divide(rss, F.col("df") * F.col("_ss"))))
    out = out.withColumn("t", F.try_divide(F.col("beta"), F.col("se")))
    lrt = n * F.log1p(F.col("t") * F.col("t") / F.col("df"))
    return out.withColumns({"chisq": F.col("t") * F.col("t"), "plrt_stat": F.when(good, lrt)}).drop("_ss", "_st")


def _solve(covariates: tuple[str, ...]):
    k = len(covariates) + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = len(f)
            names = ["one", *covariates]
            xx = np.empty((m, k, k))
            for i in range(k):
                for j in range(i, k):
                    xx[:, i, j] = xx[:, j, i] = f[f"x_{names[i]}_{names[j]}"]
            xg = np.stack([f[f"g_{c}"] for c in names], 1).astype(float)
            xy = np.stack([f[f"y_{c}"] for c in names], 1).astype(float)
            inv = np.linalg.pinv(xx, hermitian=True)
            rank = np.linalg.matrix_rank(xx, hermitian=True)
            ss = f["sgg"].to_numpy(float) - np.einsum("mi,mij,mj->m", xg, inv, xg)
            sp = f["sgy"].to_numpy(float) - np.einsum("mi,mij,mj->m", xg, inv, xy)
            st = f["syy"].to_numpy(float) - np.einsum("mi,mij,mj->m", xy, inv, xy)
            df = f["n"].to_numpy() - rank - 1
            good = (df > 0) & (ss > MIN_SS)
            with np.errstate(all="ignore"):
                beta = np.where(good, sp / ss, np.nan)
                se = np.sqrt(np.maximum(st - beta * sp, 0) / df / ss)
                t = beta / se
            yield pd.DataFrame({"site_id": f["site_id"], "n": f["n"], "df": df.astype(np.int64), "beta": beta, "se": se, "t": t, "p": student_p(t, df)})

    return run


def lm_covariates(geno: DataFrame, pheno: DataFrame, covariates: tuple[str, ...]) -> DataFrame:
    """LM scan with covariates: cross products for each site in Spark, a small solve for each site in numpy."""
    rows = geno.filter("g is not null").join(pheno.dropna(subset=["y", *covariates]), "sample_id").withColumn("one", F.lit(1))
    names = ["one", *covariates]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("g") * F.col("g")).alias("sgg"), F.sum(F.col("g") * F.col("y")).alias("sgy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    for i, a in enumerate(names):
        aggs += [F.sum(F.col("g") * F.col(a)).alias(f"g_{a}"), F.sum(F.col("y") * F.col(a)).alias(f"y_{a}")]
        aggs += [F.sum(F.col(a) * F.col(b)).alias(f"x_{a}_{b}") for b in names[i:]]
    kind = "site_id long, n long, df long, beta double, se double, t double, p double"
    return rows.groupBy("site_id").agg(*aggs).mapInPandas(_solve(covariates), kind)


def sanitize_p(beta: Column, se: Column, p: Column) -> Column:
    """p-value for output: 1 where effect, error or p is not finite or the error not positive."""
    bad = lambda c: c.isNull() | F.isnan(c)
    return F.when(bad(beta) | bad(se) | bad(p) | (se <= 0), 1.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(2.2250738585072014e-308)))


def lead_per_bin(hits: DataFrame, size: int, top: int) -> DataFrame:
    """Of each bin of ``size`` bases the site with the least p, then the ``top`` best of these."""
    w = Window.partitionBy("chrom", F.floor(F.col("pos") / size)).orderBy("p", "site_id")
    return hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").orderBy("p", "site_id").limit(top)


def sequential_qtn(leads: DataFrame, saved: DataFrame, threshold: float) -> DataFrame:
    """Union of new leads and saved ones, within the threshold, one for each position: the least p."""
    both = leads.select("site_id", "chrom", "pos", "p").unionByName(saved.select("site_id", "chrom", "pos", "p")).filter(F.col("p") <= threshold)
    w = Window.partitionBy("chrom", "pos").orderBy("p", "site_id")
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dispatch(models: DataFrame, traits: DataFrame) -> DataFrame:
    """The plan of a run: each trait with each model, and the route that computes it."""
    route = F.when(F.col("model").isin("lm", "lm2"), "sums").when(F.col("model") == "farmcpu", "iterate").otherwise("blocks")
    return traits.join(models, F.lit(True)).withColumn("route", route)


def bonferroni(hits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows with p at most alpha over the number of rows of the table."""
    total = hits.agg(F.count(F.lit(1)).alias("_n"))
    return hits.join(F.broadcast(total), F.lit(True)).filter(F.col("p") * F.col("_n") <= alpha).drop("_n")
