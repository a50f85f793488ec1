"""Quality control of genotype calls: filters, allele flips, imputation, coding, and the statistics they need.

Calls are long tables (site_id, sample_id, g) with g in 0, 1, 2 or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def site_counts(geno: DataFrame, by: str = "site_id") -> DataFrame:
    """Counts for each site (or sample): calls, missing, het, homozygous alternate, and the dosage sum."""
    g = F.col("g")
    return geno.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(g.isNull()).alias("missing"), F.count_if(g == 1).alias("het"),
        F.count_if(g == 2).alias("hom_alt"), F.coalesce(F.sum(g), F.lit(0)).cast("long").alias("dosage"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def site_rates(counts: DataFrame) -> DataFrame:
    """Alternate and minor allele frequency, missing rate and heterozygosity."""
    seen = F.col("n") - F.col("missing")
    p = ratio(F.col("dosage"), 2 * seen)
    return counts.withColumns({"freq": p, "maf": F.least(p, 1 - p), "miss": ratio(F.col("missing"), F.col("n")), "het_rate": ratio(F.col("het"), seen)})


def qc_verdict(rates: DataFrame, maf: float = 0.05, miss: float = 0.1, het: float = 1.0) -> DataFrame:
    """The first rule that a site breaks, in fixed order: missing, all missing, het, maf; null where it is kept.

    A site without calls is kept only if ``maf`` is 0; het counts only below 1.
    """
    verdict = (
        F.when(F.col("miss") > miss, "missing")
        .when(F.col("n") == F.col("missing"), F.when(F.lit(maf > 0), "all_missing"))
        .when(F.lit(het < 1) & (F.col("het_rate") > het), "het")
        .when(F.col("maf") < maf, "maf")
    )
    return rates.withColumn("verdict", verdict)


def qc_filter(geno: DataFrame, maf: float = 0.05, miss: float = 0.1, het: float = 1.0) -> DataFrame:
    """Sites that pass, with their rates."""
    return qc_verdict(site_rates(site_counts(geno)), maf, miss, het).filter("verdict is null").drop("verdict")


def flip_minor(geno: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls in copies of the minor allele: g becomes 2 - g where the alternate frequency is above one half."""
    joined = geno.join(rates.select("site_id", "freq"), "site_id")
    flipped = F.col("freq") > 0.5
    return joined.withColumns({"g": F.when(flipped, 2 - F.col("g")).otherwise(F.col("g")), "flipped": flipped}).drop("freq")


def impute_mean(geno: DataFrame) -> DataFrame:
    """Missing calls get the mean of the site's calls, 0 where there are none."""
    mean = geno.groupBy("site_id").agg(F.avg("g").alias("mean_g"))
    filled = F.coalesce(F.col("g").cast("double"), F.col("mean_g"), F.lit(0.0))
    return geno.join(mean, "site_id").select("site_id", "sample_id", filled.alias("g"))


def impute_mode(geno: DataFrame) -> DataFrame:
    """Missing calls get the site's most frequent call; ties go to the smaller, sites without calls to 0."""
    c = site_counts(geno)
    hom_ref = F.col("n") - F.col("missing") - F.col("het") - F.col("hom_alt")
    mode = F.when((hom_ref >= F.col("het")) & (hom_ref >= F.col("hom_alt")), 0).when(F.col("het") >= F.col("hom_alt"), 1).otherwise(2)
    return geno.join(c.select("site_id", mode.alias("mode_g")), "site_id").select("site_id", "sample_id", F.coalesce("g", "mode_g").alias("g"))


def code_model(g: Column, model: str) -> Column:
    """Genetic model: additive, dominant, recessive or heterozygous."""
    return {"add": g, "dom": F.when(g >= 1, 1).when(g < 1, 0), "rec": F.when(g >= 2, 1).when(g < 2, 0), "het": F.when(g == 1, 1).when(g.isNotNull(), 0)}[model]


def logic_mask(geno: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Sites of pure lines: a heterozygous call counts as missing."""
    bad = F.count_if(F.col("g").isNull() | (F.col("g") == 1))
    return geno.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).filter(F.col("bad") <= max_missing * F.col("n"))


def both_margins(geno: DataFrame) -> DataFrame:
    """Counts for each site and for each sample in one pass."""
    return (
        geno.groupingSets([["site_id"], ["sample_id"]], "site_id", "sample_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("g") == 1).alias("het"))
        .select("site_id", "sample_id", "n", "missing", "het")
    )


def is_simple_snp(ref: Column, alt: Column) -> Column:
    """One of A, C, G, T on either side, and not the same."""
    return ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$") & (ref != alt)


def normal_chrom(c: Column) -> Column:
    """Chromosome key: white space and a leading ``chr`` go, letters are upper case."""
    return F.upper(F.regexp_replace(F.trim(c), "^(?i)chr", ""))


def keep_sites(
    sites: DataFrame, chroms: list[str] | None = None, bp_min: int | None = None, bp_max: int | None = None,
    spans: list[tuple[str, int, int]] | None = None, exact: DataFrame | None = None,
) -> DataFrame:
    """Sites that meet every given condition; ``spans`` are alternatives, ``exact`` holds (chrom, pos) rows."""
    key = normal_chrom(F.col("chrom"))
    if chroms is not None:
        sites = sites.filter(key.isin([str(c).removeprefix("chr").upper() for c in chroms]))
    if bp_min is not None:
        sites = sites.filter(F.col("pos") >= bp_min)
    if bp_max is not None:
        sites = sites.filter(F.col("pos") <= bp_max)
    if spans:
        tests = [(key == c) & F.col("pos").between(a, b) for c, a, b in spans]
        sites = sites.filter(F.exists(F.array(*tests), lambda t: t))
    if exact is not None:
        keys = exact.select(F.concat_ws(":", normal_chrom(F.col("chrom")), F.col("pos").cast("string")).alias("_k")).distinct()
        sites = sites.withColumn("_k", F.concat_ws(":", key, F.col("pos").cast("string"))).join(keys, "_k", "left_semi").drop("_k")
    return sites


def rename_snps(sites: DataFrame, template: str) -> DataFrame:
    """SNP names from a template in which CHR and POS stand for the site's."""
    name = F.replace(F.replace(F.lit(template), F.lit("CHR"), F.col("chrom")), F.lit("POS"), F.col("pos").cast("string"))
    return sites.withColumn("snp", name)


def in_order(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted, with the wanted order as ``ord``; of repeated wishes the first counts."""
    first = wanted.groupBy(key).agg(F.min("ord").alias("ord"))
    return rows.join(first, key)


def expand_selector(text: str) -> list[str]:
    """'1-3,X' to ['1', '2', '3', 'X'], without repeats."""
    out: list[str] = []
    for token in (t.strip() for t in text.split(",") if t.strip()):
        a, dash, b = token.partition("-")
        names = [str(k) for k in range(int(a), int(b) + 1)] if dash and a.isdigit() and b.isdigit() else [token]
        out += [n for n in names if n not in out]
    return out


def order_of_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row for each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
