"""Operators on tables of hits, samples and names that belong to no larger group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TINY, pearson
from .intervals import merge_ranges
from .windows import global_rank


def align_samples(*tables: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, idx): samples that every table has, numbered in ascending order."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key).distinct(), key, "left_semi")
    return out.withColumn("idx", (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))  # one row for each sample


def add_names(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Association rows with the SNP names of their coordinates; null where there is none."""
    first = sites.groupBy("chrom", "pos").agg(F.min("snp").alias("snp"))
    return hits.join(first, ["chrom", "pos"], "left")


def is_combination(role: Column, name: Column) -> Column:
    """A rule over several sites: by its role, or where that is absent by an operator in its name."""
    return F.when(role.isNotNull() & (F.trim(role) != ""), F.lower(F.trim(role)) == "combo").otherwise(name.rlike(r"[&|*]"))


def combination_summary(rows: DataFrame) -> DataFrame:
    """Least p, least adjusted p and size of each combination with two sites at least."""
    parts = rows.withColumn("site", F.explode(F.split("snp", r"[&|*]")))
    out = parts.groupBy(F.col("snp").alias("combo")).agg(F.min("p").alias("p"), F.min("padj").alias("padj"), F.countDistinct(F.trim("site")).alias("size"))
    return out.filter(F.col("size") >= 2)


def significant_table(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits at or below the threshold, one for each position (the least p), numbered by p."""
    w = Window.partitionBy("chrom", "pos").orderBy("p", "site_id")
    best = hits.filter(F.col("p") <= threshold).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return global_rank(best, "p", "site_id")


def lead_windows(hits: DataFrame, threshold: float, reach: int) -> DataFrame:
    """Windows around significant sites, overlapping ones as one."""
    w = hits.filter(F.col("p") <= threshold)
    return merge_ranges(w.select("chrom", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), (F.col("pos") + reach).alias("stop")))


def lead_r2(geno: DataFrame, sites: DataFrame, lead: DataFrame, reach: int) -> DataFrame:
    """(lead, site_id, r2) of each lead site with the sites within reach, missing calls as the site's mean."""
    size = max(reach, 1)  # a lead meets the sites of its own bin and the two beside it
    bins = F.explode(F.array(*(F.floor(F.col("pos") / size) + x for x in (-1, 0, 1)))).alias("_bin")
    binned = sites.select("site_id", "chrom", "pos", F.floor(F.col("pos") / size).alias("_bin"))
    near = lead.select(F.col("site_id").alias("lead"), "chrom", F.col("pos").alias("_p"), bins).join(binned, ["chrom", "_bin"]).filter(F.abs(F.col("pos") - F.col("_p")) <= reach)
    mean = geno.groupBy("site_id").agg(F.avg("g").alias("m"))
    full = geno.join(mean, "site_id").select("site_id", "sample_id", F.coalesce(F.col("g").cast("double"), F.col("m"), F.lit(0.0)).alias("x"))
    a = near.select("lead", "site_id").join(full.select(F.col("site_id").alias("lead"), "sample_id", F.col("x").alias("a")), "lead")
    j = a.join(full.select("site_id", "sample_id", F.col("x").alias("b")), ["site_id", "sample_id"])
    x, y = F.col("a"), F.col("b")
    s = j.groupBy("lead", "site_id").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    r = pearson(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return s.select("lead", "site_id", "n", (r * r).alias("r2"))


def clean_chrom(c: Column) -> Column:
    """Upper case without CHR; whole numbers as integers; NA, NULL, NAN and blanks as null."""
    name = F.regexp_replace(F.upper(F.trim(c)), "^CHR", "")
    number = F.when(name.rlike("^[0-9]{1,9}([.]0+)?$"), name).try_cast("double").cast("long").cast("string")
    return F.when(name.isin("", "NA", "NULL", "NAN"), None).otherwise(F.coalesce(number, name))


def plain_chrom(c: Column) -> Column:
    """Trimmed, without chr in any case; the case of the rest stays."""
    return F.regexp_replace(F.trim(c), "^(?i)chr", "")


def rows_at(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sites in the order of a list: ``wanted`` are (idx, chrom, pos); positions that no site has go."""
    return sites.join(wanted.select("idx", "chrom", "pos"), ["chrom", "pos"])


def iupac(a: Column, b: Column) -> Column:
    """The code of a pair of bases; N where either is none."""
    pair = F.array_join(F.array_sort(F.array(a, b)), "")
    codes = {"AA": "A", "CC": "C", "GG": "G", "TT": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[pair], F.lit("N"))


def chisq_of(beta: Column, se: Column) -> Column:
    return F.when((se > 0) & beta.isNotNull(), F.pow(beta / se, F.lit(2.0))).otherwise(0.0)


def clamp_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), 1.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(TINY)))


def compress_effects(effects: DataFrame, keep: int, buckets: int) -> DataFrame:
    """The strongest effects, and of the others the strongest in each stretch of the genome."""
    strength = [F.desc(F.abs("beta")), "site_id"]
    strong = effects.orderBy(*strength).limit(keep)
    rest = effects.join(F.broadcast(strong.select("site_id")), "site_id", "left_anti").withColumn("_b", F.floor(F.col("pos") / buckets))  # ``keep`` rows
    best = rest.withColumn("_k", F.row_number().over(Window.partitionBy("chrom", "_b").orderBy(*strength))).filter("_k = 1")
    return strong.unionByName(best.drop("_b", "_k"))


def prepared_sites(rates: DataFrame, maf: float, miss: float) -> DataFrame:
    """Statistics of a packed panel: (site_id, miss, maf, sd, flip, keep)."""
    return rates.select("site_id", "miss", "maf", F.sqrt(2 * F.col("maf") * (1 - F.col("maf"))).alias("sd"), (F.col("freq") > 0.5).alias("flip"), ((F.col("miss") <= miss) & (F.col("maf") >= maf)).alias("keep"))


def site_covariates(geno: DataFrame, sites: DataFrame, tokens: list[tuple[str, int]]) -> DataFrame:
    """Calls at the named positions, one column for each, to use as covariates."""
    wanted = sites.filter(F.exists(F.array(*((F.col("chrom") == c) & (F.col("pos") == p) for c, p in tokens)), lambda t: t)).select("site_id", "chrom", "pos")
    j = geno.join(F.broadcast(wanted), "site_id")
    return j.groupBy("sample_id").agg(*(F.max(F.when((F.col("chrom") == c) & (F.col("pos") == p), F.col("g"))).alias(f"{c}_{p}") for c, p in tokens))


def permutation_null(hits: DataFrame, response: DataFrame, key: str, rounds: int, seed: int = 42) -> DataFrame:
    """(round, best): the best absolute MCC under responses shuffled by hash, to set a threshold by its quantiles."""
    from .scores import confusion, mcc

    out = None
    for k in range(rounds):
        n = Window.orderBy(F.xxhash64(F.lit(seed + k), "sample_id"))
        a = response.withColumn("_i", F.row_number().over(n)).select("sample_id", "_i")
        b = response.withColumn("_i", F.row_number().over(Window.orderBy("sample_id"))).select("_i", "y")
        c = confusion(hits, a.join(b, "_i").select("sample_id", "y"), key)
        one = c.agg(F.max(F.abs(mcc())).alias("best")).select(F.lit(k).cast("long").alias("round"), "best")
        out = one if out is None else out.unionByName(one)
    return out
