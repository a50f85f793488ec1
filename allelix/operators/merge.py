"""Merging genotype panels on (chrom, pos) with allele harmonisation; hybrids; set operations on sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complement(a: Column) -> Column:
    return F.translate(a, "ACGT", "TGCA")


def allele_map(ref: Column, alt: Column, r: Column, a: Column) -> Column:
    """How (r, a) reads in terms of (ref, alt): identity or swap first, so palindromes never count as strand flips; null if not at all."""
    return (
        F.when((r == ref) & (a == alt), "identity").when((r == alt) & (a == ref), "swap")
        .when((complement(r) == ref) & (complement(a) == alt), "strand").when((complement(r) == alt) & (complement(a) == ref), "strand_swap")
    )


def panel_sites(sites: DataFrame, index: int) -> DataFrame:
    """The biallelic SNPs of one input, whether they have calls or not; of repeated coordinates the first site counts."""
    snp = sites.filter(F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & (F.col("ref") != F.col("alt")))
    w = Window.partitionBy("chrom", "pos").orderBy("site_id")
    return snp.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("site_id", "chrom", "pos", "ref", "alt", F.lit(index).alias("input"))


def panel(calls: DataFrame, sites: DataFrame, index: int) -> DataFrame:
    """Calls of one input with its biallelic SNPs."""
    return calls.join(panel_sites(sites, index), "site_id").select("chrom", "pos", "ref", "alt", "input", "sample_id", "g")


def site_table(panels: list[DataFrame]) -> DataFrame:
    """One row for each site: the alleles of the first input that has it, and how each input maps to them."""
    every = reduce(DataFrame.unionByName, [p.select("chrom", "pos", "input", "ref", "alt").distinct() for p in panels])
    chosen = every.groupBy("chrom", "pos").agg(F.min(F.struct("input", "ref", "alt")).alias("m"))
    return every.join(chosen, ["chrom", "pos"]).select(
        "chrom", "pos", "input", F.col("m.ref").alias("ref"), F.col("m.alt").alias("alt"),
        allele_map(F.col("m.ref"), F.col("m.alt"), F.col("ref"), F.col("alt")).alias("map"),
    )


def merge_panels(panels: list[DataFrame], sites: list[DataFrame] | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, input, sample_id, g) in the alleles of the merged sites; inputs that cannot be aligned are left out.

    ``sites`` are the inputs' site tables: the first that lists a site gives its
    alleles, with calls or without.  Where they are not given, sites without calls are not known.
    A sample that is absent from a site has no row there, which is how long tables say missing.
    """
    maps = site_table(sites or panels).filter("map is not null")
    calls = reduce(DataFrame.unionByName, panels).select("chrom", "pos", "input", "sample_id", "g")
    swapped = F.col("map").isin("swap", "strand_swap")
    return calls.join(maps, ["chrom", "pos", "input"]).select("chrom", "pos", "ref", "alt", "input", "sample_id", F.when(swapped, 2 - F.col("g")).otherwise(F.col("g")).alias("g"))


def merge_counts(panels: list[DataFrame]) -> DataFrame:
    """For each input: sites present, absent from it, and not alignable."""
    sites = site_table(panels)
    total = sites.select("chrom", "pos").distinct().agg(F.count(F.lit(1)).alias("total"))
    per = sites.groupBy("input").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("map").isNull()).alias("unaligned"))
    return per.join(F.broadcast(total), F.lit(True)).select("input", "present", (F.col("total") - F.col("present")).alias("absent"), "unaligned")


def hybrids(geno: DataFrame, mothers: DataFrame, fathers: DataFrame) -> DataFrame:
    """Calls of every cross: the mean of both parents' calls at sites that both have; null if either is missing."""
    m = geno.join(mothers.select("sample_id"), "sample_id").select("site_id", F.col("sample_id").alias("mother"), F.col("g").alias("gm"))
    f = geno.join(fathers.select("sample_id"), "sample_id").select("site_id", F.col("sample_id").alias("father"), F.col("g").alias("gf"))
    return m.join(f, "site_id").select("site_id", "mother", "father", ((F.col("gm") + F.col("gf")) / 2.0).alias("g"))


def orient_to_reference(sites: DataFrame, bases: DataFrame) -> DataFrame:
    """Sites with the reference genome's base as ``ref``; ``action`` says keep, swap or mismatch."""
    j = sites.join(bases.select("chrom", "pos", "base"), ["chrom", "pos"])
    action = F.when(F.col("ref") == F.col("base"), "keep").when(F.col("alt") == F.col("base"), "swap").otherwise("mismatch")
    j = j.withColumn("action", action)
    swap = F.col("action") == "swap"
    return j.withColumns({"new_ref": F.when(swap, F.col("alt")).otherwise(F.col("ref")), "new_alt": F.when(swap, F.col("ref")).otherwise(F.col("alt"))})


def group_links(rows: DataFrame, group: str) -> DataFrame:
    """Pairs of the distinct endpoints of a group, ordered, with the group's least p."""
    ends = rows.groupBy(group, "chrom", "pos").agg(F.min("p").alias("p"))
    best = ends.groupBy(group).agg(F.min("p").alias("min_p"))
    a = ends.select(group, F.struct("chrom", "pos").alias("a"))
    b = ends.select(group, F.struct("chrom", "pos").alias("b"))
    return a.join(b, group).filter(F.col("a") < F.col("b")).join(best, group).select(group, F.col("a.chrom").alias("chrom_a"), F.col("a.pos").alias("pos_a"), F.col("b.chrom").alias("chrom_b"), F.col("b.pos").alias("pos_b"), "min_p")
