"""Simulated genotypes and traits from hashes of keys: the same on any cluster and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*keys: Column, seed: int = 42) -> Column:
    """A number in [0, 1) for each combination of keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def normal(*keys: Column, seed: int = 42) -> Column:
    """A standard normal deviate for each combination of keys (Box and Muller)."""
    u, v = uniform(*keys, seed=seed), uniform(*keys, seed=seed + 1)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * F.pi() * v)


def genotypes(sites: DataFrame, samples: DataFrame, seed: int = 42) -> DataFrame:
    """(site_id, sample_id, g) in Hardy-Weinberg proportions, a frequency in [0.05, 0.5] for each site.

    One row for each site and sample is what is asked for; sites are spread over
    tasks and the samples, a side of checked size, go to each.
    """
    p = 0.05 + 0.45 * uniform(F.col("site_id"), seed=seed)
    grid = sites.select("site_id", p.alias("p")).join(samples.select("sample_id"), F.lit(True))
    a, b = (uniform(F.col("site_id"), F.col("sample_id"), seed=seed + k) < F.col("p") for k in (2, 3))
    return grid.select("site_id", "sample_id", (a.cast("int") + b.cast("int")).alias("g"))


def gate(rows: DataFrame, mode: str = "and") -> DataFrame:
    """(sample_id, x) of a logic gate over binarised sites: heterozygous and missing calls count as the site's commoner homozygote."""
    n0, n2 = F.count_if(F.col("g") == 0), F.count_if(F.col("g") == 2)
    common = rows.groupBy("site_id").agg(F.when(n2 > n0, 1).otherwise(0).alias("major"))
    bit = F.when(F.col("g") == 2, 1).when(F.col("g") == 0, 0).otherwise(F.col("major"))
    bits = rows.join(common, "site_id").withColumn("b", bit)
    fold = {"and": F.min("b"), "or": F.max("b"), "xor": F.bit_xor("b")}[mode]
    return bits.groupBy("sample_id").agg(fold.alias("x"))


def trait(geno: DataFrame, effects: DataFrame, h2: float, seed: int = 42) -> DataFrame:
    """(sample_id, genetic, y): additive values, and noise scaled so that they explain ``h2`` of the variance."""
    value = geno.filter("g is not null").join(effects, "site_id").groupBy("sample_id").agg(F.sum(F.col("g") * F.col("effect")).alias("genetic"))
    spread = value.agg(F.stddev_pop("genetic").alias("_s"))
    noise = normal(F.col("sample_id"), seed=seed) * F.col("_s") * ((1 - h2) / h2) ** 0.5
    return value.join(F.broadcast(spread), F.lit(True)).select("sample_id", "genetic", (F.col("genetic") + noise).alias("y"))


def signed_hash(geno: DataFrame, rates: DataFrame, buckets: int, seed: int = 42) -> DataFrame:
    """(sample_id, bucket, z): centred calls added into hash buckets with a random sign for each site."""
    h = F.xxhash64(F.lit(seed), "site_id")
    sign = F.when(F.shiftrightunsigned(h, 63) == 1, 1.0).otherwise(-1.0)
    j = geno.filter("g is not null").join(rates.select("site_id", "freq"), "site_id")
    return j.groupBy("sample_id", F.pmod(h, F.lit(buckets)).alias("bucket")).agg(F.sum(sign * (F.col("g") - 2 * F.col("freq"))).alias("z"))
