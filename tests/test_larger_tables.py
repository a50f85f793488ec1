"""Inputs beyond the small tables: sums over 64 bits, many ids, sites without calls, sparse bits, large groups."""

import math

import pyspark.sql.functions as F
import pytest

from allelix.functions import kmers
from allelix.models import structure
from allelix.operators import assoc, intervals, merge, scores, tables


def test_gains_beyond_64_bits(spark):
    """n times the sum of squares is 4e20 here."""
    y = spark.range(2000).select(F.col("id").alias("sample_id"), (F.lit(10_000_000) * (F.col("id") % 2 * 2 - 1)).alias("y"))
    got = scores.gains(spark.range(1000).select(F.lit(1).alias("site_id"), (F.col("id") * 2 + 1).alias("sample_id")), y, "site_id").collect()[0]
    assert got["n_hit"] == 1000 and got["corr"] == pytest.approx(1.0) and got["mean_diff"] == pytest.approx(2e7)


def test_parents_beyond_the_recursion_limit(spark):
    """A recursive query stops at spark.sql.cteRecursionRowLimit rows, 1,000,000 by default."""
    edges = spark.range(600_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, -1 - F.col("id") % 5).otherwise(F.col("id") - 1).alias("parent"))
    roots = spark.createDataFrame([(-x,) for x in range(1, 6)], "id long")
    got = intervals.resolve_parents(edges, roots)
    assert got.count() == 600_000
    assert {tuple(r) for r in got.filter("id in (29, 31, 299999)").collect()} == {(29, -3), (31, -1), (299999, -3)}


def test_merge_alleles_come_from_listed_sites(spark):
    """The first input lists the site without a call at it; its alleles still are those of the merged site."""
    kind = "site_id long, chrom string, pos int, ref string, alt string"
    sites = [spark.createDataFrame([(1, "1", 5, "A", "G"), (2, "1", 9, "A", "C")], kind), spark.createDataFrame([(1, "1", 5, "G", "A"), (2, "1", 9, "A", "C")], kind)]
    calls = [spark.createDataFrame([(2, 0, 1)], "site_id long, sample_id long, g int"), spark.createDataFrame([(1, 1, 2), (2, 1, 0)], "site_id long, sample_id long, g int")]
    panels = [merge.panel(c, s, i) for i, (c, s) in enumerate(zip(calls, sites))]
    got = merge.merge_panels(panels, [merge.panel_sites(s, i) for i, s in enumerate(sites)])
    assert {tuple(r) for r in got.collect()} == {("1", 5, "A", "G", 1, 1, 0), ("1", 9, "A", "C", 0, 0, 1), ("1", 9, "A", "C", 1, 1, 0)}


def test_pair_popcounts_follow_set_bits(spark):
    """Bits near 10^12: one word each, where words up to the highest bit would not fit."""
    bits = {1: {5, 10**12}, 21: {10**12, 7, 6}, 41: {3}, 99: {1}}
    hits = spark.createDataFrame([(s, b) for s, v in bits.items() for b in v], "site_id long, sample_id long")
    got = kmers.pair_popcounts(kmers.bit_words(hits, "site_id", "sample_id"), "site_id", 20)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 3, 1, 4), (21, 3, 1, 0, 4)}


def test_quantiles_of_slices(spark, monkeypatch):
    rows = [("a", float(x * 7919 % 1000)) for x in range(5000)] + [("b", 3.0)] * 40 + [("c", 1.0), ("c", 2.0)] + [("d", None)] + [(None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    levels = [0.0, 0.005, 0.37, 0.5, 1.0]
    want = df.groupBy("k").agg(*(F.percentile("v", F.lit(q)).alias(f"q{round(q * 1000):03d}") for q in levels))
    tidy = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    for slices in (2, 256):
        monkeypatch.setattr(tables, "SLICES", slices, raising=False)
        for a, b in zip(tidy(tables.quantile_thresholds(df, "k", "v", levels)), tidy(want), strict=True):
            assert a[0] == b[0] and a[1:] == (pytest.approx(b[1:]) if b[1] is not None else b[1:])
    plan = tables.quantile_thresholds(df, "k", "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_sums_of_traits(spark):
    geno = spark.createDataFrame([(s, i, (s + i) % 3 if i % 4 else None) for s in range(4) for i in range(12)], "site_id long, sample_id long, g int")
    pheno = spark.createDataFrame([(i, t, i * 3 % 7 + len(t)) for i in range(12) for t in ("x", "yy") if (i + len(t)) % 5], "sample_id long, trait string, y long")
    columns = ["site_id", "trait", "n", "sg", "sy", "sgg", "syy", "sgy"]
    one, all_at_once = assoc.lm_sums(geno, pheno, ("trait",)), assoc.lm_sums_traits(geno, pheno, "trait", ["x", "yy", "z"])
    assert sorted(map(tuple, one.select(columns).collect())) == sorted(map(tuple, all_at_once.select(columns).collect()))


def test_loglik_keeps_one_row_for_a_call(spark):
    """Shares and frequencies of all k stand in one row, so calls are neither multiplied by k nor grouped again."""
    calls = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (2, 1, None), (2, 2, 1), (3, 1, 1)], "site_id long, sample_id long, g int")
    p = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.6), (2, 0, 0.5), (2, 1, 0.1), (3, 5, 0.3)], "site_id long, k long, p double")
    q = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.9), (2, 1, 0.1)], "sample_id long, k long, q double")
    got = structure.admixture_loglik(calls, p, q)
    want = 2 * math.log(0.6) + 2 * math.log(0.24) + math.log(0.46) + math.log(0.54)
    assert got.collect()[0]["loglik"] == pytest.approx(want)
    assert "sample_id#" not in "".join(x.split("keys=[")[1].split("]")[0] for x in got._jdf.queryExecution().toString().splitlines() if "keys=[site_id" in x)


def test_kmers_are_counted_in_tasks(spark, monkeypatch):
    """Pieces of 16 letters, and texts only after counting: windows are no rows of their own."""
    from collections import Counter

    monkeypatch.setattr(kmers, "LETTERS", 16)
    rows = [("a", "acgtNACGTTGCAACGGTTACGATCGATTTGACCA" * 3), ("b", "ACG"), (None, "TTTTTTÄTTTTTT"), ("a", None), ("b", "")]
    got = kmers.count_kmers(spark.createDataFrame(rows, "s string, r string"), "r", 4, "s")
    want = Counter()
    for s, r in rows:
        for i in range(len(r or "") - 3):
            w = r[i : i + 4].upper()
            if set(w) <= set("ACGT"):
                want[s, min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))] += 1
    assert {(x["s"], x["kmer"]): x["n"] for x in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().toString()
