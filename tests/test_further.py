"""Brute force for the exact rule search, pruning by variants, ridge effects, kernels, the ratio test and readers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.models import mixed, predict
from allelix.operators import ld, more, qc, scores
from allelix.sources import tables as readers


def _mcc(x, y):
    tp, fp, fn, tn = (int(((x == a) & (y == b)).sum()) for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return round((tp * tn - fp * fn) / math.sqrt(den), 9) if den else 0.0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_rules_against_all_rules(spark, seed):
    rng = np.random.default_rng(seed)
    n, sets = 30, {"a": range(0, 7), "b": range(7, 12), "c": range(12, 13)}
    x, y = (rng.random((13, n)) < 0.3).astype(int), rng.integers(0, 2, n)
    hits = spark.createDataFrame([(s, f, k) for s, fs in sets.items() for f in fs for k in range(n) if x[f, k]], "grp string, f long, sample_id long")
    got = {r["grp"]: r for r in scores.best_and_not(hits, spark.createDataFrame([(k, int(y[k])) for k in range(n)], "sample_id long, y int"), "f", "grp").collect()}
    for s, fs in sets.items():
        fs = [f for f in fs if x[f].any()]
        rules = [(1, place, f, -1, text, value) for f in fs for place, text, value in ((0, f"{f}", x[f]), (1, f"!{f}", 1 - x[f]))]
        for i, j in itertools.combinations(fs, 2):
            a, b = x[i], x[j]
            rules += [(2, 0, i, j, f"{i}&{j}", a * b), (2, 1, i, j, f"{i}&!{j}", a * (1 - b)), (2, 2, i, j, f"!{i}&{j}", (1 - a) * b), (2, 3, i, j, f"!{i}&!{j}", (1 - a) * (1 - b))]
        best = min(rules, key=lambda r: (-_mcc(r[5], y), *r[:4]))
        assert (got[s]["rule"], got[s]["depth"]) == (best[4], best[0]) and got[s]["score"] == pytest.approx(_mcc(best[5], y))


def test_beam_grows_to_smaller_ids(spark):
    """The partner of the one rule in the beam may have a smaller id."""
    on = {1: [0, 1, 2, 3, 8, 9], 2: [0, 1, 2, 3, 4, 5]}
    y = spark.createDataFrame([(k, int(k < 4)) for k in range(10)], "sample_id long, y int")
    hits = spark.createDataFrame([(f, k) for f, ks in on.items() for k in ks], "f long, sample_id long")
    got = scores.best_conjunctions(hits, y, "f", 1, 2).collect()
    assert [(r["rule"], r["score"]) for r in got if r["depth"] == 2] == [([1, 2], 1.0)]


@pytest.mark.parametrize("variants,step", [(5, 1), (6, 4), (4, 6), (2, 1)])
def test_prune_by_variants_against_windows(spark, variants, step):
    rng = np.random.default_rng(variants * step)
    n, m = 25, 30
    base = rng.integers(0, 3, (8, n))
    g = np.where(rng.random((m, n)) < 0.15, rng.integers(0, 3, (m, n)), base[rng.integers(0, 8, m)])
    chrom, pos = np.array(["1", "2"])[np.arange(m) % 2], rng.permutation(m) * 10
    geno = spark.createDataFrame([(i, k, int(g[i, k])) for i in range(m) for k in range(n)], "site_id long, sample_id long, g int")
    sites = spark.createDataFrame([(i, chrom[i].item(), int(pos[i])) for i in range(m)], "site_id long, chrom string, pos int")
    rates = qc.site_rates(qc.site_counts(geno))
    maf = {r["site_id"]: r["maf"] for r in rates.collect()}
    want = set()
    for c in "12":
        order = sorted((i for i in range(m) if chrom[i] == c), key=lambda i: pos[i])
        for at in range(0, len(order), step):
            some, changed = order[at : at + variants], True
            while changed:
                changed = False
                for i, j in itertools.combinations(some, 2):
                    if i in want or j in want or g[i].std() == 0 or g[j].std() == 0 or np.corrcoef(g[i], g[j])[0, 1] ** 2 <= 0.5 * (1 + 1e-12):
                        continue
                    want.add(i if maf[i] < (1 - 1e-12) * maf[j] else j)
                    changed = True
    assert {r["site_id"] for r in ld.prune_count(geno, rates, sites, variants, step, 0.5).collect()} == want


def _rows(spark, g):
    return spark.createDataFrame([(j, [float(x) for x in g[:, j]]) for j in range(g.shape[1])], "site_id long, g array<double>")


def _panel(seed, n=50, m=120):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.2, 0.5, m), (n, m)).astype(float)
    a = (g - g.mean(0)) @ rng.normal(size=m)
    return g, a / a.std() + rng.normal(size=n) * 0.7


def test_ridge_effects_without_holding_the_markers(spark):
    g, y = _panel(1)
    rows = _rows(spark, g)
    k = mixed.relationship(rows, len(y))
    got = {r["site_id"]: r["beta"] for r in predict.rrblup_rows(rows, k, y).collect()}
    z = g - g.mean(0)
    p = g.mean(0) / 2
    lam = 10 ** mixed.Spectrum(k, y).log10_lambda * (2 * p * (1 - p)).sum()
    want = np.linalg.solve(z.T @ z + lam * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert [got[j] for j in range(g.shape[1])] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_kernels(spark):
    g, y = _panel(2)
    rows = _rows(spark, g)
    h = {r["site_id"]: r["g"] for r in predict.dominance_rows(rows).collect()}
    assert all(h[j] == list((g[:, j] == 1).astype(float)) for j in h)
    k, fold = mixed.relationship(rows, len(y)), np.arange(len(y)) % 5
    got = predict.kernel_cross_validation({"a": k, "d": mixed.relationship(predict.dominance_rows(rows), len(y))}, y, fold)
    assert list(got["kernel"].unique()) == ["a", "d", "a+d"] and got["n"].sum() == 3 * len(y)
    alone, plain = got[got["kernel"] == "a"], predict.cross_validate(k, y, fold)
    assert alone["mse"].to_numpy() == pytest.approx(plain["mse"].to_numpy(), rel=0.05)


def test_average_information_reaches_its_bounds():
    g, y = _panel(2)
    p = g.mean(0) / 2
    k = (g - 2 * p) @ (g - 2 * p).T / (2 * p * (1 - p)).sum()
    for f in range(5):
        train = np.flatnonzero(np.arange(len(y)) % 5 != f)
        kt = k[np.ix_(train, train)]
        vg, ve = mixed.ai_reml([kt], np.ones((len(train), 1)), y[train])
        want = 1 / (1 + 10 ** mixed.Spectrum(kt, y[train]).log10_lambda)
        assert vg / (vg + ve) == pytest.approx(want, abs=2e-3)


def test_ratio_test_by_its_own_likelihood(spark):
    from allelix.functions.stats import chi2_sf

    g, y = _panel(3)
    rows = _rows(spark, g)
    # Not singular: with a centred matrix the likelihood (not the restricted one) also grows towards lambda = 0.
    spec = mixed.Spectrum(mixed.relationship(rows, len(y)) + 0.1 * np.eye(len(y)), y)
    got = {r["site_id"]: r for r in mixed.scan(rows.filter("site_id < 6"), spec, "lmm2").collect()}
    grid = np.linspace(-5, 5, 2001)
    null = max(mixed.profile(t, spec.s, spec.x, spec.y, False)[0] for t in grid)
    for j in range(6):
        x = np.column_stack([spec.x, spec.u.T @ g[:, j]])
        full = max(mixed.profile(t, spec.s, x, spec.y, False)[0] for t in grid)
        assert got[j]["plrt"] == pytest.approx(float(chi2_sf(max(0.0, 2 * (full - null)), 1)), rel=2e-2, abs=1e-3)


def test_lead_r2_reaches_both_sides(spark):
    g = np.array([[0, 1, 2, 1, 0], [0, 1, 2, 1, 1], [2, 1, 0, 0, 1], [0, 0, 1, 2, 2]])
    geno = spark.createDataFrame([(i, k, int(g[i, k])) for i in range(4) for k in range(5)], "site_id long, sample_id long, g int")
    sites = spark.createDataFrame([(0, "1", 100), (1, "1", 199), (2, "1", 1), (3, "1", 201)], "site_id long, chrom string, pos int")
    got = {r["site_id"]: r["r2"] for r in more.lead_r2(geno, sites, sites.filter("site_id = 0"), 100).collect()}
    assert set(got) == {0, 1, 2} and got[1] == pytest.approx(np.corrcoef(g[0], g[1])[0, 1] ** 2)


def test_sparse_matrix_and_covariate_files(spark, tmp_path):
    (tmp_path / "k.sp").write_text("0 0 1.5\n1 0 0.25\n2\t2\t0.9\nbad line\n")
    (tmp_path / "k.id").write_text("f a\nf b\nf c\n")
    got = readers.read_sparse_grm(spark, str(tmp_path / "k.sp"), str(tmp_path / "k.id")).collect()
    assert sorted((r["i"], r["j"], r["k"]) for r in got) == [("a", "a", 1.5), ("a", "b", 0.25), ("c", "c", 0.9)]
    (tmp_path / "c.txt").write_text("id\tage\tpc.1\na\t3\t0.5\nb\tNA\t1\na\t5\t1.5\n")
    assert [tuple(r) for r in readers.read_covariates(spark, str(tmp_path / "c.txt")).collect()] == [("a", 4.0, 1.0)]


def test_searches_side_by_side_are_those_of_each_function():
    from allelix.functions.stats import golden_min, golden_min_many

    rng = np.random.default_rng(4)
    at, k = rng.uniform(-6, 6, 200), rng.uniform(0.1, 3, 200)
    one = lambda a, b: lambda t: b * (t - a) ** 2 + math.sin(3 * t) * 0.3 + abs(t - a)
    got = golden_min_many(lambda i, t: k[i] * (t - at[i]) ** 2 + np.sin(3 * t) * 0.3 + np.abs(t - at[i]), 200, -5, 5, 1e-6)
    assert got == pytest.approx([golden_min(one(a, b), -5, 5, 1e-6) for a, b in zip(at, k)], abs=1e-5)
    assert len(golden_min_many(lambda i, t: t, 0, -5, 5)) == 0


def test_blocks_of_sites_fit_like_single_sites(spark, monkeypatch):
    monkeypatch.setattr(mixed, "SITES", 7)
    g, y = _panel(5)
    c = np.random.default_rng(5).normal(size=(len(y), 2))
    rows = _rows(spark, g)
    spec = mixed.Spectrum(mixed.relationship(rows, len(y)), y, c)
    got = {r["site_id"]: r for r in mixed.scan(rows.filter("site_id < 20"), spec, "lmm").collect()}
    for j in range(20):
        x = np.column_stack([spec.x, spec.u.T @ g[:, j]])
        t = mixed.fit_lambda(spec.s, x, spec.y)
        _, b, cov, _ = mixed.profile(t, spec.s, x, spec.y)
        assert got[j]["log10_lambda"] == pytest.approx(t, abs=2e-3)
        assert (got[j]["beta"], got[j]["se"]) == pytest.approx((b[-1], math.sqrt(cov[-1, -1])), rel=1e-4)
