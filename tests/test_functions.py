"""Hand-checked cases and brute force for functions, operators, readers, writers and models."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelix.functions import kmers, stats
from allelix.models import farmcpu, mixed, predict, simulate, structure
from allelix.operators import assoc, intervals, ld, merge, qc, tables, windows
from allelix.sources import genotypes, tables as readers, writers


def test_tails():
    assert stats.student_p([0.0, 2.228138852], [10, 10]) == pytest.approx([1.0, 0.05], rel=1e-7)
    assert stats.student_p([1.0], [1]) == pytest.approx([0.5]) and np.isnan(stats.student_p([1.0], [0]))[0]
    assert stats.student_p([1e4], [50])[0] > 0
    assert stats.chi2_sf([3.841458821, 5.991464547, 0.0], [1, 2, 3]) == pytest.approx([0.05, 0.05, 1.0], rel=1e-7)
    x = np.linspace(0.1, 40, 50)
    assert stats.chi2_sf(x, 2) == pytest.approx(np.exp(-x / 2), rel=1e-9)
    assert stats.normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert stats.golden_min(lambda t: (t - 1.25) ** 2 + 3, -5, 5) == pytest.approx(1.25, abs=1e-6)


def test_flip_and_impute(spark):
    g = spark.createDataFrame([(1, k, v) for k, v in enumerate([2, 2, 1, 0, None])], "site_id long, sample_id long, g int")
    rates = qc.site_rates(qc.site_counts(g))
    flipped = qc.flip_minor(g, rates)
    out = [r["g"] for r in qc.impute_mean(flipped.select("site_id", "sample_id", "g")).orderBy("sample_id").collect()]
    assert out == [0, 0, 1, 2, 0.75]
    assert [r["g"] for r in qc.impute_mean(g).orderBy("sample_id").collect()] == [2, 2, 1, 0, 1.25]


def test_verdicts(spark):
    rows = [("missing", [None, None, 1, 1]), ("all_missing", [None] * 4), ("het", [1, 1, 1, 0]), ("maf", [0, 0, 0, 0]), ("kept", [0, 1, 2, 0])]
    g = spark.createDataFrame([(i, k, v) for i, (_, vs) in enumerate(rows) for k, v in enumerate(vs)], "site_id long, sample_id long, g int")
    r = qc.site_rates(qc.site_counts(g))
    strict = {x["site_id"]: x["verdict"] for x in qc.qc_verdict(r, 0.05, 0.3, 0.5).collect()}
    assert [strict[i] or "kept" for i in range(5)] == ["missing", "missing", "het", "maf", "kept"]
    loose = {x["site_id"]: x["verdict"] for x in qc.qc_verdict(r, 0.05, 1.0, 1.0).collect()}
    assert loose[1] == "all_missing" and loose[2] is None
    assert qc.qc_verdict(r, 0.0, 1.0).filter("site_id = 1").collect()[0]["verdict"] is None
    assert qc.site_counts(g.limit(0)).collect() == []


def test_selectors():
    assert qc.expand_selector("1-3, X,2") == ["1", "2", "3", "X"]
    assert readers.parse_range("chr1:1.5-2") == ("1", 1_500_000, 2_000_000) and readers.parse_range("2:1234567-1000000") == ("2", 1000000, 1234567)
    assert readers.parse_window("50") == ("variants", 50) and readers.parse_window("50", "kb") == ("bp", 50_000) and readers.parse_window("2cM") == ("cm", 2)
    with pytest.raises(ValueError):
        readers.parse_range("nonsense")


def test_king_pair_and_prune(spark):
    rows = [(s, k, g) for k, gs in enumerate([[0, 1, 2, 0], [2, 1, 0, 1]]) for s, g in enumerate(gs)]
    r = ld.king(spark.createDataFrame(rows, "site_id long, sample_id long, g int")).collect()[0]
    assert (r["shared"], r["ibs0"], r["ibs1"], r["ibs2"], r["het_i"], r["het_j"], r["both_het"], r["kinship"]) == (4, 2, 1, 1, 1, 2, 1, -1.0)
    assert ld.unrelated([(0, 1), (0, 2), (2, 3)]) == [2, 1]


def test_interval_joins_match_brute_force(spark):
    rng = np.random.default_rng(0)
    a = [(str(rng.integers(3)), int(s), int(s + rng.integers(0, 30_000)), i) for i, s in enumerate(rng.integers(0, 90_000, 60))]
    b = [(str(rng.integers(3)), int(s), int(s + rng.integers(0, 500)), i) for i, s in enumerate(rng.integers(0, 90_000, 80))]
    da, db = spark.createDataFrame(a, "chrom string, a_start long, a_stop long, a long"), spark.createDataFrame(b, "chrom string, b_start long, b_stop long, b long")
    got = sorted((r["a"], r["b"]) for r in intervals.overlaps(da, db, size=7000).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and y[1] <= x[2] and y[2] >= x[1])


def test_annotation_labels(spark):
    f = [(0, "1", 100, 200, "GeneA", "gene", "+"), (1, "1", 120, 150, "GeneA", "CDS", "+"), (2, "1", 100, 180, "GeneA", "exon", "+"), (3, "1", 300, 360, "GeneB", "gene", "-"), (4, "1", 320, 340, "GeneB", "CDS", "-")]
    feats = spark.createDataFrame(f, "feature_id long, chrom string, start int, stop int, gene string, feature string, strand string")
    sites = spark.createDataFrame([(1, "1", 130), (2, "1", 250), (3, "1", 190), (4, "1", 90_000), (5, "2", 130), (6, "1", 99)], "site_id long, chrom string, pos int")
    got = {r["site_id"]: r["annotation"] for r in intervals.annotate(sites, feats).collect()}
    assert got == {1: "CDS;GeneA;+", 2: "Downstream2kb;GeneA;+ | Downstream2kb;GeneB;-", 3: "Intron;GeneA;+", 4: "Intergenic;NA;NA", 5: "Intergenic;NA;NA", 6: "Upstream2kb;GeneA;+ | Downstream2kb;GeneB;-"}
    wide = {r["site_id"]: r["genes"] for r in intervals.broaden(sites, feats, 80).collect()}
    assert wide[2] == "GeneA,GeneB"


def test_merge_maps(spark):
    maps = {("A", "C", "A", "C"): "identity", ("A", "C", "C", "A"): "swap", ("A", "C", "T", "G"): "strand", ("A", "C", "G", "T"): "strand_swap", ("A", "T", "T", "A"): "swap", ("A", "C", "A", "G"): None}
    df = spark.createDataFrame([(*k, v) for k, v in maps.items()], "ref string, alt string, r string, a string, want string")
    assert all(r["m"] == r["want"] for r in df.withColumn("m", merge.allele_map(F.col("ref"), F.col("alt"), F.col("r"), F.col("a"))).collect())


def test_ranks_over_ties_and_blocks(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(0.001, 1, 500), 2)
    hits = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "site_id long, p double")
    got = {r["site_id"]: r["rank"] for r in windows.global_rank(hits, "p", "site_id", buckets=7).collect()}
    order = np.lexsort((np.arange(500), p))
    assert [got[i] for i in order] == list(range(1, 501))
    holm = {r["site_id"]: r["p_holm"] for r in windows.holm(hits).collect()}
    want = np.minimum(np.maximum.accumulate((500 - np.arange(500)) * p[order]), 1)
    assert [holm[i] for i in order] == pytest.approx(want)


def test_prune_and_clump(spark):
    pairs = pd.DataFrame({"chrom": "1", "i": [1, 2, 3], "j": [2, 3, 4], "r2": [0.9, 0.95, 0.2], "maf_i": [0.3, 0.1, 0.1], "maf_j": [0.1, 0.1, 0.4], "pos_i": [1, 2, 3], "pos_j": [2, 3, 4]})
    assert ld._prune_chrom(0.8)(pairs)["site_id"].tolist() == [2]
    hits = pd.DataFrame({"chrom": "1", "site_id": [1, 2, 3, 4], "pos": [1, 2, 3, 4], "p": [0.01, 0.001, 0.02, 0.03]})
    got = ld._clump_chrom(0.8)(hits, pairs[["chrom", "i", "j", "r2"]])
    assert got["site_id"].tolist() == [2, 4] and got["members"].tolist() == ["1;2;3", "4"] and got["mean_r2"][0] == pytest.approx(0.925)


def test_kmer_groups(spark):
    sets = spark.createDataFrame([("A", ["b"]), ("C", ["a"]), ("G", ["a"]), ("T", ["b"]), ("AA", ["b"])], "kmer string, samples array<string>")
    r = kmers.pair_table(sets).collect()[0]
    assert (r["unique_a"], r["unique_b"], r["both"], r["union"], r["jaccard"]) == (2, 3, 0, 5, 0.0)
    assert {x["pattern"]: x["n"] for x in kmers.group_patterns(sets, {"A": ["a"], "B": ["b"]}).collect()} == {"10": 2, "01": 3}
    reads = spark.createDataFrame([("ACGTNACG",), (None,), ("",)], "s string")
    assert {x["kmer"]: x["n"] for x in kmers.count_kmers(reads, "s", 3).collect()} == {"ACG": 3}


def test_linear_scan_against_numpy(spark):
    rng = np.random.default_rng(2)
    n, m = 40, 6
    g, y, c = rng.integers(0, 3, (m, n)), rng.normal(size=n), rng.normal(size=n)
    geno = spark.createDataFrame([(i, k, int(g[i, k])) for i in range(m) for k in range(n)], "site_id long, sample_id long, g int")
    pheno = spark.createDataFrame([(k, float(y[k]), float(c[k])) for k in range(n)], "sample_id long, y double, c double")
    got = {r["site_id"]: r for r in assoc.lm_covariates(geno, pheno, ("c",)).collect()}
    simple = {r["site_id"]: r for r in assoc.lm_estimates(assoc.lm_sums(geno, pheno)).collect()}
    for i in range(m):
        for cols, r, beta in (((np.ones(n), c, g[i]), got[i], None), ((np.ones(n), g[i]), simple[i], None)):
            x = np.column_stack(cols).astype(float)
            b, *_ = np.linalg.lstsq(x, y, rcond=None)
            s2 = ((y - x @ b) ** 2).sum() / (n - x.shape[1])
            assert r["beta"] == pytest.approx(b[-1]) and r["se"] == pytest.approx(math.sqrt(s2 * np.linalg.inv(x.T @ x)[-1, -1]))


def _panel(seed=0, n=60, m=300, h=0.7):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.1, 0.5, m), (n, m)).astype(float)
    b = rng.normal(size=m) * (rng.random(m) < 0.2)
    a = (g - g.mean(0)) @ b
    return g, (a - a.mean()) / a.std() * math.sqrt(h) + rng.normal(size=n) * math.sqrt(1 - h)


def test_mixed_models(spark):
    g, y = _panel()
    rows = spark.createDataFrame([(j, [float(x) for x in g[:, j]]) for j in range(40)], "site_id long, g array<double>")
    every = spark.createDataFrame([(j, [float(x) for x in g[:, j]]) for j in range(g.shape[1])], "site_id long, g array<double>")
    k = mixed.relationship(every, len(y))
    p = g.mean(0) / 2
    z = g - 2 * p
    assert np.allclose(k, z @ z.T / (2 * p * (1 - p)).sum())
    spec = mixed.Spectrum(k, y)
    grid = np.linspace(mixed.LOW, mixed.HIGH, 400)
    best = max(grid, key=lambda t: mixed.profile(t, spec.s, spec.x, spec.y)[0])
    assert spec.log10_lambda == pytest.approx(best, abs=0.05)
    fixed = {r["site_id"]: r for r in mixed.scan(rows, spec, "fvlmm").collect()}
    v = k + 10**spec.log10_lambda * np.eye(len(y))
    for j in (0, 5, 17):
        x = np.column_stack([np.ones(len(y)), g[:, j]])
        b = np.linalg.solve(x.T @ np.linalg.solve(v, x), x.T @ np.linalg.solve(v, y))
        assert fixed[j]["beta"] == pytest.approx(b[1], rel=1e-3)
    exact = mixed.scan(rows.limit(5), spec, "lmm2").collect()
    assert all(0 < r["p"] <= 1 and 0 < r["plrt"] <= 1 for r in exact)
    assert len(mixed.ai_reml([k], np.ones((len(y), 1)), y)) == 2 and len(mixed.haseman_elston(k, y)) == 2


def test_prediction():
    g, y = _panel(1, 120, 200, 0.8)
    z = g - g.mean(0)
    k = z @ z.T / z.shape[1]
    train, test = np.arange(90), np.arange(90, 120)
    pred, alpha, mu = predict.gblup(k, y, train, test)
    assert np.corrcoef(pred, y[test])[0, 1] > 0.2
    b, _ = predict.rrblup(g[:90], y[:90])
    assert np.corrcoef(g[90:] @ b, y[90:])[0, 1] > 0.2
    lam = 50.0
    direct = np.linalg.solve((g - g.mean(0)).T @ (g - g.mean(0)) + lam * np.eye(200), (g - g.mean(0)).T @ (y - y.mean()))
    assert predict.ridge_pcg(g, y, lam) == pytest.approx(direct, abs=1e-5)
    for m in ("A", "B", "Cpi"):
        out = predict.bayes(g[:90], y[:90], m, 80, 30)
        assert np.corrcoef((g[90:] - g[:90].mean(0)) @ out["beta"], y[90:])[0, 1] > 0.1 and (out["pip"] <= 1).all()
    assert len(predict.cross_validate(k, y, np.arange(120) % 5)) == 5


def test_structure(spark):
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    tree = structure.neighbour_joining(d, list("abcde"))
    assert "a:2.000000" in tree and "b:3.000000" in tree and tree.endswith(";")
    assert structure.neighbour_joining(np.zeros((1, 1)), ["x"]) == "x;"
    u, share = structure.principal_components(np.diag([3.0, 2.0, 1.0]), 2)
    assert np.allclose(u[:, 0], [1, 0, 0]) and share == pytest.approx([0.5, 1 / 3])
    assert structure.average_linkage(np.array([[0, 1, 9], [1, 0, 9], [9, 9, 0]], float), 3).tolist() == [0, 0, 1]
    rng = np.random.default_rng(0)
    f = np.array([[0.9] * 80 + [0.1] * 80, [0.1] * 80 + [0.9] * 80])
    g = rng.binomial(2, np.repeat(f, 15, 0)).astype(float)
    rows = spark.createDataFrame([(j, [float(x) for x in g[:, j]]) for j in range(160)], "site_id long, g array<double>")
    q, ll = structure.admixture_em(rows, 30, 2, steps=25)
    a = q[:, 0] > 0.5
    assert np.isfinite(ll) and (a[:15] == a[0]).all() and (a[15:] != a[0]).all()


def test_farmcpu_finds_a_strong_site(spark):
    g, _ = _panel(3, 150, 60)
    rng = np.random.default_rng(1)
    y = 1.5 * g[:, 20] + rng.normal(size=150)
    rows = spark.createDataFrame([(j, [float(x) for x in g[:, j]]) for j in range(60)], "site_id long, g array<double>")
    sites = spark.createDataFrame([(j, "1", j * 1000) for j in range(60)], "site_id long, chrom string, pos long")
    _, chosen = farmcpu.farmcpu(rows, sites, y, (5000, 20000), (2, 5), max_iter=4)
    assert 20 in chosen


def test_simulation_is_the_same_on_any_partitioning(spark):
    s, i = spark.range(50).withColumnRenamed("id", "site_id"), spark.range(40).withColumnRenamed("id", "sample_id")
    a = sorted(map(tuple, simulate.genotypes(s, i).collect()))
    b = sorted(map(tuple, simulate.genotypes(s.repartition(7), i.repartition(3)).collect()))
    assert a == b and {x[2] for x in a} == {0, 1, 2}


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
1\t10\t.\tA\tG\t.\tPASS\t.\tGT:DP\t0/0:3\t0|1:2\t./.:0
chr2\t20\trs7\tC\tT\t.\tPASS\t.\tDP:GT\t1:1/1\t2:1|0\t3:2/1
2\t30\trs8\tC\tT\t.\tPASS\t.\tDP\t1\t2\t3
"""


@pytest.mark.parametrize("name", ["a.vcf", "a.vcf.gz"])
def test_vcf(spark, tmp_path, name):
    (tmp_path / name).write_bytes(gzip.compress(VCF.encode()) if name.endswith("gz") else VCF.encode())
    sites, calls = genotypes.read_vcf(spark, str(tmp_path / name))
    assert [tuple(r) for r in sites.orderBy("pos").collect()] == [("1", 10, "1_10", "A", "G"), ("chr2", 20, "rs7", "C", "T")]
    assert [(r["iid"], r["g"]) for r in calls.orderBy("pos", "sample_idx").collect()] == [("s1", 0), ("s2", 1), ("s3", None), ("s1", 2), ("s2", 1), ("s3", None)]


def test_hapmap(spark, tmp_path):
    head = "rs#\talleles\tchrom\tpos\tstrand\tassembly#\tcenter\tprotLSID\tassayLSID\tpanel\tQCcode\tx\ty\tz\tw"
    (tmp_path / "a.hmp").write_text(head + "\nr1\tA/G\t1\t5\t+" + "\tNA" * 6 + "\tAA\tR\tG/G\tNN\n")
    sites, calls = genotypes.read_hapmap(spark, str(tmp_path / "a.hmp"))
    assert sites.collect()[0]["alt"] == "G" and [r["g"] for r in calls.orderBy("sample_idx").collect()] == [0, 1, 2, None]


def test_plink_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    g = rng.integers(0, 4, (9, 6))
    calls = spark.createDataFrame([(i, k, None if g[i, k] == 3 else int(g[i, k])) for i in range(9) for k in range(6)], "site_id long, sample_id long, g int")
    (tmp_path / "x.bed").write_bytes(writers.bed_bytes(writers.pack_bed(calls, 6)))
    (tmp_path / "x.bim").write_text("".join(f"1 rs{i} 0.5 {100 + i} A C\n" for i in range(9)))
    (tmp_path / "x.fam").write_text("".join(f"F{k} I{k} 0 0 1 -9\n" for k in range(6)))
    sites, samples, back = genotypes.read_plink(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, calls.collect()), key=repr)
    assert [r["iid"] for r in samples.orderBy("sample_id").collect()] == [f"I{k}" for k in range(6)] and sites.filter("pos = 104").collect()[0]["snp"] == "rs4"
    (tmp_path / "bad.bed").write_bytes(b"xxx")
    with pytest.raises(Exception, match="SNP-major"):
        genotypes.read_bed(spark, str(tmp_path / "bad.bed"), 6).collect()


def test_vcf_and_hapmap_writers(spark, tmp_path):
    sites = spark.createDataFrame([(0, "1", 10, "rs0", "A", "G"), (1, "1", 5, "rs1", "C", "T")], "site_id long, chrom string, pos int, snp string, ref string, alt string")
    calls = spark.createDataFrame([(0, 0, 2), (0, 1, None), (1, 1, 1)], "site_id long, sample_id long, g int")
    writers.write_vcf(sites, calls, ["a", "b"], str(tmp_path / "v"))
    _, back = genotypes.read_vcf(spark, str(tmp_path / "v"))
    assert [(r["pos"], r["iid"], r["g"]) for r in back.orderBy("pos", "sample_idx").collect()] == [(5, "a", None), (5, "b", 1), (10, "a", 2), (10, "b", None)]
    assert "rs0\tA/G\t1\t10\t+\tNA\tNA\tNA\tNA\tNA\tNA\tGG\tNN" in [r["value"] for r in writers.hapmap_rows(sites, calls, 2).collect()]
    scan = spark.createDataFrame([("1", 10, "rs0", "A", "G", 0.25, 0.0, 1.5, None, 4.0, 1.2e-5)], "chrom string, pos int, snp string, allele0 string, allele1 string, af double, miss double, beta double, se double, chisq double, pwald double")
    assert writers.association_rows(scan).collect()[0]["value"] == "1\t10\trs0\tA\tG\t0.2500\t0.0000\t1.5000\tnan\t4.0000\t1.2000e-05"


GFF = "##gff\nchr1\tx\tgene\t100\t200\t.\t+\t.\tID=gene:GeneA;Name=A;description=Alpha%20kinase+x\nchr1\tx\tmRNA\t100\t200\t.\t+\t.\tID=t1;Parent=gene:GeneA\nchr1\tx\tCDS\t120\t150\t.\t+\t0\tID=c1;Parent=t1,t2\nchr1\tx\tCDS\tx\t150\t.\t+\t0\tID=c2\nchr1 x gene 300 360 . - . ID=GeneB\n"


def test_annotation_readers(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF)
    g = readers.read_gff(spark, str(tmp_path / "a.gff"))
    assert g.count() == 4
    assert sorted(tuple(r) for r in readers.gff_genes(g).collect()) == [("1", 100, 200, "GeneA", "+", "Alpha kinase+x"), ("1", 300, 360, "GeneB", "-", "NA")]
    up = intervals.resolve_parents(readers.gff_parents(g), g.filter("feature = 'gene'").select(readers.attribute(F.col("attributes"), "ID").alias("id")))
    assert {tuple(r) for r in up.collect()} == {("t1", "gene:GeneA"), ("c1", "gene:GeneA")}
    (tmp_path / "b.bed").write_text("chrom,start,end\n1,50,20,g1\n2,5,9,g2,d\n")
    assert [tuple(r) for r in readers.read_bed_table(spark, str(tmp_path / "b.bed")).orderBy("chrom").collect()] == [("1", 20, 50, "g1", "NA", "NA"), ("2", 5, 9, "g2", "d", "NA")]


def test_table_readers(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("CHR\tBP\tSNP\tpwald\n1\t100\ta\t0.5\n1\tx\tb\t0.1\n1\t200\tc\tnan\n1\t300\td\t0\n2\t4e2\te\t1\n")
    assert [(r["chrom"], r["pos"], r["p"], r["SNP"]) for r in readers.read_gwas(spark, str(tmp_path / "g.tsv")).orderBy("pos").collect()] == [("1", 100, 0.5, "a"), ("2", 400, 1.0, "e")]
    (tmp_path / "w.txt").write_text("chrom pos p\n1 5 0.2\n")
    assert readers.read_gwas(spark, str(tmp_path / "w.txt")).count() == 1
    with pytest.raises(ValueError):
        readers.read_gwas(spark, str(tmp_path / "w.txt"), "absent")
    (tmp_path / "p.tsv").write_text("id\tt0\tt1\nb\t1\tNA\na\t2\t5\nb\t3\t7\n")
    assert [tuple(r) for r in readers.read_phenotypes(spark, str(tmp_path / "p.tsv")).orderBy("first_seen").collect()] == [("b", 0 + 1, 2.0, 7.0), ("a", 2, 2.0, 5.0)]
    (tmp_path / "b.tsv").write_text("CHROM\tPOS\tx.DP\tx.AD\tx.GQ\ty.DP\ty.AD\ty.GQ\nchr01\t5\t10\t4,6\t50\t\t1,2\t\nNA\t6\t1\t1\t1\t1\t1\t1\n")
    assert [tuple(r) for r in readers.read_bsa(spark, str(tmp_path / "b.tsv"), ("x", "y")).collect()] == [("1", 5, 10, 6, 50.0, 0, 2, 0.0)]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    assert [r["x"] for r in genotypes.read_npy(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "n.txt").write_text("0\t1\t-9\n2\t2\t1\n")
    (tmp_path / "n.id").write_text("a\nb\nc\n")
    samples, calls = genotypes.read_matrix(spark, str(tmp_path / "n"))
    assert samples.count() == 3 and [r["g"] for r in calls.orderBy("site_id", "sample_id").collect()] == [0, 1, None, 2, 2, 1]
    (tmp_path / "k.txt").write_text("1.0 0.2\n0.2 0.9\n")
    (tmp_path / "k.id").write_text("a\nb\n")
    assert sorted(map(tuple, readers.read_grm(spark, str(tmp_path / "k.txt"), str(tmp_path / "k.id")).collect())) == [("a", "a", 1.0), ("a", "b", 0.2), ("b", "b", 0.9)]
    (tmp_path / "r.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGGGN\n+\nIIII\n")
    assert [tuple(r) for r in genotypes.read_fastq(spark, str(tmp_path / "r.fastq")).collect()] == [("r1", "ACGT"), ("r2", "GGGN")]


def test_registry_and_wilson(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, v int, t string")
    assert sorted(map(tuple, tables.upsert(old, new, "k", "v", "t").collect())) == [("a", 2, "z"), ("b", 1, "y")]
    low, high = tables.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).collect()[0]) == (0.0, 0.0)


def test_streaming_upsert_and_windows(spark, tmp_path):
    from allelix.streaming import events

    rows = [(k, k % 3, k) for k in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "event_id long, user_id long, v long").write.parquet(str(tmp_path / f"in/{part}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    q = stream.writeStream.foreachBatch(events.upsert_into(str(tmp_path / "out"), "user_id", "event_id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / f"out/{last}")).collect()) == [27, 28, 29]


def test_further_models(spark):
    from allelix.models import extra

    g, y = _panel(2, 80, 120)
    z = g - g.mean(0)
    k = z @ z.T / z.shape[1]
    full, thin = mixed.Spectrum(k, y), extra.low_rank(z, y)
    assert thin.log10_lambda == pytest.approx(full.log10_lambda, abs=1e-2) and np.allclose(np.sort(thin.s), np.sort(full.s), atol=1e-8)
    rows = spark.createDataFrame([(j, [float(x) for x in g[:, j]]) for j in range(30)], "site_id long, g array<double>")
    dense = {r["site_id"]: r["p"] for r in mixed.scan(rows, full, "fvlmm").collect()}
    sparse = {r["site_id"]: r["p"] for r in extra.sparse_scan(rows, k, y, -10.0, 30).collect()}
    a, b = np.log([dense[j] for j in range(30)]), np.log([sparse[j] for j in range(30)])
    assert np.corrcoef(a, b)[0, 1] > 0.95
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(50, 5)))[0] * math.sqrt(50)
    t = np.random.default_rng(1).normal(size=50)
    want = np.sign(q.T @ t / 50) * np.maximum(np.abs(q.T @ t / 50) - 0.05, 0)
    assert extra.lasso_path(q, t, np.array([0.05]))[0] == pytest.approx(want, abs=1e-6)
    assert 7 in extra.adaptive_lasso(g, 2 * g[:, 7] + np.random.default_rng(5).normal(size=80))
    assert extra.studentised_range_sf(3.877676, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert extra.tukey_letters(["a", "b", "c"], [1.0, 1.1, 9.0], [10, 10, 10], 1.0, 27) == {"a": "b", "b": "b", "c": "a"}
    sites = spark.createDataFrame([(j, "1", j * 1000) for j in range(30)], "site_id long, chrom string, pos long")
    got = {r["site_id"]: r["beta"] for r in extra.context_scan(rows, sites, y, {5: ("1", 5000), 20: ("1", 20000)}, 1500).collect()}
    x = np.column_stack([np.ones(80), g[:, 20], g[:, 6]])
    assert got[6] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0][-1]) and len(got) == 30


def test_analysis_objects(spark):
    from allelix.api import Association, Prediction

    g, y = _panel(4, 40, 30)
    geno = spark.createDataFrame([(j, i, int(g[i, j])) for i in range(40) for j in range(30)], "site_id long, sample_id long, g int")
    pheno = spark.createDataFrame([(i, float(y[i])) for i in range(40)], "sample_id long, y double")
    sites = spark.createDataFrame([(j, "1", j * 1000) for j in range(30)], "site_id long, chrom string, pos long")
    for model in ("lm", "fvlmm", "farmcpu"):
        assert Association(geno, pheno, sites).scan(model).count() == 30
    p = Prediction(geno, pheno).fit()
    assert len(p.cross_validate(4)) == 4 and p.components(3)[0].shape == (40, 3)


def test_bit_files(spark, tmp_path):
    from allelix.sources import bits

    rows = spark.createDataFrame([(0, [0, 9]), (1, []), (2, [3, 4, 10])], "row long, samples array<long>")
    (tmp_path / "m.bin").write_bytes(bits.bit_matrix_bytes(rows, 11))
    assert sorted((r["row"], r["samples"]) for r in bits.read_bit_matrix(spark, str(tmp_path / "m.bin"), 2).collect()) == [(0, [0, 9]), (1, []), (2, [3, 4, 10])]
    (tmp_path / "s.site").write_bytes(bits.kmer_sites_bytes(["ACGTT", "GGA", "CATG"]))
    assert [r["kmer"] for r in bits.read_kmer_sites(spark, str(tmp_path / "s.site")).orderBy("row").collect()] == ["ACGTT", "GGA", "CATG"]
    sets = spark.createDataFrame([(27, [1]), (5, [0, 2])], "code long, samples array<long>")
    a, b = bits.kmer_matrix_bytes(sets, 5, 3)
    assert len(a) == 64 + 16 and len(b) == 80 + 2
    (tmp_path / "k").write_bytes(a)
    (tmp_path / "p").write_bytes(b)
    assert sorted((r["code"], r["samples"]) for r in bits.read_kmer_matrix(spark, str(tmp_path / "k"), str(tmp_path / "p")).collect()) == [(5, [0, 2]), (27, [1])]
    with pytest.raises(Exception, match="not a bit matrix"):
        bits.read_bit_matrix(spark, str(tmp_path / "k")).collect()


def test_trees_and_support_vectors():
    from allelix.models import learners, trees

    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    t = trees.bionj(d, list("abcde"))
    got = {n.name: n.length for n in t.walk() if n.name}
    assert got["a"] == pytest.approx(2) and got["b"] == pytest.approx(3) and got["e"] == pytest.approx(1)
    rng = np.random.default_rng(0)
    mutate = lambda s, p: "".join(rng.choice(list("ACGT")) if rng.random() < p else c for c in s)
    root = "".join(rng.choice(list("ACGT"), 300))
    x, y = mutate(root, 0.25), mutate(root, 0.25)
    seqs = {"a": mutate(x, 0.05), "b": mutate(x, 0.05), "c": mutate(y, 0.05), "d": mutate(y, 0.05), "e": mutate(y, 0.3) + ""}
    seqs["e"] = seqs["e"][:299] + "N"
    tree, ll = trees.maximum_likelihood(seqs, 2)
    assert np.isfinite(ll) and sorted(n.name for n in tree.walk() if n.name) == list("abcde")
    pairs = [sorted(c.name for c in n.children if c.name) for n in tree.walk() if n.children]
    assert ["a", "b"] in pairs or ["c", "d", "e"] in pairs
    g, p = _panel(8, 80, 100, 0.9)
    z = (g - g.mean(0)) / 10
    k = z @ z.T
    b = learners.support_vector_regression(k[:60, :60], p[:60] - p[:60].mean(), 1.0, 0.1)
    assert (np.abs(b) <= 1).all() and np.corrcoef(k[60:, :60] @ b, p[60:])[0, 1] > 0.2


def test_windows_cross_blocks(spark):
    rng = np.random.default_rng(6)
    pos = np.sort(rng.integers(0, 5000, 300))
    rows = [(i, "1", int(x), float(i % 17)) for i, x in enumerate(pos)]
    df = spark.createDataFrame(rows, "site_id long, chrom string, pos int, p double")
    from pyspark.sql import Window

    halo = windows.with_halo(df, 120, 500)
    n = halo.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chrom", "_block").orderBy("pos").rangeBetween(-120, 120))).filter("_own")
    assert {r["site_id"]: r["n"] for r in n.collect()} == {i: int((np.abs(pos - x) <= 120).sum()) for i, x in enumerate(pos)}


def test_streams_of_events_and_calls(spark, tmp_path):
    import datetime as dt

    from allelix.streaming import events

    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(minutes=10 * (k // 2)), "ab"[k % 2], 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, value double")
    df.unionByName(df.limit(5)).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = events.read(spark, str(tmp_path / "e"), df.schema)

    def drain(out, mode, name):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    once = events.distinct_events(stream, "ts", "event_id", "1 day")
    assert sorted(r["event_id"] for r in drain(once, "append", "once")) == list(range(40))
    got = drain(events.windowed_counts(stream, "ts", "kind", "1 hour", "10 minutes"), "complete", "windows")
    assert sum(r["n"] for r in got) == 45 and {r["start"].minute for r in got} == {0}
    calls = spark.createDataFrame([(1, 0, 2), (1, 1, None), (2, 0, 1)], "site_id long, sample_id long, g int")
    calls.coalesce(1).write.parquet(str(tmp_path / "g"))
    got = drain(events.site_rates(events.read(spark, str(tmp_path / "g"), calls.schema)), "complete", "rates")
    assert sorted(map(tuple, got)) == [(1, 2, 1, 2), (2, 1, 0, 1)]
