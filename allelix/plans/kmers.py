"""Queries: k-mers of texts read as bases, presence patterns, bit words, feature scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kmers
from ..operators import scores
from .registry import query
from .views import table, view

K = 5
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
COUNTS = f"""w AS (SELECT source, unnest(regexp_split_to_array(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]+')) AS s FROM documents),
x AS (SELECT source, s[i:i + {K - 1}] AS m FROM (SELECT source, s, unnest(range(1, len(s) - {K - 2})) AS i FROM w WHERE len(s) >= {K})),
c AS (SELECT source, least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM x GROUP BY 1, 2),
p AS (SELECT kmer, list_sort(list(DISTINCT source)) AS samples FROM c WHERE n >= 4 GROUP BY kmer)"""


def _counts(spark, d):
    seq = F.translate(F.lower("text"), LETTERS, BASES)
    return kmers.count_kmers(table(spark, d, "documents").select("source", seq.alias("seq")), "seq", K, "source")


@query("kmer_counts", f"WITH {COUNTS} SELECT source, kmer, n FROM c")
def kmer_counts(spark, d):
    return _counts(spark, d)


@query("kmer_codes", f"""WITH {COUNTS}, k AS (SELECT DISTINCT kmer FROM c), d AS (SELECT kmer, list_sum(list_transform(range(1, {K + 1}), lambda i: CAST(instr('ACGT', kmer[i]) - 1 AS BIGINT) * CAST(pow(4, {K} - i) AS BIGINT))) AS code FROM k)
SELECT kmer, CAST(code AS BIGINT) AS code, CAST(code // 64 AS BIGINT) AS bucket, kmer AS decoded FROM d""")
def kmer_codes(spark, d):
    names = _counts(spark, d).select("kmer").distinct()
    return names.withColumn("code", kmers.code(F.col("kmer"), K)).select("kmer", "code", kmers.bucket(F.col("code"), K, 4).alias("bucket"), kmers.decode(F.col("code"), K).alias("decoded"))


def _sets(spark, d, low=0.0):
    return kmers.presence(_counts(spark, d).filter("n >= 4"), "source", low)


@query("kmer_presence", f"WITH {COUNTS} SELECT kmer, array_to_string(samples, ',') AS samples FROM p WHERE len(samples) BETWEEN 2 AND 18")
def kmer_presence(spark, d):
    return _sets(spark, d, 0.1).select("kmer", F.array_join("samples", ",").alias("samples"))


@query("kmer_patterns", f"WITH {COUNTS} SELECT array_to_string(samples, ',') AS pattern, CAST(len(samples) AS BIGINT) AS n_present, count(*) AS n FROM p GROUP BY 1, 2")
def kmer_patterns(spark, d):
    return kmers.pattern_counts(_sets(spark, d))


@query("kmer_pairs", f"""WITH {COUNTS}, e AS (SELECT kmer, unnest(samples) AS s FROM p), u AS (SELECT s, count(*) AS u FROM e GROUP BY s), b AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM e x JOIN e y ON x.kmer = y.kmer AND x.s < y.s GROUP BY 1, 2)
SELECT ua.s AS a, ub.s AS b, ua.u AS unique_a, ub.u AS unique_b, coalesce(n, 0) AS "both", ua.u - coalesce(n, 0) AS only_a, ub.u - coalesce(n, 0) AS only_b, ua.u + ub.u - coalesce(n, 0) AS "union", round(coalesce(n, 0) / (ua.u + ub.u - coalesce(n, 0))::DOUBLE, 9) AS jaccard
FROM u ua JOIN u ub ON ua.s < ub.s LEFT JOIN b ON b.a = ua.s AND b.b = ub.s""")
def kmer_pairs(spark, d):
    t = kmers.pair_table(_sets(spark, d))
    return t.select("a", "b", "unique_a", "unique_b", "both", "only_a", "only_b", "union", F.round("jaccard", 9).alias("jaccard"))


@query("kmer_group_patterns", f"""WITH {COUNTS} SELECT concat(CAST(len(list_intersect(samples, ['src0', 'src1', 'src2'])) > 0 AS INT), CAST(len(list_intersect(samples, ['src3', 'src4'])) > 0 AS INT)) AS pattern, count(*) AS n FROM p GROUP BY 1""")
def kmer_group_patterns(spark, d):
    return kmers.group_patterns(_sets(spark, d), {"a": ["src0", "src1", "src2"], "b": ["src3", "src4"]})


@query("bit_popcounts", """WITH h AS (SELECT DISTINCT site_id, sample_id FROM geno WHERE g >= 1), n AS (SELECT site_id, count(*) AS n FROM h GROUP BY site_id),
b AS (SELECT x.site_id, count(*) AS n FROM h x JOIN h y ON x.sample_id = y.sample_id AND y.site_id = x.site_id + 20 GROUP BY x.site_id)
SELECT a.site_id, a.n AS n_a, c.n AS n_b, coalesce(b.n, 0) AS n_and, a.n + c.n - coalesce(b.n, 0) AS n_or FROM n a JOIN n c ON c.site_id = a.site_id + 20 LEFT JOIN b ON a.site_id = b.site_id""", ("geno",))
def bit_popcounts(spark, d):
    return kmers.pair_popcounts(kmers.bit_words(view(spark, d, "geno").filter("g >= 1"), "site_id", "sample_id"), "site_id", 20)


CONF = """t AS (SELECT count(*) AS n, count(*) FILTER (WHERE case_status = 1) AS pos FROM samples),
h AS (SELECT site_id, count(*) FILTER (WHERE case_status = 1) AS tp, count(*) FILTER (WHERE case_status = 0) AS fp FROM geno g JOIN samples s ON g.sample_id = s.sample_id WHERE g >= 1 GROUP BY site_id),
f AS (SELECT site_id, tp, fp, pos - tp AS fn, n - pos - fp AS tn FROM h, t),
m AS (SELECT *, CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn) AS den FROM f),
z AS (SELECT *, CASE WHEN den > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(den) ELSE 0 END AS mcc FROM m)"""


def _response(spark, d):
    return view(spark, d, "samples").select("sample_id", F.col("case_status").alias("y"))


@query("binary_scores", f"WITH {CONF} SELECT site_id, tp, fp, fn, tn, round(((tp / nullif(tp + fn, 0)::DOUBLE) + (tn / nullif(tn + fp, 0)::DOUBLE)) / 2, 9) AS ba, round(mcc, 9) AS mcc FROM z", ("geno", "samples"))
def binary_scores(spark, d):
    c = scores.confusion(view(spark, d, "geno").filter("g >= 1"), _response(spark, d), "site_id")
    return c.select("site_id", "tp", "fp", "fn", "tn", F.round(scores.balanced_accuracy(), 9).alias("ba"), F.round(scores.mcc(), 9).alias("mcc"))


@query("top_features", f"WITH {CONF} SELECT site_id, round(abs(mcc), 9) AS score FROM z ORDER BY round(abs(mcc), 9) DESC, site_id LIMIT 15", ("geno", "samples"))
def top_features(spark, d):
    c = scores.confusion(view(spark, d, "geno").filter("g >= 1"), _response(spark, d), "site_id")
    return scores.top_k(c.select("site_id", F.round(F.abs(scores.mcc()), 9).alias("score")), "score", "site_id", 15)


@query("centred_gains", """WITH y AS (SELECT sample_id, CAST(round(y * 100) AS BIGINT) AS y FROM samples), t AS (SELECT count(*) AS n, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(y * y) AS DOUBLE) AS syy FROM y),
h AS (SELECT site_id, count(*) AS n_hit, CAST(sum(y) AS DOUBLE) AS sum_hit FROM geno g JOIN y ON g.sample_id = y.sample_id WHERE g >= 1 GROUP BY site_id)
SELECT site_id, n_hit, round(sum_hit / n_hit - (sy - sum_hit) / nullif(n - n_hit, 0), 4) AS mean_diff, round(CASE WHEN n * n_hit > n_hit * n_hit AND n * syy > sy * sy THEN (n * sum_hit - n_hit * sy) / sqrt((n * n_hit - n_hit * n_hit)::DOUBLE * (n * syy - sy * sy)) END, 9) AS corr,
  round(CASE WHEN n = n_hit THEN 0 ELSE n * pow(sum_hit - n_hit / n::DOUBLE * sy, 2) / (n_hit * (n - n_hit)) / 1e6 END, 3) AS gain FROM h, t""", ("geno", "samples"))
def centred_gains(spark, d):
    y = view(spark, d, "samples").select("sample_id", F.round(F.col("y") * 100).cast("long").alias("y"))
    g = scores.gains(view(spark, d, "geno").filter("g >= 1"), y, "site_id")
    return g.select("site_id", "n_hit", F.round("mean_diff", 4).alias("mean_diff"), F.round("corr", 9).alias("corr"), F.round(F.col("gain") / 1e6, 3).alias("gain"))


@query("conjunction_search")
def conjunction_search(spark, d):
    found = scores.best_conjunctions(view(spark, d, "geno").filter("g >= 1"), _response(spark, d), "site_id", 50, 2)
    return found.select(F.array_join(F.transform("rule", lambda x: x.cast("string")), "&").alias("rule"), "depth", "score")
