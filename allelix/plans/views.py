"""Genotype tables laid over the relational test tables, in integer arithmetic only.

Lineitem rows are observations: parts are sites, suppliers are samples, and the
line numbers of a (site, sample) pair give one dosage.  The same SQL text defines
each view for Spark and for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SITES = """SELECT p_partkey AS site_id, CAST(p_partkey % 20 + 1 AS VARCHAR(8)) AS chrom, CAST(floor(p_partkey / 20) * 1000 + 1 AS INT) AS pos,
  concat('rs', p_partkey) AS snp, substring('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS ref,
  substring('ACGT', CAST((p_partkey + 1 + p_size % 3) % 4 + 1 AS INT), 1) AS alt, p_brand AS gene_set FROM part"""
GENO = """SELECT site_id, sample_id, CAST(CASE WHEN e = 0 THEN NULL WHEN h < 6 + site_id % 11 THEN 0 WHEN h < 11 + site_id % 11 THEN 1 ELSE 2 END AS INT) AS g
  FROM (SELECT l_partkey AS site_id, l_suppkey AS sample_id, sum(l_linenumber) % 19 AS e, (sum(l_linenumber) * 7 + l_suppkey * 5 + l_partkey * 3) % 23 AS h
    FROM lineitem GROUP BY l_partkey, l_suppkey) o"""
SAMPLES = """SELECT s_suppkey AS sample_id, s_name AS iid, s_nationkey AS family, s_acctbal AS y,
  CAST(s_suppkey % 2 AS INT) AS case_status, CAST(s_suppkey % 5 AS INT) AS fold FROM supplier"""
FEATURES = """SELECT o_orderkey AS feature_id, CAST(o_custkey % 20 + 1 AS VARCHAR(8)) AS chrom, CAST(o_orderkey * 7 % 1000000 AS INT) AS start,
  CAST(o_orderkey * 7 % 1000000 + o_custkey % 5000 AS INT) AS stop, concat('G', CAST(floor(o_orderkey / 3) AS INT)) AS gene,
  CASE o_orderkey % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'CDS' ELSE 'exon' END AS feature,
  CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders"""
HITS = """SELECT p_partkey AS site_id, CAST(p_partkey % 20 + 1 AS VARCHAR(8)) AS chrom, CAST(floor(p_partkey / 20) * 1000 + 1 AS INT) AS pos,
  (1 + (p_partkey * 7919) % 99991) / CAST(100000 AS DOUBLE) AS p, (p_size - 25) / CAST(16 AS DOUBLE) AS beta FROM part"""

VIEWS = {"sites": SITES, "geno": GENO, "samples": SAMPLES, "features": FEATURES, "hits": HITS}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def with_views(*names: str) -> str:
    """The WITH clause that defines views for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables in ``sf_dir``."""
    source = {"sites": "part", "geno": "lineitem", "samples": "supplier", "features": "orders", "hits": "part"}[name]
    text = VIEWS[name].replace(f"FROM {source}", "FROM {t}").replace("AS VARCHAR(8)", "AS STRING")
    return spark.sql(text, t=table(spark, sf_dir, source))
