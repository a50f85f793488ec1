"""Readers of annotation, phenotype, association and bulked-segregant tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .genotypes import _lines, _numbered_lines, delimiter

#: Column names under which association tables give chromosome, position and p, in order of preference.
CHROM_NAMES = ("chrom", "chr", "#chrom", "chromosome")
POS_NAMES = ("pos", "bp", "ps", "position")
P_NAMES = ("pwald", "p", "pvalue", "p_value", "p-value", "p_wald", "plrt")


def attribute(text: Column, key: str) -> Column:
    """The value of a GFF attribute, percent-decoded, white space collapsed; 'NA' where it is not there or empty."""
    raw = F.regexp_extract(text, rf"(?:^|;\s*){re.escape(key)}=([^;]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.when(plain == "", "NA").otherwise(plain)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns; more than nine are put back together, rows without numeric ends go; with a chromosome key."""
    f = F.split("line", "\t")
    rows = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    rows = rows.withColumn("f", F.when(F.size(f) >= 9, f).otherwise(F.split(F.trim("line"), r"\s+", 9))).filter(F.size("f") >= 9)
    names = ["chrom", "source", "feature", "start", "stop", "score", "strand", "phase"]
    out = rows.select(*(F.col("f")[k].alias(n) for k, n in enumerate(names)), F.array_join(F.slice("f", F.lit(9), F.size("f")), "\t").alias("attributes"))
    out = out.withColumns({"start": F.col("start").try_cast("long"), "stop": F.col("stop").try_cast("long")}).filter("start is not null and stop is not null")
    return out.withColumn("chrom_norm", F.regexp_replace(F.trim("chrom"), "^(?i)chr", ""))


def gff_genes(gff: DataFrame, description: str = "description") -> DataFrame:
    """(chrom, start, stop, gene, strand, desc) of gene rows; a prefix like ``gene:`` of the id goes."""
    gene = F.regexp_replace(attribute(F.col("attributes"), "ID"), "^[^:]*:", "")
    return gff.filter("feature = 'gene'").select(F.col("chrom_norm").alias("chrom"), "start", "stop", gene.alias("gene"), "strand", attribute(F.col("attributes"), description).alias("desc"))


def gff_parents(gff: DataFrame) -> DataFrame:
    """(id, parent): one row for each parent of a row."""
    rows = gff.select(attribute(F.col("attributes"), "ID").alias("id"), F.explode(F.split(attribute(F.col("attributes"), "Parent"), ",")).alias("parent"))
    return rows.filter("parent <> 'NA'")


def read_bed_table(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop, gene, desc1, desc2): delimiter by the first line, headers and comments go, reversed ends are swapped, absent columns are 'NA'."""
    lines = _lines(spark, path).filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    first = lines.limit(1).collect()
    f = F.split("line", delimiter(first[0]["line"]) if first else "\t")
    a, b = F.try_element_at(f, F.lit(2)).try_cast("long"), F.try_element_at(f, F.lit(3)).try_cast("long")
    na = lambda k: F.coalesce(F.nullif(F.try_element_at(f, F.lit(k)), F.lit("")), F.lit("NA"))
    rows = lines.select(f[0].alias("chrom"), F.least(a, b).alias("start"), F.greatest(a, b).alias("stop"), na(4).alias("gene"), na(5).alias("desc1"), na(6).alias("desc2"), a.alias("_a"), b.alias("_b"))
    return rows.filter("_a is not null and _b is not null").drop("_a", "_b")


def read_gwas(spark: SparkSession, path: str, p_col: str | None = None) -> DataFrame:
    """All columns of an association table, with chrom, pos and p resolved by name; rows need a position and 0 < p <= 1."""
    first = spark.read.text(path).limit(1).collect()[0][0]
    sep = delimiter(first)
    if sep == r"\s+":
        names = first.split()
        f = F.split(F.trim("line"), sep)
        df = _lines(spark, path).filter(F.col("line") != first).select(*(F.try_element_at(f, F.lit(k + 1)).alias(n) for k, n in enumerate(names)))
    else:
        df = spark.read.csv(path, sep=sep, header=True)
    lower = {c.lower(): c for c in df.columns}

    def pick(candidates: tuple[str, ...]) -> str:
        for c in candidates:
            if c.lower() in lower:
                return lower[c.lower()]
        raise ValueError(f"none of {candidates} among {df.columns}")

    chrom, pos, p = pick(CHROM_NAMES), pick(POS_NAMES), pick((p_col,) if p_col else P_NAMES)
    q = lambda c: F.col(f"`{c}`")
    rest = [q(c) for c in df.columns if c not in (chrom, pos, p)]
    out = df.select(q(chrom).cast("string").alias("chrom"), q(pos).try_cast("double").cast("long").alias("pos"), q(p).try_cast("double").alias("p"), *rest)
    return out.filter("pos is not null and p > 0 and p <= 1")


def read_phenotypes(spark: SparkSession, path: str, id_col: int = 0) -> DataFrame:
    """(id, first_seen, traits...): values that are not numbers are missing, repeated ids are averaged."""
    rows = _numbered_lines(spark, path)
    header = rows.filter("row = 0").collect()[0]["line"]
    sep = delimiter(header)
    names = re.split(sep, header)
    f = F.split("line", sep)
    traits = [(k, n or f"V{k}") for k, n in enumerate(names) if k != id_col]
    wide = rows.filter("row > 0").select("row", f[id_col].alias("id"), *(F.try_element_at(f, F.lit(k + 1)).try_cast("double").alias(n) for k, n in traits))
    clean = [F.avg(F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`"))).alias(n) for _, n in traits]
    return wide.groupBy("id").agg(F.min("row").alias("first_seen"), *clean)


def read_bsa(spark: SparkSession, path: str, bulks: tuple[str, str]) -> DataFrame:
    """(chrom, pos, dp1, ad1, gq1, dp2, ad2, gq2): AD is the last comma field, empty cells are 0, chromosome names are cleaned."""
    df = spark.read.csv(path, sep="\t", header=True)
    c = F.upper(F.trim("CHROM"))
    c = F.regexp_replace(c, "^CHR", "")
    c = F.when(c.isin("NA", "NULL", "NAN", ""), None).when(c.rlike("^[0-9]+(\\.0+)?$"), c.try_cast("double").cast("long").cast("string")).otherwise(c)
    out = [c.alias("chrom"), F.col("POS").try_cast("double").cast("long").alias("pos")]
    for k, b in enumerate(bulks, 1):
        num = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
        out += [num(F.col(f"`{b}.DP`")).cast("long").alias(f"dp{k}"), num(F.element_at(F.split(F.col(f"`{b}.AD`"), ","), -1)).cast("long").alias(f"ad{k}"), num(F.col(f"`{b}.GQ`")).alias(f"gq{k}")]
    return df.select(*out).filter("chrom is not null and pos is not null")


def read_grm(spark: SparkSession, path: str, ids: str) -> DataFrame:
    """(i, j, k) with i <= j in ids, from a dense text matrix and its id file."""
    names = _numbered_lines(spark, ids).select("row", F.split(F.trim("line"), r"\s+").alias("f")).select("row", F.element_at("f", -1).alias("id"))
    cells = _numbered_lines(spark, path).select(F.col("row").alias("r"), F.posexplode(F.split(F.trim("line"), r"[\t, ]+")).alias("c", "k"))
    a, b = names.select(F.col("row").alias("r"), F.col("id").alias("i")), names.select(F.col("row").cast("int").alias("c"), F.col("id").alias("j"))
    return cells.filter("r <= c").join(a, "r").join(b, "c").select("i", "j", F.col("k").try_cast("double").alias("k"))


def read_sparse_grm(spark: SparkSession, path: str, ids: str) -> DataFrame:
    """(i, j, k) with i <= j, as numbers in ids, from a sparse text matrix of (row, column, value) counted from 0 and its id file."""
    names = _numbered_lines(spark, ids).select("row", F.split(F.trim("line"), r"\s+").alias("f")).select("row", F.element_at("f", -1).alias("id"))
    f = F.split(F.trim("line"), r"\s+")
    cell = lambda x: F.try_element_at(f, F.lit(x))
    cells = spark.read.text(path).select(F.col("value").alias("line")).filter("trim(line) <> ''").select(cell(1).try_cast("long").alias("r"), cell(2).try_cast("long").alias("c"), cell(3).try_cast("double").alias("k"))
    cells = cells.filter("r is not null and c is not null").select(F.least("r", "c").alias("r"), F.greatest("r", "c").alias("c"), "k").dropDuplicates(["r", "c"])
    a, b = names.select(F.col("row").alias("r"), F.col("id").alias("i")), names.select(F.col("row").alias("c"), F.col("id").alias("j"))
    return cells.join(a, "r").join(b, "c").select("i", "j", "k")


def read_covariates(spark: SparkSession, path: str, id_col: int = 0) -> DataFrame:
    """(id, covariates...) of the samples for which every covariate is a number; repeated ids are averaged."""
    t = read_phenotypes(spark, path, id_col).drop("first_seen")
    return t.dropna(subset=[f"`{c}`" for c in t.columns if c != "id"])


def parse_range(text: str) -> tuple[str, int, int]:
    """``chr:start-end``, in megabases, or in bases where a number has more than six digits."""
    m = re.fullmatch(r"\s*(?:chr)?([^:]+):([0-9.]+)-([0-9.]+)\s*", text, re.I)
    if not m:
        raise ValueError(f"not a range: {text}")
    base = lambda s: int(s) if s.isdigit() and len(s) > 6 else round(float(s) * 1_000_000)
    a, b = sorted((base(m[2]), base(m[3])))
    return m[1], a, b


def parse_window(text: str, bare: str = "variants") -> tuple[str, float]:
    """(unit, size) of a window like 500kb, 1mb, 2cM, 50 variants; ``bare`` says what a bare number counts."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*(bp|kb|mb|cm|variants?|snps?)?\s*", text, re.I)
    if not m:
        raise ValueError(f"not a window: {text}")
    size, unit = float(m[1]), (m[2] or bare).lower()
    scale = {"bp": ("bp", 1), "kb": ("bp", 1e3), "mb": ("bp", 1e6), "cm": ("cm", 1)}
    if unit in scale:
        return scale[unit][0], size * scale[unit][1]
    return "variants", size
