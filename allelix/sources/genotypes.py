"""Readers of genotype text and binary files, as DataFrames.

Text formats are read line by line with ``spark.read.text``; headers are found in
the file's first lines, and every line is parsed by column functions.  Positions
in a file are explicit columns, as a DataFrame has no order.  Binary files are
read in ranges of rows, a task for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two-base IUPAC codes.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC"}
#: Dosage of each 2-bit BED code; code 1 is missing.
BED_DOSAGE = np.array([0, -9, 1, 2], np.int8)
BED_MAGIC = b"\x6c\x1b\x01"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("line", F.regexp_replace("value", "\r$", "")).drop("value")


def delimiter(line: str) -> str:
    """Tab, else comma, else white space, by the first line."""
    return "\t" if "\t" in line else "," if "," in line else r"\s+"


def dosage(gt: Column) -> Column:
    """0/0, 0/1, 1/0, 1/1 (phased or not) to 0, 1, 2; anything else is missing."""
    gt = F.replace(gt, F.lit("|"), F.lit("/"))
    return F.when(gt == "0/0", 0).when(gt.isin("0/1", "1/0"), 1).when(gt == "1/1", 2).cast("int")


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sites, calls): sites have (chrom, pos, snp, ref, alt), calls (chrom, pos, snp, sample_idx, iid, g).

    Lines with fewer than ten columns or no GT in FORMAT are skipped; an id of '.'
    becomes chrom_pos.  Plain, gzip and block-gzip text are read alike.
    """
    lines = _lines(spark, path)
    header = lines.filter(F.col("line").startswith("#CHROM")).limit(1).collect()
    names = header[0]["line"].split("\t")[9:] if header else []
    f = F.split("line", "\t")
    rows = lines.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("f", f).filter(F.size("f") >= 10)
    gt = F.array_position(F.split(F.col("f")[8], ":"), "GT")
    rows = rows.withColumn("gt", gt).filter("gt > 0")
    pos = F.col("f")[1].try_cast("int")
    snp = F.when(F.col("f")[2] == ".", F.concat_ws("_", F.col("f")[0], F.col("f")[1])).otherwise(F.col("f")[2])
    rows = rows.select(F.col("f")[0].alias("chrom"), pos.alias("pos"), snp.alias("snp"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), "gt", "f")
    values = F.transform(F.slice("f", F.lit(10), F.size("f")), lambda x: F.try_element_at(F.split(x, ":"), F.col("gt").cast("int")))
    calls = rows.select("chrom", "pos", "snp", F.posexplode(values).alias("sample_idx", "v"))
    iid = F.try_element_at(F.array(*(F.lit(n) for n in names)), F.col("sample_idx") + 1) if names else F.lit(None).cast("string")
    return rows.select("chrom", "pos", "snp", "ref", "alt"), calls.select("chrom", "pos", "snp", "sample_idx", iid.alias("iid"), dosage(F.col("v")).alias("g"))


def read_hapmap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sites, calls) of a HapMap table; alleles come from its second column, calls from pairs or IUPAC codes."""
    lines = _lines(spark, path)
    head = lines.filter(F.lower("line").startswith("rs")).limit(1).collect()
    names = head[0]["line"].split("\t")[11:] if head else []
    rows = lines.withColumn("f", F.split("line", "\t")).filter((F.size("f") >= 12) & ~F.lower("line").startswith("rs#"))
    alleles = F.split(F.col("f")[1], "/")
    rows = rows.select(F.col("f")[2].alias("chrom"), F.col("f")[3].try_cast("int").alias("pos"), F.col("f")[0].alias("snp"), alleles[0].alias("ref"), F.try_element_at(alleles, F.lit(2)).alias("alt"), "f")
    pairs = F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv))
    calls = rows.select("chrom", "pos", "snp", "ref", "alt", F.posexplode(F.slice("f", F.lit(12), F.size("f"))).alias("sample_idx", "v"))
    token = F.upper(F.regexp_replace("v", "[/|]", ""))
    two = F.when(F.length(token) == 1, F.coalesce(pairs[token], F.concat(token, token))).otherwise(token)
    a, b = F.substring(two, 1, 1), F.substring(two, 2, 1)
    known = a.isin("A", "C", "G", "T") & ((a == F.col("ref")) | (a == F.col("alt"))) & ((b == F.col("ref")) | (b == F.col("alt")))
    g = F.when(known, (a == F.col("alt")).cast("int") + (b == F.col("alt")).cast("int"))
    iid = F.try_element_at(F.array(*(F.lit(n) for n in names)), F.col("sample_idx") + 1) if names else F.lit(None).cast("string")
    return rows.select("chrom", "pos", "snp", "ref", "alt"), calls.select("chrom", "pos", "snp", "sample_idx", iid.alias("iid"), g.alias("g"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """(row, chrom, snp, cm, pos, ref, alt): column 5 is ref, column 6 alt; rows count from 0 in file order."""
    return _whitespace(spark, path, ["chrom string", "snp string", "cm double", "pos int", "ref string", "alt string"])


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """(row, fid, iid): the second column is the sample's id."""
    return _whitespace(spark, path, ["fid string", "iid string"])


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, line) of a file's lines that are not blank; one file is read whole, as numbers need its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                texts = [t for t in bytes(blob).decode().splitlines() if t.strip()]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["row", "line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, line string")


def _whitespace(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns between white space, each ``name type``, with the row's number."""
    f = F.split(F.trim("line"), r"\s+")
    parsed = (F.try_element_at(f, F.lit(k + 1)).try_cast(c.split()[1]).alias(c.split()[0]) for k, c in enumerate(columns))
    return _numbered_lines(spark, path).select("row", *parsed)


def _decode_bed(n_samples: int):
    width = -(-n_samples // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
                g = BED_DOSAGE[(raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3].reshape(len(raw), -1)[:, :n_samples]
                rows = pa.array(first + np.arange(len(raw)))
                flat = pa.array(g.ravel(), pa.int8(), mask=g.ravel() < 0)
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(np.arange(0, g.size + 1, n_samples), pa.int32()), flat)], ["row", "g"])

    return run


def read_bed(spark: SparkSession, path: str, n_samples: int, rows_a_part: int = 4096) -> DataFrame:
    """(row, g): the dosages of all samples at each site of a SNP-major BED file, missing as null."""
    width = -(-n_samples // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                blob = bytes(blob)
                if blob[:3] != BED_MAGIC:
                    raise ValueError("not a SNP-major BED file")
                step = width * rows_a_part
                starts = list(range(3, len(blob), step))
                yield pa.RecordBatch.from_arrays([pa.array([(a - 3) // width for a in starts], pa.int64()), pa.array([blob[a : a + step] for a in starts], pa.binary())], ["first", "part"])

    parts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "first long, part binary")
    return parts.repartition("first").mapInArrow(_decode_bed(n_samples), "row long, g array<tinyint>")


def read_plink(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, samples, calls in long form) of a BED/BIM/FAM set."""
    sites, samples = read_bim(spark, f"{prefix}.bim").withColumnRenamed("row", "site_id"), read_fam(spark, f"{prefix}.fam").withColumnRenamed("row", "sample_id")
    calls = read_bed(spark, f"{prefix}.bed", samples.count()).select(F.col("row").alias("site_id"), F.posexplode("g").alias("sample_id", "g"))
    return sites, samples, calls.select("site_id", F.col("sample_id").cast("long").alias("sample_id"), F.col("g").cast("int").alias("g"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, x): rows of a two-dimensional NPY array of numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                m = np.load(io.BytesIO(bytes(blob)), allow_pickle=False).astype(float)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m))), flat], ["row", "x"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, x array<double>")


def read_matrix(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(samples, calls) of a numeric text matrix ``prefix.txt`` with ids in ``prefix.id``; negative values are missing."""
    rows = _numbered_lines(spark, f"{prefix}.txt")
    v = F.split(F.trim("line"), r"[\t,]|\s+")
    cells = rows.select(F.col("row").alias("site_id"), F.posexplode(v).alias("sample_id", "v"))
    x = F.col("v").try_cast("double")
    samples = _whitespace(spark, f"{prefix}.id", ["iid string"]).withColumnRenamed("row", "sample_id")
    return samples, cells.select("site_id", F.col("sample_id").cast("long").alias("sample_id"), F.when(x >= 0, x).alias("g"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read, sequence): every second line of four; files are read whole, as records span lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = (gzip.decompress(bytes(blob)) if name.endswith(".gz") else bytes(blob)).decode().splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([h[1:] for h in text[0::4] if h]), pa.array(text[1::4])], ["read", "sequence"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "read string, sequence string")
