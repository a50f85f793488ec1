"""Writers: association and statistics tables, VCF and HapMap text, PLINK binary, k-mer matrices.

Text goes through Spark's own writers, so each is a folder of part files whose
header is repeated in none: ``header_of`` gives it, and readers take both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .genotypes import BED_MAGIC

BASIC = ["chrom", "pos", "snp", "allele0", "allele1", "af", "miss", "beta", "se", "chisq", "pwald"]


def association_rows(scan: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The association schema as text: four decimals, p in scientific notation; ``extra`` are plrt, or lambda, ml and plrt."""
    fixed = lambda c: F.format_string("%.4f", F.col(c))
    short = lambda c: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.4e" if c in ("pwald", "plrt") else "%.6e", F.col(c)))
    cells = [F.col(c).cast("string") if c in ("chrom", "pos", "snp", "allele0", "allele1") else F.when(F.col(c).isNull(), "nan").otherwise(fixed(c)) for c in BASIC[:-1]]
    return scan.select(F.concat_ws("\t", *cells, short("pwald"), *(short(c) for c in extra)).alias("value"))


def write_association(scan: DataFrame, path: str, extra: tuple[str, ...] = ()) -> None:
    rows = association_rows(scan, extra)
    header = scan.sparkSession.createDataFrame([("\t".join([*BASIC, *extra]),)], "value string")
    header.unionByName(rows).write.text(path)


def vcf_rows(sites: DataFrame, calls: DataFrame, n_samples: int) -> DataFrame:
    """VCF lines: one for each site, with all samples in order, absent calls missing."""
    gt = F.when(F.col("g") == 0, "0/0").when(F.col("g") == 1, "0/1").when(F.col("g") == 2, "1/1")
    packed = calls.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sample_id").cast("long"), F.coalesce(gt, F.lit("./."))))).alias("m"))
    row = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("./.")))
    full = sites.join(packed, "site_id", "left").withColumn("m", F.coalesce("m", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<string>"))))
    text = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "snp", "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join(row, "\t"))
    return full.select("chrom", "pos", text.alias("value"))


def write_vcf(sites: DataFrame, calls: DataFrame, names: list[str], path: str, compression: str = "none") -> None:
    head = "##fileformat=VCFv4.2\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"Genotype\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names)
    header = sites.sparkSession.createDataFrame([(head,)], "value string")
    rows = vcf_rows(sites, calls, len(names)).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("value")
    header.unionByName(rows).write.option("compression", compression).text(path)


def hapmap_rows(sites: DataFrame, calls: DataFrame, n_samples: int) -> DataFrame:
    """HapMap lines with two-letter calls, NN where missing."""
    j = calls.join(sites.select("site_id", "ref", "alt"), "site_id")
    two = F.when(F.col("g") == 0, F.concat("ref", "ref")).when(F.col("g") == 1, F.concat("ref", "alt")).when(F.col("g") == 2, F.concat("alt", "alt")).otherwise("NN")
    packed = j.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sample_id").cast("long"), two))).alias("m"))
    row = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("NN")))
    na = [F.lit("NA")] * 6
    text = F.concat_ws("\t", "snp", F.concat_ws("/", "ref", "alt"), "chrom", F.col("pos").cast("string"), F.lit("+"), *na, F.array_join(row, "\t"))
    return sites.join(packed, "site_id").select("chrom", "pos", text.alias("value"))


def pack_bed(calls: DataFrame, n_samples: int) -> DataFrame:
    """(site_id, packed): the 2-bit codes of each site, absent samples missing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for samples, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                codes = np.ones(-(-n_samples // 4) * 4, np.uint8)
                codes[n_samples:] = 0
                codes[np.array(samples, np.int64)] = np.array([0, 2, 3], np.uint8)[np.array(g, np.int64)]
                c = codes.reshape(-1, 4)
                out.append((c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["site_id", "packed"])

    rows = calls.filter("g is not null").groupBy("site_id").agg(F.collect_list("sample_id").alias("s"), F.collect_list("g").alias("g"))
    return rows.mapInArrow(run, "site_id long, packed binary")


def bed_bytes(packed: DataFrame) -> bytes:
    """A whole BED file; for files that fit the driver, as the format is one file."""
    return BED_MAGIC + b"".join(bytes(r["packed"]) for r in packed.orderBy("site_id").collect())


def rate_table(rates: DataFrame, sites: DataFrame, column: str) -> DataFrame:
    """``chrom pos rate`` text of site rates, six decimals."""
    j = rates.join(sites.select("site_id", "chrom", "pos"), "site_id")
    return j.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.format_string("%.6f", F.col(column))).alias("value"))


def sample_table(rates: DataFrame, samples: DataFrame, column: str) -> DataFrame:
    """``iid rate`` text of sample rates, six decimals."""
    j = rates.join(samples.select("sample_id", "iid"), "sample_id")
    return j.select(F.concat_ws("\t", "iid", F.format_string("%.6f", F.col(column))).alias("value"))


def score_table(scores: DataFrame, sites: DataFrame) -> DataFrame:
    """``chrom pos score number`` text of LD scores and the sizes of their windows, six decimals."""
    j = scores.join(sites.select("site_id", "chrom", "pos"), "site_id")
    return j.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.format_string("%.6f", F.col("ld_score")), F.col("m").cast("string")).alias("value"))
