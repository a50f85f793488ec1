"""Binary presence files: bit matrices, k-mer site lists, and k-mer matrices with their presence columns.

Each format is one file, so writers return its bytes (for what fits the driver;
Parquet is the format for more), and readers deal a file's rows out as soon as it
is cut into ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
MATRIX_MAGIC = b"JXBIN001"  # then u64 rows, u64 samples, u64 0
MATRIX_HEADER = 32
SITES_MAGIC = b"JXBSITE1"  # then u64 sites, 8 bytes of 0; each site: u16 length, 2-bit bases, the first lowest
SITES_HEADER = 24
KMER_MAGIC = b"JXBKMR1\0"  # then u32 version, u32 k, u64 k-mers, u32 encoding, u32 canonical, 32 bytes of 0; u64 codes
KMER_HEADER = 64
PRESENCE_MAGIC = b"JXBSIT1\0"  # then u32 version, u32 layout, u64 samples, u64 k-mers, u64 bytes of a column, u32 bit order, u32 compression, u32 0, 28 bytes of 0
PRESENCE_HEADER = 80


def _rows(spark: SparkSession, path: str, cut, decode, kind: str) -> DataFrame:
    """``cut`` gives (first row, samples, bytes) ranges of a file, ``decode`` the rows of a range."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                for first, n, part in cut(bytes(blob)):
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([part], pa.binary())], ["first", "n", "part"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield decode(first, n, part)

    parts = spark.read.format("binaryFile").load(path).select("content").mapInArrow(ranges, "first long, n long, part binary")
    return parts.repartition("first").mapInArrow(rows, kind)


def _set_bits(first: int, n: int, part: bytes) -> pa.RecordBatch:
    bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, -(-n // 8)), axis=1, bitorder="little")[:, :n]
    at = np.concatenate([[0], np.cumsum(bits.sum(1))])
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.nonzero(bits)[1], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(bits))), lists], ["row", "samples"])


def read_bit_matrix(spark: SparkSession, path: str, rows_a_part: int = 1 << 16) -> DataFrame:
    """(row, samples): the samples whose bit is set, for each row of a bit matrix."""

    def cut(blob: bytes):
        if blob[:8] != MATRIX_MAGIC:
            raise ValueError("not a bit matrix")
        n_rows, n = struct.unpack_from("<QQ", blob, 8)
        width = -(-n // 8)
        for a in range(0, n_rows, rows_a_part):
            b = min(n_rows, a + rows_a_part)
            yield a, n, blob[MATRIX_HEADER + a * width : MATRIX_HEADER + b * width]

    return _rows(spark, path, cut, _set_bits, "row long, samples array<long>")


def _packed(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, bits) from (key, samples)."""
    width = -(-n // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for samples in batch.column(1).to_pylist():
                bits = np.zeros(width * 8, np.uint8)
                bits[np.array(samples or [], np.int64)] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "bits"])

    return df.select(F.col(key).cast("long").alias(key), F.col("samples").cast("array<bigint>").alias("samples")).mapInArrow(run, f"{key} long, bits binary")


def bit_matrix_bytes(rows: DataFrame, n_samples: int) -> bytes:
    """A bit matrix from (row, samples), in order of row."""
    body = [bytes(r["bits"]) for r in _packed(rows, "row", n_samples).orderBy("row").collect()]
    return MATRIX_MAGIC + struct.pack("<QQQ", len(body), n_samples, 0) + b"".join(body)


def kmer_sites_bytes(kmers: list[str]) -> bytes:
    out = [SITES_MAGIC, struct.pack("<QQ", len(kmers), 0)]
    for k in kmers:
        codes = np.array(["ACGT".index(c) for c in k] + [0] * (-len(k) % 4), np.uint8).reshape(-1, 4)
        out += [struct.pack("<H", len(k)), (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes()]
    return b"".join(out)


def read_kmer_sites(spark: SparkSession, path: str) -> DataFrame:
    """(row, kmer) of a site list; its records differ in length, so one task reads a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                blob = bytes(blob)
                if blob[:8] != SITES_MAGIC:
                    raise ValueError("not a site list")
                at, out = SITES_HEADER, []
                for _ in range(struct.unpack_from("<Q", blob, 8)[0]):
                    (k,) = struct.unpack_from("<H", blob, at)
                    raw = np.frombuffer(blob, np.uint8, -(-k // 4), at + 2)
                    out.append("".join("ACGT"[c] for c in ((raw[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[:k]))
                    at += 2 + len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int64()), pa.array(out, pa.string())], ["row", "kmer"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, kmer string")


def kmer_matrix_bytes(presence: DataFrame, k: int, n_samples: int, canonical: bool = True) -> tuple[bytes, bytes]:
    """(codes file, presence file) from (code, samples), in order of code."""
    rows = _packed(presence, "code", n_samples).orderBy("code").collect()
    codes = np.array([r["code"] for r in rows], "<u8").tobytes()
    head = KMER_MAGIC + struct.pack("<IIQII", 1, k, len(rows), 0, int(canonical)) + bytes(32)
    side = PRESENCE_MAGIC + struct.pack("<IIQQQIII", 1, 1, n_samples, len(rows), -(-n_samples // 8), 0, 0, 0) + bytes(28)
    return head + codes, side + b"".join(bytes(r["bits"]) for r in rows)


def read_kmer_matrix(spark: SparkSession, codes_path: str, presence_path: str, rows_a_part: int = 1 << 16) -> DataFrame:
    """(code, samples) of a k-mer matrix."""

    def cut_codes(blob: bytes):
        if blob[:8] != KMER_MAGIC:
            raise ValueError("not a k-mer file")
        for a in range(0, (len(blob) - KMER_HEADER) // 8, rows_a_part):
            yield a, 0, blob[KMER_HEADER + 8 * a : KMER_HEADER + 8 * (a + rows_a_part)]

    def codes(first: int, n: int, part: bytes) -> pa.RecordBatch:
        x = np.frombuffer(part, "<u8").astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(x))), pa.array(x)], ["row", "code"])

    def cut_presence(blob: bytes):
        if blob[:8] != PRESENCE_MAGIC:
            raise ValueError("not a presence file")
        n, m, width = struct.unpack_from("<QQQ", blob, 16)
        for a in range(0, m, rows_a_part):
            yield a, n, blob[PRESENCE_HEADER + a * width : PRESENCE_HEADER + min(m, a + rows_a_part) * width]

    left = _rows(spark, codes_path, cut_codes, codes, "row long, code long")
    right = _rows(spark, presence_path, cut_presence, _set_bits, "row long, samples array<long>")
    return left.join(right, "row").select("code", "samples")
