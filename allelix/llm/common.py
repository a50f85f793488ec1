"""Shared pieces of the corpus operators: where tables go, and vectorised text kernels.

The kernels work on the buffers of an Arrow string column: all texts of a block
lie back to back in one byte array, with an offset for each text.  They never
look at one character at a time in Python.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are processed in blocks of about so many bytes (a longer text is a block of its own).
BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Letters hashed at once.
STRIDE = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Only a session in local mode may
    leave it unset; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="allelix-")
        sc.setCheckpointDir(path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows, unless the session has set its own number: a row is a text, and a batch is held in the JVM and in Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "allelix", uuid.uuid4().hex, name)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, whoever is lost later."""
    path = table_path(spark, name)
    bound_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return freed memory to the system where the C library can, so that idle Python workers stay small."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def known_bytes(df: DataFrame) -> int | None:
    """The size of a table as its plan's statistics have it, None where they do not."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >> 60 else size


def positioned(docs: DataFrame) -> DataFrame:
    """(row, key): all columns of a row as one struct, and a key that no other row has, whatever the row holds.

    Rows of files are known by the file's path and the row's number in it, which are
    the same in every run over the same files; other tables are written first.
    """
    bound_batches(docs.sparkSession)
    row = F.struct("*").alias("row")
    try:
        if "_metadata" not in docs.columns:
            return docs.select(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("key"))
    except AnalysisException:
        pass
    at = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("key")
    return stored(docs.sparkSession, docs.select(row, at), "rows")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text is divisible by 5; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive blocks; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; all bytes of a non-ASCII code point are at or above 0x80.
ALNUM = _class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of [^\x20\x09-\x0D]+.
NONSPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text): maximal runs of member bytes, which never cross texts."""
    n = len(data)
    inside = member[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False  # a text starts afresh
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets[1:]] = False
    starts = np.flatnonzero(inside & ~before[:n])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Roller:
    """Polynomial hashes of arbitrary byte spans, from prefix sums modulo the prime 2**31 - 1.

    Two hashes with tables and bases of their own give 62 bits.  As the modulus is
    prime, no pattern of letters makes a difference vanish for every table (as words
    of the Thue-Morse kind do modulo a power of two); two different spans of n bytes
    collide with a chance of at most (n / 2**31)**2 over the choice of bases.
    """

    PRIME = np.uint64((1 << 31) - 1)
    BASES = (48271, 1_283_743_991)

    def __init__(self, seed: int = 42, fold: np.ndarray | None = None):
        tables = np.random.default_rng(seed).integers(1, int(self.PRIME), (2, 256), dtype=np.uint64)
        self.tables = tables if fold is None else tables[:, fold]
        self.up = self.down = np.ones((2, 1), np.uint32)

    @classmethod
    def _fold(cls, x: np.ndarray) -> np.ndarray:
        """Below 2**32, and the same modulo the prime."""
        return (x & cls.PRIME) + (x >> np.uint64(31))

    @classmethod
    def _reduce(cls, x: np.ndarray) -> np.ndarray:
        x = cls._fold(cls._fold(x))
        x[x >= cls.PRIME] -= cls.PRIME
        return x

    def _grow(self, n: int) -> None:
        if self.up.shape[1] <= n:
            size = max(n + 1, BLOCK_BYTES + 2)
            for name, sign in (("up", 1), ("down", -1)):
                rows = []
                for base in self.BASES:
                    step, powers = pow(base, sign, int(self.PRIME)), np.ones(1, np.uint64)
                    while len(powers) < size:  # by doubling
                        powers = np.concatenate([powers, self._reduce(powers * np.uint64(pow(step, len(powers), int(self.PRIME))))])
                    rows.append(powers[:size].astype(np.uint32))
                setattr(self, name, np.stack(rows))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros((2, len(data) + 1), np.uint64)
        for k in range(2):  # terms are below 2**32, so that sums of 2**31 of them fit
            for a in range(0, len(data), STRIDE):  # what is worked on stays in the cache
                part = out[k, a + 1 : a + STRIDE + 1]
                np.take(self.tables[k], data[a : a + STRIDE], out=part)
                part *= self.up[k, a : a + len(part)]
                low = part & self.PRIME
                part >>= np.uint64(31)
                part += low
                np.cumsum(part, out=part)
                part += out[k, a]
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k in range(2):
            part = self._reduce(prefix[k][ends] - prefix[k][starts])
            out = out << np.uint64(31) | self._reduce(part * self.down[k][starts])
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
