"""K-mers as Spark columns: codes, reverse complements, canonical forms, buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Letters whose k-mers are counted at once, and distinct k-mers held by a task.
LETTERS = 1 << 20


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The lesser of a k-mer and its reverse complement; letters sort like their 2-bit codes."""
    return F.least(s, reverse_complement(s))


def code(s: Column, k: int) -> Column:
    """2 bits a base, the first base highest; k is at most 31."""
    digits = F.translate(s, "ACGT", "0123")
    return F.conv(digits, 4, 10).cast("long") if k <= 31 else F.lit(None).cast("long")


def decode(c: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(c.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def bucket(c: Column, k: int, bits: int) -> Column:
    """The leading bits of a code."""
    return F.shiftright(c, max(0, 2 * k - bits))


def windows_of(text: Column, k: int) -> Column:
    """Every substring of length k, in order."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where the input is in fewer parts: what follows makes many rows of each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _reverse_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    out, rest = np.zeros_like(codes), codes.copy()
    for _ in range(k):
        out = out << 2 | (3 - (rest & 3))
        rest >>= 2
    return out


def _added(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, n, len(codes)).astype(np.int64)


def _counts(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes and their counts; letters are 0 to 3, and 4 where a read parts."""
    n = len(letters) - k + 1
    codes, good = np.zeros(n, np.int64), np.ones(n, bool)
    for at in range(k):
        codes <<= 2
        codes |= letters[at : at + n]
        good &= letters[at : at + n] < 4
    codes = codes[good]
    if 4**k <= LETTERS:
        seen = np.bincount(codes, minlength=4**k)
        codes = np.flatnonzero(seen)
        seen = seen[codes]
    else:
        seen = np.ones(len(codes), np.int64)
    return _added(np.minimum(codes, _reverse_codes(codes, k)), seen)


def _count_in_tasks(k: int, by: int, kind: pa.Schema):
    """Batches of (by..., sequence) to (by..., code, n), added up in the task as far as it holds them."""
    digit = np.full(256, 4, np.uint8)
    for d, pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
        digit[[ord(c) for c in pair]] = d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for key, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(codes), f.type) for x, f in zip(key, kind)), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], [*(f.name for f in kind), "_code", "n"])
            held.clear()

        for b in batches:
            groups: dict[tuple, list[bytes]] = {}
            for *key, text in zip(*(b.column(c).to_pylist() for c in range(by)), b.column(by).cast(pa.binary()).to_pylist()):
                if text:
                    groups.setdefault(tuple(key), []).append(text)
            for key, texts in groups.items():
                letters = digit[np.frombuffer(b"\n".join(texts), np.uint8)]
                for lo in range(0, len(letters) - k + 1, LETTERS):  # the last k - 1 letters of a piece begin the next
                    codes, n = _counts(letters[lo : lo + LETTERS + k - 1], k)
                    old = held.get(key, (codes[:0], n[:0]))
                    held[key] = _added(np.concatenate([old[0], codes]), np.concatenate([old[1], n]))
                    if sum(len(c) for c, _ in held.values()) > LETTERS:
                        yield from sent()
        yield from sent()

    return run


def count_kmers(reads: DataFrame, sequence: str, k: int, *by: str) -> DataFrame:
    """Canonical k-mers of A, C, G and T with their counts; other letters part a read.

    Up to 31 letters windows are codes in a task and become text only after they are counted.
    """
    if k > 31:
        runs = spread(reads).select(*by, F.explode(F.split(F.upper(F.col(sequence)), "[^ACGT]+")).alias("_run"))
        all_of = runs.select(*by, F.explode(windows_of(F.col("_run"), k)).alias("_w"))
        return all_of.groupBy(*by, canonical(F.col("_w")).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    rows = spread(reads).select(*by, F.col(sequence).cast("string").alias("_seq"))
    kind = StructType([rows.schema[c] for c in by])
    counted = rows.mapInArrow(_count_in_tasks(k, len(by), to_arrow_schema(kind)), StructType([*kind.fields, StructField("_code", LongType()), StructField("n", LongType())]))
    return counted.groupBy(*by, "_code").agg(F.sum("n").alias("n")).select(*by, decode(F.col("_code"), k).alias("kmer"), "n")


def presence(counts: DataFrame, sample: str, low: float = 0.0) -> DataFrame:
    """(kmer, samples): which samples have it, for k-mers whose share of samples is in [low, 1 - low]."""
    total = counts.select(sample).distinct().agg(F.count(F.lit(1)).alias("_n"))
    sets = counts.groupBy("kmer").agg(F.array_sort(F.collect_set(sample)).alias("samples"))
    share = F.size("samples") / F.col("_n")
    return sets.join(F.broadcast(total), F.lit(True)).filter((share >= low) & (share <= 1 - low)).drop("_n")


def pattern_counts(sets: DataFrame) -> DataFrame:
    """How many k-mers have each pattern of samples."""
    return sets.groupBy(F.array_join("samples", ",").alias("pattern"), F.size("samples").cast("long").alias("n_present")).agg(F.count(F.lit(1)).alias("n"))


def pair_table(sets: DataFrame) -> DataFrame:
    """Shared and private k-mers and the Jaccard index of each pair of samples, from patterns rather than k-mers."""
    patterns = sets.groupBy("samples").agg(F.count(F.lit(1)).alias("n"))
    unique = patterns.select(F.explode("samples").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("u"))
    both = patterns.select(F.explode("samples").alias("a"), "samples", "n").select("a", F.explode("samples").alias("b"), "n").filter("a < b").groupBy("a", "b").agg(F.sum("n").alias("both"))
    left, right = unique.select(F.col("s").alias("a"), F.col("u").alias("unique_a")), unique.select(F.col("s").alias("b"), F.col("u").alias("unique_b"))
    t = left.join(right, F.col("a") < F.col("b")).join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("unique_a") + F.col("unique_b") - F.col("both")
    return t.withColumns({"only_a": F.col("unique_a") - F.col("both"), "only_b": F.col("unique_b") - F.col("both"), "union": union, "jaccard": F.try_divide(F.col("both").cast("double"), union)})


def group_patterns(sets: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """For each k-mer, a bit for each group that has it in some sample; and counts of the patterns."""
    has = [F.arrays_overlap("samples", F.array(*(F.lit(x) for x in names))) for names in groups.values()]
    pattern = F.concat(*(F.when(h, "1").otherwise("0") for h in has))
    return sets.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.bit_count(w))


def and_popcount(a: Column, b: Column) -> Column:
    return popcount(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def or_words(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def bit_words(df: DataFrame, key: str, bit: str) -> DataFrame:
    """(key, _w, _v): set bits of each key as 63-bit words, only those that are not 0, with their numbers."""
    words = df.select(key, F.floor(F.col(bit) / 63).alias("_w"), (F.col(bit) % 63).cast("int").alias("_b")).distinct()
    return words.groupBy(key, "_w").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b"))).alias("_v"))


def pair_popcounts(words: DataFrame, key: str, step: int) -> DataFrame:
    """(key, n_a, n_b, n_and, n_or): bits of each key and of key + ``step``, where both have some.

    ``words`` are ``bit_words``: words meet by key and number, so the work follows the
    set bits, not the highest bit.
    """
    none = F.lit(0).cast("long")
    mine = words.select(key, "_w", F.col("_v").alias("a"), none.alias("b"))
    other = words.select((F.col(key) - step).alias(key), "_w", none.alias("a"), F.col("_v").alias("b"))
    a, b = F.col("a"), F.col("b")
    met = mine.unionByName(other).groupBy(key, "_w").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = {"n_a": a, "n_b": b, "n_and": a.bitwiseAND(b), "n_or": a.bitwiseOR(b)}
    return met.groupBy(key).agg(*(F.sum(F.bit_count(v).cast("long")).alias(n) for n, v in counts.items())).filter("n_a > 0 and n_b > 0")


def pack_bits(df: DataFrame, key: str, bit: str) -> DataFrame:
    """(key, words): set bits of each key as 63-bit words, the lowest first, up to its highest bit."""
    words = bit_words(df, key, bit)
    m = words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_w", "_v"))).alias("_m"), F.max("_w").alias("_top"))
    return m.select(key, F.transform(F.sequence(F.lit(0).cast("long"), "_top"), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long"))).alias("words"))
