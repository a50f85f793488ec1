"""Operator 4: benchmark decontamination by winnowing.

Words of items and documents become hashes; of every ``WINDOW_GRAMS`` consecutive
k-grams the smallest hash is kept as a fingerprint, so a shared span of 13 = ``K +
WINDOW_GRAMS - 1`` words always shares a fingerprint.  Fingerprints of documents and
items are joined.  Each hit is extended to all 13-word windows that hold it, and a
window counts if an item has one of the very same words: windows are joined by 128
bits of the SHA-256 of their words, never by the fingerprints' hashes.  Items shorter
than 13 words are one window each; n-grams of their own length find them, for
which winnowing gives no guarantee.

Scale: what a document's text says does not depend on its id, so texts are known by
the SHA-256 of their content, and copies meet as one text after the first pass.  That
pass sends a row for each document, with the fingerprints that pass a sieve: a bitmap
of the benchmark's fingerprints of at most ``SIEVE_BITS`` bits, whatever its size.
Everything else is joins of tables, of documents with hits only; neither a document's
nor an item's text passes the driver.

Defined results: a null or empty text has no words, hits nothing and is not
contaminated; an empty benchmark hits nothing; repeated items with the same id
count once; repeated documents each give a row; item ids that are null are
ignored; ids of documents may be null, repeat or be of any type that Arrow has; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Roller, mix, stored, text_blocks, word_spans

SPAN_WORDS = 13
K = 7
WINDOW_GRAMS = SPAN_WORDS - K + 1
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
SIEVE_BITS = 26
PRINTS = "array<struct<fp:long,at:int,n:int>>"
SPANS = "array<struct<start:int,stop:int>>"
_PRINT = pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= GRAM_BASE
        out += words[j : j + n]
    return out ^ (out >> np.uint64(29))


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the rightmost smallest hash in each window of ``width``; one window at least."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    width = min(width, n)
    m = n - width + 1
    best, at = hashes[:m].copy(), np.arange(m)
    for j in range(1, width):
        less = hashes[j : j + m] <= best
        best[less] = hashes[j : j + m][less]
        at[less] = np.flatnonzero(less) + j
    keep = np.ones(m, bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep]


def fingerprints(words: np.ndarray, first: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, fingerprint, first word in the block, words) of texts back to back; ``first`` are the positions at which they start, and the end.

    All texts of a block at once: a window within one text gives the same position as
    if the text were alone, and grams that reach into the next text are left out.
    """
    out = []
    for n in [K, *short]:
        h = grams(words, n)
        at = winnow(h, WINDOW_GRAMS) if not out else np.arange(len(h))
        text = np.searchsorted(first, at, "right") - 1
        inside = at + n <= first[text + 1]
        at, text = at[inside], text[inside]
        fp = h[at] if not out else mix(h[at] + np.uint64(n))  # whole items of n words have fingerprints of their own
        out.append((text, fp, at, np.full(len(at), n if out else SPAN_WORDS)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


class Words:
    """The lower-cased words of one text, and digests of windows of them."""

    def __init__(self, text: str | None):
        data = np.frombuffer((text or "").encode(), np.uint8)
        s, e, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
        body = LOWER[data].tobytes()
        self.flat = b" ".join([body[a:b] for a, b in zip(s.tolist(), e.tolist())])
        self.ends = np.cumsum(e - s + 1) - 1
        self.starts = self.ends - (e - s)

    def __len__(self) -> int:
        return len(self.starts)

    def digest(self, start: int, n: int) -> bytes:
        return hashlib.sha256(self.flat[self.starts[start] : self.ends[start + n - 1]]).digest()[:16]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, words if it is short, its fingerprints, digests of its windows)."""
    roller = Roller(fold=LOWER)
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = Words(text)
            if not len(w):
                continue
            data, n = np.frombuffer(w.flat, np.uint8), min(len(w), SPAN_WORDS)
            names = roller.spans(roller.prefix(data), w.starts, w.ends)
            if n < SPAN_WORDS:
                prints = mix(grams(names, n) + np.uint64(n))
            else:
                h = grams(names, K)
                prints = np.unique(h[winnow(h, WINDOW_GRAMS)])
            rows.append((item, n, prints.view(np.int64).tolist(), list({w.digest(k, n) for k in range(len(w) - n + 1)})))
        if rows:
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["item", "n", "prints", "windows"])


def _scan(sieve, bits: int, short: list[int]):
    """The function from (id, key, text) to (id, key, n_words, prints that pass the sieve)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, table = Roller(fold=LOWER), np.frombuffer(sieve.value, np.uint64)
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                s, e, first = word_spans(data, offsets, ALNUM)
                words = roller.spans(roller.prefix(data), s, e)
                text, fp, at, n = fingerprints(words, first, short)
                b = fp >> np.uint64(64 - bits)
                good = np.flatnonzero(table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1))
                good = good[np.argsort(text[good], kind="stable")]
                text, fp, at, n = (x[good] for x in (text, fp, at, n))
                parts = [pa.array(fp.view(np.int64)), pa.array((at - first[text]).astype(np.int32)), pa.array(n.astype(np.int32))]
                edge = np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)
                prints = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(parts, fields=list(_PRINT)))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), prints]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n_words", "prints"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, hits) to (key, start, stop, digest) of the windows that hold a hit."""
    for batch in batches:
        for key, text, hits in zip(*(batch.column(k).to_pylist() for k in range(3))):
            w, at = Words(text), set()
            for h in hits:
                if h["n"] < SPAN_WORDS:
                    at.add((h["at"], h["n"]))
                else:
                    at |= {(k, SPAN_WORDS) for k in range(max(0, h["at"] - WINDOW_GRAMS + 1), min(h["at"], len(w) - SPAN_WORDS) + 1)}
            at = sorted(at)
            columns = [
                pa.array([key] * len(at), pa.binary()), pa.array([a for a, _ in at], pa.int32()), pa.array([a + n for a, n in at], pa.int32()),
                pa.array([w.digest(a, n) for a, n in at], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "stop", "window"])


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; a null text is empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _covered(spans: Column) -> Column:
    """Words in the union of spans (start, stop)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["end"]))
        return F.struct(F.greatest(acc["end"], x["stop"]).alias("end"), (acc["total"] + new).alias("total"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["total"]).cast("long")


def _sieve(prints: DataFrame):
    """(broadcast bitmap of the leading bits of fingerprints, number of these bits); at most 2**SIEVE_BITS bits."""
    bits = min(SIEVE_BITS, max(10, (16 * prints.count()).bit_length()))
    lead = prints.select(F.shiftrightunsigned("fp", 64 - bits).alias("b"))
    words = lead.groupBy(F.shiftrightunsigned("b", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return prints.sparkSession.sparkContext.broadcast(table.tobytes()), bits


def decontaminate(docs: DataFrame, benchmark: DataFrame, ratio: int = 20, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_full, n_items, items, contaminated) for each document.

    ``n_full`` are the hit words in windows of 13 words (not in shorter items).  A document
    is contaminated if its hit words are at least 1/``ratio`` of its words.  ``key`` is the
    ``text_key`` of its text.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).filter("item is not null").distinct()
    bench = stored(spark, bench.mapInArrow(_items, "item string, n int, prints array<long>, windows array<binary>"), "bench")
    prints = bench.select(F.explode("prints").alias("fp")).distinct()
    short = [r["n"] for r in bench.select("n").filter(F.col("n") < SPAN_WORDS).distinct().orderBy("n").collect()]  # at most 12
    sieve, bits = _sieve(prints)
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col("text")).alias("key"), F.col("text").alias("text"))
    kind = f"id {texts.schema['id'].dataType.simpleString()}, key binary, n_words long, prints {PRINTS}"
    scanned = stored(spark, texts.mapInArrow(_scan(sieve, bits, short), kind), "scanned")
    # Copies are one text from here on.
    hits = scanned.filter(F.size("prints") > 0).select("key", F.explode("prints").alias("p")).select("key", "p.*").distinct()
    hits = hits.join(prints, "fp", "left_semi").groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    hits = stored(spark, hits, "hits")  # its size is known when the join is planned: texts are only moved if it is large
    windows = texts.select("key", "text").join(hits, "key").mapInArrow(_windows, "key binary, start int, stop int, window binary").distinct()
    found = windows.join(bench.select("item", F.explode("windows").alias("window")).distinct(), "window")
    found = found.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    full = F.filter("spans", lambda s: s["stop"] - s["start"] == SPAN_WORDS)
    found = found.select("key", _covered(F.col("spans")).alias("n_hit"), _covered(full).alias("n_full"), "items")
    none = [F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_full"), F.array().cast("array<string>").alias("items")]
    rest = scanned.filter(F.size("prints") == 0).select("id", "key", "n_words", *none)
    near = scanned.filter(F.size("prints") > 0).select("id", "key", "n_words").join(stored(spark, found, "found"), "key", "left")
    near = near.select("id", "key", "n_words", *(F.coalesce(c, x).alias(c) for c, x in zip(("n_hit", "n_full", "items"), none)))
    return rest.unionByName(near).select(
        F.col("id").alias("doc_id"), "key", "n_words", "n_hit", "n_full", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any 13-word window of an item, and without short items for a twentieth of their words.

    Rows are judged by their text, so ids may be null or repeat; all columns come back as they were.
    """
    rows = docs.select(F.struct("*").alias("row"))
    found = decontaminate(docs.select(F.lit(0).alias("doc_id"), "text"), benchmark)
    bad = stored(docs.sparkSession, found.filter("n_full > 0 or contaminated").select("key").distinct(), "bad")
    return rows.withColumn("key", text_key(F.col("row.text"))).join(bad, "key", "left_anti").select("row.*")
