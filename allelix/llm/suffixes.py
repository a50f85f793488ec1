"""Operator 2: exact removal of repeated byte strings, by difference-cover blockwise sorting.

A byte goes if a ``LENGTH``-byte string over it also starts anywhere else.  Sorting
all suffixes would need a multiple of the corpus, so suffixes are looked at one
bucket at a time, and most are settled by a difference-cover sample:

* ``COVER`` is a difference cover modulo ``PERIOD``: for any two positions there is
  a shift below ``PERIOD`` that takes both into the sample.  Two equal strings of
  ``LENGTH`` bytes hence hold sample suffixes, equally shifted, that agree on
  ``SHORT`` = LENGTH - PERIOD + 1 bytes.
* Pass 1 ranks sample suffixes by their first SHORT bytes: which occur twice?
* Pass 2 resolves long ties: sample suffixes that tie are ranked by LONG = LENGTH +
  PERIOD - 1 bytes (or up to the end of the text).  Ties there settle all of the
  next PERIOD positions at once, without sorting any of them.
* Pass 3 sorts what is left by LENGTH bytes: positions with a tied sample suffix
  within reach that no rank has settled, which are those near the ends of repeats.
  Their like may be a settled position, so of each settled string of pass 2 one
  occurrence, the owner's, is sorted with them.

Ranks are needed for equality alone, so strings are sorted by 64-bit names (hashes;
two different strings share one with a probability of about 2**-62) instead of by letters.

Scale: texts are packed into units of about ``UNIT`` bytes, written once as a table
bucketed by unit.  In each pass a unit sends every distinct name once, by bucket of
the names' leading bits; a bucket is sorted by itself, and answers each unit with a
bitmap.  Frequent strings thus cost one name for a unit, copies inside a unit none,
and a bucket's size is set by the number of buckets, which follows the input.
Bitmaps join the bucketed units without moving the texts again.

Defined results: a null text is empty; a text below LENGTH bytes loses nothing;
repeated rows repeat each other's text and lose it; ids may be null or repeat, as
rows are told apart by where they are packed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Roller, bound_batches, drop_path, give_back, known_bytes, stored, table_path, text_blocks

LENGTH = 200
PERIOD = 133
#: A perfect difference set: every difference modulo 133 but 0 occurs exactly once.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SHORT, LONG = LENGTH - PERIOD + 1, LENGTH + PERIOD - 1
UNIT = 1 << 20
#: Names sorted in one bucket, about; tasks that buckets are dealt over, at most (each takes its buckets one after the other).
BUCKET_NAMES, MOST_TASKS = 1 << 19, 1 << 14
#: Bytes of units in one bucket of their table, about.
TASK_BYTES = 128 << 20
TRUNCATED = np.uint64(0xA0761D6478BD642F)
UNITS = "unit long, n_bytes long, ids array<long>, offsets binary, body binary"
NAMES = "bucket int, unit long, names binary"
BITS = "unit long, bucket int, bits binary, own binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(1)
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1), UNIT):
            columns = [
                pa.array([part << 32 | seq]), pa.array([len(data)]), pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                pa.array([offsets.astype("<i8").tobytes()]), pa.array([pack.compress(data.tobytes())]),
            ]
            seq += 1
            yield pa.RecordBatch.from_arrays(columns, ["unit", "n_bytes", "ids", "offsets", "body"])


class Names:
    """Distinct names of one pass in a unit, sorted; the bucket of a name is its leading bits."""

    def __init__(self, values: np.ndarray, bits: int, keep: int):
        drop = np.uint64(64 - min(64, bits + 8 * keep))
        self.bits, self.keep = bits, keep
        self.distinct, self.at, self.inverse, count = np.unique(values >> drop, return_index=True, return_inverse=True, return_counts=True)
        self.repeated = count > 1
        bucket = self.distinct >> np.uint64(min(64, bits + 8 * keep) - bits) if bits else np.zeros(len(self.distinct), np.uint64)
        self.cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)) if len(bucket) else np.zeros((1 << bits) + 1, np.int64)

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, the last ``keep`` bytes of its names) of each bucket that has names."""
        octets = self.distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.keep]
        for b in np.flatnonzero(np.diff(self.cuts)).tolist():
            lo, hi = self.cuts[b], self.cuts[b + 1]
            yield b, octets[lo:hi].tobytes()

    def flags(self, answers: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(for each value, whether its name occurs twice, in the unit or elsewhere; one value for each such name that the unit owns)."""
        twice, own = self.repeated.copy(), self.repeated.copy()
        for b, bits, owned in answers:
            lo, hi = self.cuts[b], self.cuts[b + 1]
            there = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
            twice[lo:hi] |= there
            own[lo:hi] = np.where(there, np.unpackbits(np.frombuffer(owned, np.uint8), count=hi - lo).astype(bool), own[lo:hi])
        return twice[self.inverse], self.at[own]


#: Bytes of a name that are sent beside its bucket: fewer where a false tie only costs a closer look.
KEEP = (5, 8, 7)


class Unit:
    """A unit's texts and, pass by pass, what is known of its positions."""

    def __init__(self, offsets: bytes, body: bytes, roller: Roller, bits: list[int]):
        self.offsets = np.frombuffer(offsets, "<i8")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        self.roller, self.bits = roller, bits
        self.prefix = roller.prefix(self.data)
        size = np.diff(self.offsets)
        grid = []
        for a, n in zip(self.offsets[:-1].tolist(), size.tolist()):
            if n >= LENGTH:
                steps = np.arange(0, n - SHORT + 1, PERIOD)[:, None] + np.array(COVER)
                steps = steps.ravel()
                grid.append(a + steps[: np.searchsorted(steps, n - SHORT, "right")])
        self.sample = np.concatenate(grid) if grid else np.zeros(0, np.int64)

    def first(self) -> Names:
        return Names(self.roller.spans(self.prefix, self.sample, self.sample + SHORT), self.bits[0], KEEP[0])

    def _end(self, at: np.ndarray) -> np.ndarray:
        return self.offsets[np.searchsorted(self.offsets, at, "right")]

    def second(self, answers: dict) -> Names:
        ranks = self.first()
        self.tied = self.sample[ranks.flags(answers.get(0, []))[0]]
        end = self._end(self.tied)
        stop = np.minimum(self.tied + LONG, end)
        names = self.roller.spans(self.prefix, self.tied, stop)
        return Names(np.where(stop < self.tied + LONG, names ^ TRUNCATED, names), self.bits[1], KEEP[1])

    def third(self, answers: dict) -> Names:
        ranks = self.second(answers)
        tied_again, owned = ranks.flags(answers.get(1, []))
        self.twice = self._covered(self.tied[tied_again])
        owned = self._covered(self.tied[owned])
        begin = self.offsets[np.searchsorted(self.offsets, self.tied, "right") - 1]
        edge = np.zeros(len(self.data) + 1, np.int32)  # a tied sample suffix is in reach of its own position and the PERIOD - 1 before it
        np.add.at(edge, np.maximum(self.tied - PERIOD + 1, begin), 1)
        np.add.at(edge, self.tied + 1, -1)
        reach = np.cumsum(edge[:-1]) > 0
        self.open = np.flatnonzero(reach & ~self.twice | owned)
        self.open = self.open[self.open + LENGTH <= self._end(self.open)]
        return Names(self.roller.spans(self.prefix, self.open, self.open + LENGTH), self.bits[2], KEEP[2])

    def _covered(self, samples: np.ndarray) -> np.ndarray:
        """The PERIOD positions from each sample suffix on, as far as a string fits the text."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, samples, 1)
        np.add.at(edge, np.maximum(np.minimum(samples + PERIOD, self._end(samples) - LENGTH + 1), samples), -1)
        return np.cumsum(edge[:-1]) > 0

    def removed(self, answers: dict) -> np.ndarray:
        """Which bytes go."""
        names = self.third(answers)
        self.twice[self.open[names.flags(answers.get(2, []))[0]]] = True
        n = len(self.data)
        at = np.flatnonzero(self.twice)
        edge = np.zeros(n + 1, np.int32)
        edge[at] += 1  # positions are distinct
        edge[at + LENGTH] -= 1
        return np.cumsum(edge[:n]) > 0


def _by_pass(answers) -> dict:
    out: dict = {}
    for a in answers or ():
        out.setdefault(a["step"], []).append((a["bucket"], a["bits"], a["own"]))
    return out


def _send(step: int, bits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                unit = Unit(row["offsets"].as_py(), row["body"].as_py(), roller, bits)
                answers = _by_pass(row["answers"].as_py()) if "answers" in row else {}
                names = unit.first() if step == 0 else unit.second(answers) if step == 1 else unit.third(answers)
                sent = list(names.payloads())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in sent], pa.int32()), pa.array([row["unit"].as_py()] * len(sent), pa.int64()), pa.array([p for _, p in sent], pa.binary())],
                    ["bucket", "unit", "names"],
                )
                del unit, names, sent
            give_back()

    return run


def _sort_buckets(keep: int):
    """Rows of a task come bucket after bucket; each bucket is sorted by itself."""

    def answer(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        names = []
        for _, p in rows:
            wide = np.zeros((len(p) // keep, 8), np.uint8)
            wide[:, :keep] = np.frombuffer(p, np.uint8).reshape(-1, keep)
            names.append(wide.view("<u8").ravel())
        flat = np.concatenate(names)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        first = np.ones(len(flat), bool)
        first[order[1:][same]] = False
        units, bits, own, at = [], [], [], 0
        for (unit, _), x in zip(rows, names):
            mine, led = twice[at : at + len(x)], first[at : at + len(x)]
            at += len(x)
            if mine.any():
                units.append(unit)
                bits.append(np.packbits(mine).tobytes())
                own.append(np.packbits(mine & led).tobytes())
        columns = [pa.array(units, pa.int64()), pa.array([bucket] * len(units), pa.int32()), pa.array(bits, pa.binary()), pa.array(own, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["unit", "bucket", "bits", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for b, u, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != bucket and rows:
                    yield answer(bucket, rows)
                    rows = []
                bucket = b
                rows.append((u, p))
        if rows:
            yield answer(bucket, rows)
        rows = None
        give_back()

    return run


def _finish(bits: list[int], with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                unit = Unit(row["offsets"].as_py(), row["body"].as_py(), roller, bits)
                gone = unit.removed(_by_pass(row["answers"].as_py()))
                off = unit.offsets
                before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
                before[off[:-1][off[:-1] < len(gone)]] = False
                count = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[off])
                n_gone, n_runs, size = count(gone), count(gone & ~before), np.diff(off)
                body = unit.data[~gone].tobytes()
                cut = np.concatenate([[0], np.cumsum(size - n_gone)]).tolist()
                kept = [body[a:b] for a, b in zip(cut[:-1], cut[1:])]
                columns = [
                    pa.array(row["ids"].as_py(), pa.int64()), pa.array(size), pa.array(n_gone), pa.array(n_runs),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_kept:
                    columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names)
                del unit, gone, before, kept, body, columns
            give_back()

    return run


class _Units:
    """The bucketed table of units, in the shared folder until closed."""

    def __init__(self, docs: DataFrame):
        self.spark: SparkSession = docs.sparkSession
        self.ways = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), (known_bytes(docs) or 0) // TASK_BYTES)
        self.name, self.path = f"units_{uuid.uuid4().hex}", table_path(self.spark, "units")
        bound_batches(self.spark)
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
        rows = source.mapInArrow(_units, UNITS).repartition(self.ways, "unit")
        rows.write.bucketBy(self.ways, "unit").option("path", self.path).option("compression", "uncompressed").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document, and ``kept`` bytes where asked for."""
    spark = docs.sparkSession
    units = _Units(docs)
    try:
        total = units.table().agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).collect()[0]["n"]
        # Names expected: the sample's, those of ties, and of open positions (each at most all of its kind).
        expected = (total * len(COVER) // PERIOD, total * len(COVER) // PERIOD // 2, total // 8)
        bits = [max(0, (n // BUCKET_NAMES).bit_length()) for n in expected]
        answers = None
        for step in range(3):
            rows = units.table().select("unit", "offsets", "body")
            if answers is not None:
                rows = rows.join(_gathered(answers).hint("shuffle_hash"), "unit", "left")
            sent = rows.mapInArrow(_send(step, bits), NAMES)
            tasks = min(1 << bits[step], MOST_TASKS)
            dealt = sent.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket")
            found = stored(spark, dealt.mapInArrow(_sort_buckets(KEEP[step]), BITS).withColumn("step", F.lit(step)), f"ranks_{step}")
            answers = found if answers is None else answers.unionByName(found)
        rows = units.table().select("unit", "ids", "offsets", "body").join(_gathered(answers).hint("shuffle_hash"), "unit", "left")
        return stored(spark, rows.mapInArrow(_finish(bits, with_kept), RESULT + (", kept binary" if with_kept else "")), "kept")
    finally:
        units.close()


def _gathered(answers: DataFrame) -> DataFrame:
    """One row for each unit: at most a bit for each of its names, so its size is bounded by the unit's."""
    return answers.groupBy("unit").agg(F.collect_list(F.struct("step", "bucket", "bits", "own")).alias("answers"))
