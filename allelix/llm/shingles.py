"""Near copies by the similarity of five-word shingles, for the pipeline's near-duplicate stage.

SimHash links what differs in few bits; copies with more edits are found here.  A
text's set of shingle hashes gives 64 minima, in 16 bands of 4.  Texts that agree
in a band are candidates (a pair of similarity 0.8 agrees in none with probability
2e-4), those whose 64 minima agree in too few are left out (3e-5 of such pairs), and
the others are linked if the similarity of their whole sets is 0.8 or more.

Links are only wanted for the classes that they make, so a large group of near
copies must not cost all its pairs.  In a first round each text is compared with its
next neighbours in every bucket, buckets sorted by the minima in an order of the
band's own: a few pairs for each text, whatever the size of its buckets.  What this
links becomes classes.  In the second round only pairs of different classes that
share a bucket are compared; buckets of one class, which those of large groups have
become, are left out before any pair is made.  No candidate pair that could join
two classes is passed over, but pairs are looked at where their rows lie and only
links that join classes leave a task.  Texts that agree in most minima, yet have less
than the similarity wanted and no link by way of others, are still all compared.

Scale: sets are named by 64-bit hashes, which a false merge takes to be equal.  The
first round deals rows by range, so that a hot bucket spreads over tasks; the second
deals a bucket over tiles of at most two blocks of ``PART`` rows, so that a task holds
a bounded number of sets.

Defined results: words are parted and lower-cased as by SimHash; fewer than five
words are one shingle; a text without words has no name and no link; ids are carried
along, null or repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NONSPACE, Roller, mix, ranges, stored, text_blocks, word_spans
from .simhash import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
#: Least share of equal minima of a pair whose sets are compared.
MAYBE = 0.6
CHUNK = 4096
#: Next rows that a row is compared with in the first round, and rows of a block in the second.
NEXT, PART = 2, 2048
_RNG = np.random.default_rng(42)
_A = _RNG.integers(1, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 2**64, BANDS * ROWS, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**64, max(SHINGLE, ROWS), dtype=np.uint64) | np.uint64(1)


def sets_of(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> Iterator[np.ndarray]:
    """The sorted, distinct shingle hashes of each text; none if it has no words."""
    starts, ends, first = word_spans(data, offsets, NONSPACE)
    names = roller.spans(roller.prefix(data), starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        k = min(SHINGLE, b - a)
        total = np.zeros(b - a - k + 1 if k else 0, np.uint64)
        for j in range(k):
            total += names[a + j : a + j + len(total)] * _PLACE[j]
        yield np.unique(mix(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the 64 permutations over a set."""
    out = np.full(len(_A), 2**64 - 1, np.uint64)
    for a in range(0, len(hashes), CHUNK):
        np.minimum(out, (hashes[a : a + CHUNK, None] * _A + _B).min(0), out)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, name of the set, band keys, a byte of each minimum); null name for no words."""
    roller, names = Roller(fold=LOWER), ["doc_id", "name", "bands", "sketch"]
    kinds = [pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1)):
            rows = []
            for hashes in sets_of(data, offsets, roller):
                if len(hashes):
                    m = minima(hashes)
                    bands = mix((m.reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                    rows.append((_name(hashes), bands.tobytes(), mix(m).astype(np.uint8).tobytes()))
                else:
                    rows.append((None, None, None))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, name, bands, sketch) of every document; doc_id is of any type."""
    texts = docs.select("doc_id", "text")
    return texts.mapInArrow(_sketches, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, name long, bands binary, sketch binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, bands, sketch) to a row for each band; its sketch begins with the minima of the next band."""
    for batch in batches:
        if batch.num_rows:
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, BANDS)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            for k in range(BANDS):
                turned = pa.array([x.tobytes() for x in np.roll(sketch, -ROWS * (k + 1), 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bands[:, k]), batch.column(0), turned], ["key", "name", "sketch"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1) >= MAYBE


def _grid(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _pair(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, sketch) to pairs of near rows of a key whose minima agree often enough."""
    key, name, sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.uint8)
    for batch in batches:
        old = len(key)
        key, name = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([name, batch.column(1).to_numpy()])
        sketch = np.concatenate([sketch, _grid(batch.column(2))])
        for d in range(1, NEXT + 1):
            x = np.arange(max(old - d, 0), len(key) - d)
            x = x[key[x] == key[x + d]]
            x = x[_alike(sketch[x], sketch[x + d])]
            yield _pair(name[x], name[x + d])
        key, name, sketch = key[-NEXT:], name[-NEXT:], sketch[-NEXT:]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(key, part, its rows), of rows (key, part, ...) that come part after part."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
            if held and last != (key[a], part[a]):
                yield *last, pa.Table.from_batches(held)
                held = []
            last = (key[a], part[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield *last, pa.Table.from_batches(held)


def _sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(rows of the smaller side, those of the other, root, sketch, whether both are the same rows)."""
    first, root = tile.column("first").to_numpy(), tile.column("root").to_numpy()
    sketch = _grid(tile.column("sketch"))
    one = bool(first.all())
    x, y = np.flatnonzero(first), np.arange(len(first)) if one else np.flatnonzero(~first)
    return (*((x, y) if len(x) <= len(y) else (y, x)), root, sketch, one)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, name, root, sketch, first) of tiles to those that may have a like of another class in their tile."""
    for _, _, tile in _tiles(batches):
        x, y, root, sketch, _ = _sides(tile)
        keep = np.zeros(len(root), bool)
        for k in x.tolist():
            other = y[root[y] != root[k]]
            other = other[_alike(sketch[other], sketch[k])]
            keep[other] = True
            keep[k] |= len(other) > 0
        yield from tile.filter(pa.array(keep)).combine_chunks().to_batches()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tiles with their sets to links (a, b) of rows whose sets are similar; a link of what is connected already is left out."""
    for _, _, tile in _tiles(batches):
        x, y, label, sketch, one = _sides(tile)
        name, sets = tile.column("name").to_numpy(), [np.frombuffer(v, np.uint64) for v in tile.column("hashes").to_pylist()]
        size = np.array([len(v) for v in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)])
        label, mine, a, b = label.copy(), np.zeros(len(known), bool), [], []
        for k in x.tolist():
            other = y[(label[y] != label[k]) & ((y > k) | (not one))]
            other = other[_alike(sketch[other], sketch[k])]
            if not len(other):
                continue
            mine[flat[start[k] : start[k + 1]]] = True
            both = mine[flat[np.repeat(start[other], size[other]) + ranges(size[other])]]
            both = np.add.reduceat(both.astype(np.int64), np.cumsum(size[other]) - size[other])
            mine[flat[start[k] : start[k + 1]]] = False
            for n in other[both >= SIMILAR * (size[k] + size[other] - both)].tolist():
                if label[n] != label[k]:
                    a.append(name[k])
                    b.append(name[n])
                    label[label == label[n]] = label[k]
        yield _pair(np.array(a, np.int64), np.array(b, np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wanted name, text) to (name, set), for texts that have that name."""
    roller = Roller(fold=LOWER)
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1)):
            for name, hashes in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), sets_of(data, offsets, roller)):
                if len(hashes) and _name(hashes) == name:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([hashes.tobytes()], pa.binary())], ["name", "hashes"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = lambda k: [np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()]  # noqa: E731, B023
        good = pa.array([similarity(x, y) >= SIMILAR for x, y in zip(read(2), read(3))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])


def _sets_of(names: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(name, hashes) of the sets with these names."""
    spark = docs.sparkSession
    ids = stored(spark, reps.select("name", "doc_id").join(names, "name"), "wanted")
    # Texts are dealt by id at every size, and the ids' side is the one that is held.
    sets = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id").select("name", "text").mapInArrow(_sets, "name long, hashes binary")
    return stored(spark, sets.groupBy("name").agg(F.first("hashes").alias("hashes")), "sets")


def _similar(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of names whose whole sets have a similarity of ``SIMILAR`` or more."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), docs, reps)
    side = lambda end: sets.select(F.col("name").alias(end), F.col("hashes").alias(f"{end}_hashes"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_hashes", "b_hashes")
    return stored(docs.sparkSession, rows.mapInArrow(_verified, "a long, b long"), "similar")


def _dealt(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows (key, name, sketch, root) of mixed buckets to tiles: (key, part, name, root, sketch, first).

    The rows of the bucket's most frequent class, and the others, are dealt over blocks of
    about ``PART`` rows.  A tile is a pair of blocks, one of others at least; ``first`` marks
    the rows of its first block (all rows, where a block meets itself).
    """
    part = lambda i, j: F.shiftleft(i.cast("long"), 31) + j
    row = rows.join(mixed, "key").withColumn("h", F.xxhash64("name")).withColumn("main", F.col("root") == F.col("top"))
    row = row.withColumn("block", F.when(F.col("main"), F.pmod("h", "mains")).otherwise(F.col("mains") + F.pmod("h", "others")).cast("long"))
    tile = lambda c, first: F.struct(part(F.least("block", c), F.greatest("block", c)).alias("part"), first.alias("first"))
    own, lead = F.col("block"), F.lit(0).cast("long")
    rest = F.transform(F.sequence("mains", F.col("mains") + F.col("others") - 1), lambda c: tile(c, own <= c))
    every = F.concat(F.transform(F.sequence(lead, F.col("mains") - 1), lambda c: tile(c, own <= c)), rest)
    row = row.select("key", F.explode(F.when(F.col("main"), rest).otherwise(every)).alias("t"), "name", "root", "sketch")
    return row.select("key", "t.part", "name", "root", "sketch", "t.first")


def similar_pairs(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(a, b): links of names whose classes are those of all links by similarity.

    ``sketched`` is what ``sketches`` gives for ``docs``; the ids of ``docs`` are not null.
    """
    spark = docs.sparkSession
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    named = sketched.filter("name is not null")
    reps = named.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = stored(spark, reps, "reps")
    rows = stored(spark, reps.select("name", "bands", "sketch").mapInArrow(_banded, "key long, name long, sketch binary"), "banded")
    crowd = stored(spark, rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "crowd")
    rows = stored(spark, rows.join(crowd, "key").select("key", "name", "sketch"), "shared")
    near = rows.repartitionByRange(ways, "key", "sketch").sortWithinPartitions("key", "sketch").mapInArrow(_neighbours, "a long, b long")
    first = _similar(stored(spark, near.distinct(), "near"), docs, reps)
    roots = components(first).withColumnRenamed("node", "name")
    rows = rows.join(roots, "name", "left").select("key", "name", "sketch", F.coalesce("root", "name").alias("root"))
    rows = stored(spark, rows, "classed")
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    mixed = counts.agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("classes")).filter("classes > 1")
    blocks = lambda n: (n / PART).cast("long") + 1
    mixed = mixed.select("key", F.col("top.root").alias("top"), blocks(F.col("top.n")).alias("mains"), blocks(F.col("n") - F.col("top.n")).alias("others"))
    kind = "key long, part long, name long, root long, sketch binary, first boolean"
    tiles = _dealt(rows, stored(spark, mixed, "mixed")).repartition(ways, "key", "part").sortWithinPartitions("key", "part")
    tiles = stored(spark, tiles.mapInArrow(_likely, kind), "tiles")
    sets = _sets_of(tiles.select("name").distinct(), docs, reps)
    tiles = tiles.join(sets, "name").select("key", "part", "name", "root", "sketch", "first", "hashes")
    tiles = tiles.repartition(ways, "key", "part").sortWithinPartitions("key", "part")
    return first.unionByName(stored(spark, tiles.mapInArrow(_joined, "a long, b long"), "joined"))
