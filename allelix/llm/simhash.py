"""Operator 5: near duplicates by SimHash, probed by the generalised pigeonhole.

Fingerprints of 64 bits come from XXH64 of 3-word shingles.  Two fingerprints
with at most ``TAU`` differing bits are linked.  Correlated bits are grouped into
the same partition; partition i gets a threshold t_i with sum(t_i + 1) = TAU + 1,
so that some partition of any linked pair differs in at most t_i bits (-1: the
partition is not probed).  A dynamic programme picks the thresholds with the
fewest expected candidates, from exact counts over all fingerprints: histograms
of the 2**16 values of a partition, turned by a Walsh-Hadamard transform into the
number of pairs at each distance.

Candidates share a bucket (partition, value).  A bucket is verified in place and
gives back only a spanning forest of its links, so a group of n near copies costs
n rows and not n * n.  Buckets above ``HOT`` members are split by further
pigeonholes over the bits that are left, again and again while parts are above it,
so that no task holds more than ``HOT`` rows of a bucket; inside a task, runs above
``SMALL`` rows are split in the same way before their members are compared.
Components come from repeated hooking and pointer jumping on stored edge tables;
nothing of the size of the corpus reaches the driver.

Defined results: a null or empty text, or one without words, has fingerprint 0,
linked like any other; fewer than three words are one shingle; repeated rows each
give a row.  Distinct fingerprints are what is linked, so rows without an id, and
fingerprints that only such rows have, link like others; the component of a row is
the smallest id that is not null in it, null where there is none.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, stored, text_blocks

TAU = 3
PARTS, WIDTH = 4, 16
HOT, SMALL = 1 << 17, 256
SHINGLE = 3
_LOWER = LOWER.tobytes()
CHUNK = 1 << 18
#: Splits of a hot bucket; the bits left shrink by a quarter each time, from 48.
LEVELS = 4


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, with repeats of shingles counted."""
    words = text.translate(_LOWER).split()  # bytes.split parts at \x20 and \x09-\x0D
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    count = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for a in range(0, len(starts), CHUNK):
        values = [h(flat[x:y], seed) for x, y in zip(starts[a : a + CHUNK].tolist(), ends[a : a + CHUNK].tolist())]
        octets = np.array(values, np.uint64).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = count * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed 64-bit integer, doc_id of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                body = data.tobytes()
                fps = np.array([fingerprint(body[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    texts = docs.select("doc_id", "text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp long")


def _bit_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], ["i", "j", "n"])


def group_bits(joint: np.ndarray, n: int) -> list[list[int]]:
    """Four groups of 16 bits, each grown from its most correlated pair by mean correlation."""
    mean = np.diag(joint) / max(n, 1)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((joint / max(n, 1) - np.outer(mean, mean)) / np.outer(sd, sd))
    np.fill_diagonal(corr, -1)
    free, groups = set(range(64)), []
    while free:
        f = sorted(free)
        sub = corr[np.ix_(f, f)]
        a, b = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [f[a], f[b]]
        while len(group) < WIDTH:
            rest = [x for x in f if x not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].mean(1).argmax())])
        groups.append(sorted(group))
        free -= set(group)
    return groups


def pairs_by_distance(histogram: np.ndarray) -> np.ndarray:
    """Pairs of rows whose values differ in d bits, for each d, from counts by value."""
    a, step = histogram.astype(float).copy(), 1
    while step < len(a):
        a = a.reshape(-1, 2, step)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], 1).reshape(-1)
        step *= 2
    a, step = a * a, 1
    while step < len(a):
        a = a.reshape(-1, 2, step)
        a = np.stack([a[:, 0] + a[:, 1], a[:, 0] - a[:, 1]], 1).reshape(-1)
        step *= 2
    a /= len(a)
    a[0] -= histogram.sum()
    weight = np.bitwise_count(np.arange(len(a), dtype=np.uint32))
    return np.bincount(weight, a, WIDTH + 1) / 2


def allocate(pairs: list[np.ndarray], n: int, tau: int = TAU, row_cost: float = 40.0) -> list[int]:
    """Thresholds with sum(t + 1) = tau + 1 and the least cost: candidates to verify, and probes to shuffle."""
    reach = [sum(len(list(combinations(range(WIDTH), d))) for d in range(t + 1)) for t in range(tau + 1)]

    def cost(i: int, t: int) -> float:
        return 0.0 if t < 0 else float(pairs[i][: t + 1].sum()) + row_cost * n * (reach[t] + (t > 0))

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(pairs)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, tau + 1):
                u = used + t + 1
                if u <= tau + 1 and (u not in step or c + cost(i, t) < step[u][0]):
                    step[u] = (c + cost(i, t), [*ts, t])
        best = step
    return best[tau + 1][1]


def _take_bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.astype(np.int64)


def _signatures(groups: list[list[int]], thresholds: list[int]):
    """(fp) to (key, path, sub, fp, probe): a row for each bucket of a fingerprint; nothing is split yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            none = np.zeros(len(fp), np.int64)
            for i, (bits, t) in enumerate(zip(groups, thresholds)):
                if t < 0:
                    continue
                value = _take_bits(fp, bits)
                flips = [(0, False)] + [(sum(1 << b for b in c), True) for d in range(1, t + 1) for c in combinations(range(WIDTH), d)]
                for flip, probe in flips:
                    columns = [(i << 32) | (value ^ flip), none, none, fp.view(np.int64), np.full(len(fp), probe)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], BUCKET)

    return run


BUCKET = ["key", "path", "sub", "fp", "probe"]
BUCKETS = "key long, path long, sub long, fp long, probe boolean"


def _quarters(bits: list[int]) -> list[list[int]]:
    return [bits[k * len(bits) // PARTS : (k + 1) * len(bits) // PARTS] for k in range(PARTS)]


def _rest(groups: list[list[int]], key: int, path: int) -> list[int]:
    """Bits in which members of a bucket may differ, after the splits that ``path`` names (a digit of 1 to 4 for each)."""
    rest = [b for b in range(64) if b not in groups[key >> 32]]
    for k in range(len(oct(path)) - 3, -1, -1) if path else ():
        gone = _quarters(rest)[(path >> 3 * k & 7) - 1]
        rest = [b for b in rest if b not in gone]
    return rest


def _split(groups: list[list[int]]):
    """Hot buckets to their parts, by one more pigeonhole.

    The bits that are left fall into four groups: within TAU = 3 of each other, two
    members agree in at least one.  (Probe rows differ inside the partition
    only, which is allowed for by comparing whole fingerprints.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, path, sub, fp = (batch.column(k).to_numpy() for k in range(4))
            kind, which = np.unique(np.stack([key >> 32, path]), axis=1, return_inverse=True)
            for n, (i, p) in enumerate(kind.T.tolist()):
                rows = np.flatnonzero(which.ravel() == n)
                for k, bits in enumerate(_quarters(_rest(groups, i << 32, p))):
                    value = _take_bits(fp[rows].view(np.uint64), bits).view(np.uint64)
                    name = mix(mix(sub[rows].view(np.uint64) + np.uint64(8 * p + k + 1)) ^ value).view(np.int64)
                    taken = pa.array(rows)
                    columns = [batch.column(0).take(taken), pa.array(np.full(len(rows), 8 * p + k + 1)), pa.array(name), batch.column(3).take(taken), batch.column(4).take(taken)]
                    yield pa.RecordBatch.from_arrays(columns, BUCKET)

    return run


class Forest:
    """Spanning-forest edges of the links among rows; a link whose ends are connected already is not kept."""

    def __init__(self, fp: np.ndarray, probe: np.ndarray, tau: int):
        self.fp, self.probe, self.tau = fp, probe, tau
        nodes, self.node = np.unique(fp, return_inverse=True)  # an index row and a probe row of one fingerprint are one node
        self.parent = np.arange(len(nodes))
        self.a, self.b = [], []

    def _find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def _flatten(self) -> None:
        while not ((jump := self.parent[self.parent]) == self.parent).all():
            self.parent = jump

    def runs(self, rows: np.ndarray, run: np.ndarray) -> None:
        """Compares all rows of each run; rows at distance d for d = 1, 2, ..."""
        fp, probe = self.fp[rows], self.probe[rows]
        live, d = np.arange(len(rows) - 1), 1
        while len(live):
            live = live[live + d < len(rows)]
            live = live[run[live] == run[live + d]]
            link = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= self.tau]
            link = link[~(probe[link] & probe[link + d])]
            root = self.parent[self.node[rows]]
            link = link[root[link] != root[link + d]] if len(link) else link
            for x in link.tolist():
                p, q = self._find(self.node[rows[x]]), self._find(self.node[rows[x + d]])
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    self.a.append(fp[x])
                    self.b.append(fp[x + d])
            if len(link):
                self._flatten()
            d += 1

    def bucket(self, rows: np.ndarray, bits: list[int]) -> None:
        """All rows of one bucket, which may differ in ``bits`` (and, probes, in the bucket's own)."""
        if len(rows) <= SMALL:
            return self.runs(rows, np.zeros(len(rows), np.int8))
        if (self.parent[self.node[rows]] == self.parent[self.node[rows[0]]]).all():
            return None  # connected already
        fp = self.fp[rows]
        differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
        bits = [b for b in bits if differ >> b & 1]
        if len(bits) < PARTS:
            return self.runs(rows, np.zeros(len(rows), np.int8))
        for group in _quarters(bits):
            value = _take_bits(fp, group)
            order = np.argsort(value, kind="stable")
            run = np.concatenate([[0], np.cumsum(np.diff(value[order]) != 0)])
            size = np.bincount(run)
            small = size[run] <= SMALL
            self.runs(rows[order][small], run[small])
            for k in np.flatnonzero(size > SMALL).tolist():
                self.bucket(rows[order][run == k], [b for b in bits if b not in group])


def _verify(groups: list[list[int]], tau: int):
    """Rows sorted by bucket to spanning-forest edges (a, b) of the links inside the buckets."""

    def links(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, path, sub, fp, probe = rows
        forest = Forest(fp, probe, tau)
        run = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (path[1:] != path[:-1]) | (sub[1:] != sub[:-1]))])
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.concatenate([first, [len(run)]]))
        small = np.flatnonzero((size <= SMALL)[run])
        forest.runs(small, run[small])
        for k in np.flatnonzero(size > SMALL).tolist():
            at = first[k]
            forest.bucket(np.arange(at, at + size[k]), _rest(groups, int(key[at]), int(path[at])))
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (forest.a, forest.b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            cols[3] = cols[3].view(np.uint64)
            held.append(tuple(cols))
            if all(c[0] == c[-1] for c in cols[:3]):
                continue  # the bucket may go on
            rows = [np.concatenate(c) for c in zip(*held)]
            edge = np.any([c != c[-1] for c in rows[:3]], axis=0)
            cut = int(np.flatnonzero(edge)[-1]) + 1
            yield links(tuple(c[:cut] for c in rows))
            held = [tuple(c[cut:] for c in rows)]
        if held:
            yield links(tuple(np.concatenate(c) for c in zip(*held)))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that is not a root itself.

    Each round hooks nodes to their smallest neighbour, shortens the chains by
    pointer jumping, and contracts the edges.
    """
    spark = edges.sparkSession
    tidy = lambda e: e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, found = stored(spark, tidy(edges), "edges"), None
    while not edges.isEmpty():
        hook = stored(spark, edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hook")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer = hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            longer = stored(spark, longer, "hook")
            hook = longer.drop("moved")
            if longer.filter("moved").isEmpty():
                break
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if found is None:
            found = hook
        else:
            moved = found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            found = stored(spark, moved.unionByName(hook), "found")
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("root").alias(end), "above"), end, "left").withColumn(end, F.coalesce("above", end)).drop("above")
        edges = stored(spark, tidy(edges), "edges")
    return found if found is not None else spark.createDataFrame([], "node long, root long")


def links(fps: DataFrame, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """(a, b): spanning forests of the links among distinct fingerprints ``fp``; ``tau`` is at most 3 with four partitions."""
    spark = fps.sparkSession
    n = fps.count()
    joint = np.zeros((64, 64))
    for r in fps.select("fp").mapInArrow(_bit_matrix, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        joint[r["i"], r["j"]] = r["n"]
    groups = group_bits(joint, n)
    index = fps.select("fp").mapInArrow(_signatures(groups, [0] * PARTS), BUCKETS)
    histograms = np.zeros((PARTS, 1 << WIDTH))
    for r in index.groupBy("key").agg(F.count("*").alias("n")).toLocalIterator():  # at most 4 * 2**16 rows
        histograms[r["key"] >> 32, r["key"] & 0xFFFF] = r["n"]
    thresholds = allocate([pairs_by_distance(h) for h in histograms], n, tau)
    rows, ready = fps.select("fp").mapInArrow(_signatures(groups, thresholds), BUCKETS), None
    for _ in range(LEVELS):  # after the last, 16 bits are left to differ in
        crowded = rows.groupBy("key", "path", "sub").agg(F.count("*").alias("n")).filter(F.col("n") > hot).drop("n")
        crowded = stored(spark, crowded.withColumn("crowded", F.lit(True)), "crowded")
        if crowded.isEmpty():
            break
        marked = rows.join(crowded, ["key", "path", "sub"], "left")
        whole = marked.filter("crowded is null").select(BUCKET)
        ready = whole if ready is None else ready.unionByName(whole)
        rows = stored(spark, marked.filter("crowded").select(BUCKET).mapInArrow(_split(groups), BUCKETS), "parts")
    rows = rows if ready is None else ready.unionByName(rows)
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = rows.repartition(ways, "key", "path", "sub").sortWithinPartitions("key", "path", "sub")
    return buckets.mapInArrow(_verify(groups, tau), "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = TAU, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    spark = docs.sparkSession
    prints = stored(spark, fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "prints")
    reps = stored(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = components(links(reps, tau, hot)).withColumnRenamed("node", "fp")
    nodes = reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = nodes.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
