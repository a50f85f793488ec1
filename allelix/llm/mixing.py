"""Operator 8: mix overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a
document belongs to).  The flow network is tiny, one node for each pattern and
source: pattern arcs offer the pattern's words once for nothing and again at a
convex repetition cost, source nodes drain their quota.  The flow says how many
words each pattern gives; documents are then chosen in a seeded order.

Scale: one pass over the texts counts words, and what follows works on rows of
(pattern, size, hashes).  The cut in the seeded order is found by histograms
of 1024 hash bins, narrowed until the bin of the cut is small, so that no task
ever sorts a source; where equal texts fill the last bin, hashes of the rows' own
places narrow it further.  Only one row for each pattern reaches the driver.

Defined results: a null text or one without words has size 0 and is never taken;
null is a source of its own, after all others; a null list of members has no source
and is not taken; ids may be null or repeat, as nothing goes by them; of repeated
rows each counts, and which of them is taken does not show; an empty table gives an
empty result.  ``mix_sources`` ignores other columns, ``repeat_rows`` keeps them.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import positioned, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = 42
#: A pattern is done when what it still lacks is below this share of what it gives.
NEAR = 0.0002
#: Patterns and sources live on the driver; more than this is an error, not a cut.
MAX_PATTERNS = 200_000
BIN_BITS, HASH_BITS, SMALL_BIN = 10, 60, 2_000


def quotas(sizes: dict, weights: tuple[float, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> dict:
    """Target words of each source: shares of all words by weight, none above ``repeat`` times its size.

    Sources go by code point with null last, and weights repeat along them.  What
    a capped source leaves is shared again, by weight, among those below their cap.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, out = dict.fromkeys(order), float(sum(sizes.values())), {}
    while left:
        share = total / sum(weight[s] for s in left)
        full = [s for s in left if share * weight[s] > repeat * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in left}
        for s in full:
            out[s] = float(repeat * sizes[s])
            total -= out[s]
            del left[s]
    return out


class Flow:
    """Min-cost flow by the primal-dual method: each round opens all shortest paths at once and saturates them level by level.

    Rounds are few, as costs are the few repetition costs; arcs, not paths, set the work of a round.
    """

    def __init__(self):
        self.to, self.cap, self.cost, self.out = [], [], [], []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def _far(self, s: int) -> list[int]:
        """The least cost from ``s`` to each node over arcs with room."""
        far, queue, queued = [1 << 60] * len(self.out), deque([s]), bytearray(len(self.out))
        far[s] = 0
        while queue:
            x = queue.popleft()
            queued[x] = 0
            for e in self.out[x]:
                y = self.to[e]
                if self.cap[e] > 0 and far[x] + self.cost[e] < far[y]:
                    far[y] = far[x] + self.cost[e]
                    if not queued[y]:
                        queued[y] = 1
                        queue.append(y)
        return far

    def _levels(self, s: int, far: list[int]) -> list[int]:
        """Steps from ``s`` over arcs with room that lie on shortest paths."""
        level, queue = [-1] * len(self.out), deque([s])
        level[s] = 0
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                y = self.to[e]
                if self.cap[e] > 0 and level[y] < 0 and far[y] == far[x] + self.cost[e]:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level

    def run(self, s: int, t: int) -> None:
        while (far := self._far(s))[t] < 1 << 60:
            while (level := self._levels(s, far))[t] >= 0:
                self._saturate(s, t, far, level)

    def _saturate(self, s: int, t: int, far: list[int], level: list[int]) -> None:
        """A blocking flow over the levels, by depth-first search that never takes a dead arc again."""
        at, path, x = [0] * len(self.out), [], s
        while True:
            if x == t:
                push = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not self.cap[e])
                x = self.to[path[k] ^ 1]
                del path[k:]
            while at[x] < len(self.out[x]):
                e = self.out[x][at[x]]
                y = self.to[e]
                if self.cap[e] > 0 and level[y] == level[x] + 1 and far[y] == far[x] + self.cost[e]:
                    break
                at[x] += 1
            if at[x] < len(self.out[x]):
                path.append(self.out[x][at[x]])
                x = self.to[path[-1]]
            elif path:
                x = self.to[path.pop() ^ 1]
                at[x] += 1
            else:
                return


def route(patterns: dict[tuple, int], targets: dict, repeat: int = MAX_REPEAT) -> dict[tuple, int]:
    """Words that each pattern gives, all sources together.

    ``patterns`` maps a tuple of sources to its words.  The first use of a word
    costs 0, the next 1, then 2 and so on, so repetition is spread before it deepens.
    """
    net = Flow()
    start, end = net.node(), net.node()
    drains = {}
    for s, words in targets.items():
        drains[s] = net.node()
        net.arc(drains[s], end, round(words), 0)
    given = {}
    for p, words in patterns.items():
        x = net.node()
        given[p] = [net.arc(start, x, int(words), k) for k in range(repeat)]
        for s in p:
            net.arc(x, drains[s], int(words) * repeat, 0)
    net.run(start, end)
    return {p: sum(net.cap[e ^ 1] for e in arcs) for p, arcs in given.items()}


def sized(
    docs: DataFrame, place: Column, doc_id: Column, text: Column, source: Column, members: Column, extra: list[Column], seed: int = SEED
) -> DataFrame:
    """Each row with its words of [^\\x20\\x09-\\x0D]+, the name of its pattern, and its place in the seeded order.

    The order goes by ``h``, a hash of the row's id and text, and among repeated rows by
    ``hp``, a hash of ``place``, which is the row's own.
    """
    key = F.array_join(F.transform(members, lambda m: F.coalesce(F.hex(F.encode(m, "utf-8")), F.lit("-"))), ",")
    return docs.select(
        *extra,
        source.cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        members.alias("members"),
        key.alias("key"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - HASH_BITS).alias("h"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), place), 64 - HASH_BITS).alias("hp"),
    )


def _cuts(rows: DataFrame, quota: dict[int, int], keys: tuple[str, ...] = ("h", "hp")) -> dict[int, tuple]:
    """For each pattern the last place (h, hp) in seeded order at which the running size stays within the quota.

    Histograms of the first key narrow the place down; where more than ``SMALL_BIN`` rows
    share all bits of it (equal texts), the next key goes on.
    """
    spark, key, top = rows.sparkSession, keys[0], 1 << HASH_BITS
    found: dict[int, tuple] = {}
    state = dict.fromkeys(quota, (0, 0))  # bin of the cut at this level, words before it
    bits = 0
    while state:
        shift = HASH_BITS - bits
        here = F.broadcast(spark.createDataFrame([(p, b, quota[p] - w) for p, (b, w) in state.items()], "pattern int, bin long, left long"))
        inside = rows.join(here, "pattern").filter(F.shiftrightunsigned(key, shift) == F.col("bin"))
        count = {r["pattern"]: r["n"] for r in inside.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
        many = {p for p in state if count.get(p, 0) > SMALL_BIN}
        deep = many if bits < HASH_BITS else set()
        ties = many - deep if len(keys) > 1 else set()
        done = state.keys() - deep - ties
        if done:
            order = Window.partitionBy("pattern").orderBy(*keys)
            last = inside.filter(F.col("pattern").isin(sorted(done)) if deep or ties else F.lit(True))
            last = last.withColumn("run", F.sum("size").over(order)).filter("run <= left").groupBy("pattern").agg(F.max(F.struct(*keys)).alias("k"))
            got = {r["pattern"]: tuple(r["k"]) for r in last.collect()}
            for p in done:
                found[p] = got.get(p, ((state[p][0] << shift) - 1, *[top] * (len(keys) - 1)))
        if ties:
            same = _cuts(inside.filter(F.col("pattern").isin(sorted(ties))).drop("bin", "left"), {p: quota[p] - state[p][1] for p in ties}, keys[1:])
            found |= {p: (state[p][0], *cut) for p, cut in same.items()}
        if not deep:
            break
        sums = inside.filter(F.col("pattern").isin(sorted(deep)) if len(deep) < len(state) else F.lit(True))
        sums = sums.groupBy("pattern", F.shiftrightunsigned(key, shift - BIN_BITS).alias("bin")).agg(F.sum("size").alias("w"), F.max("left").alias("left"))
        run = F.sum("w").over(Window.partitionBy("pattern").orderBy("bin"))
        over = sums.withColumn("run", run).filter("run > left").groupBy("pattern").agg(F.min(F.struct("bin", "run", "w")).alias("k"))
        got = {r["pattern"]: r["k"] for r in over.collect()}
        found |= {p: (top,) * len(keys) for p in deep if p not in got}  # all of it fits
        state = {p: (k["bin"], state[p][1] + k["run"] - k["w"]) for p, k in got.items()}
        bits += BIN_BITS
    return found


class Mix:
    """What the flow and the cuts decide, as one row for each membership pattern."""

    def __init__(self, spark: SparkSession, repeat: int):
        self.spark, self.repeat = spark, repeat
        self.plan: list[tuple] = []  # (key, pattern, whole uses, size and target of the first source)
        self.marks: dict[int, list[tuple]] = {}  # pattern to (use, gap, h, hp) of each pass

    def attach(self, rows: DataFrame) -> DataFrame:
        """Rows of ``sized`` with pattern, source_size, target and times, how often the mix takes a row."""
        table = [(*p, self.marks.get(p[1], [])) for p in self.plan]
        kind = "key string, pattern int, whole int, source_size long, target double, marks array<struct<use:int,gap:long,h:long,hp:long>>"
        joined = rows.join(F.broadcast(self.spark.createDataFrame(table, kind)), "key")  # MAX_PATTERNS rows at most

        def step(extra: Column, m: Column) -> Column:
            before = (F.col("h") < m["h"]) | ((F.col("h") == m["h"]) & (F.col("hp") <= m["hp"]))
            free = (extra == m["use"]) & (F.col("whole") + extra < self.repeat)
            return extra + (free & before & (F.col("size") > 0) & (F.col("size") <= m["gap"])).cast("int")

        extra = F.aggregate("marks", F.lit(0), step)
        return joined.withColumn("extra", extra).withColumn("times", F.col("whole") + F.col("extra")).drop("marks")


def decide(
    base: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: int = MAX_REPEAT, fill_passes: int = 3, targets: dict | None = None
) -> Mix:
    """The mix of the rows of ``sized``, which are read several times."""
    spark = base.sparkSession
    found = base.groupBy("key").agg(F.first("members").alias("members"), F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["members"]): r["words"] for r in found}
    names = {tuple(r["members"]): r["key"] for r in found}
    sizes: dict = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets or quotas(sizes, weights, repeat)
    given = route(patterns, goal, repeat)
    number = {p: i for i, p in enumerate(sorted(patterns, key=lambda p: [(s is None, s or "") for s in p]))}
    mix = Mix(spark, repeat)
    mix.plan = [
        (names[p], number[p], given[p] // w if w else 0, sizes.get(p[0], 0) if p else 0, float(goal.get(p[0], 0.0)) if p else 0.0)
        for p, w in patterns.items()
    ]
    left = {number[p]: given[p] % w for p, w in patterns.items() if w and given[p] % w}
    asked = {number[p]: given[p] for p in patterns}
    for use in range(repeat):  # documents not chosen yet come first; where those left are too long, chosen ones are used again
        for _ in range(1 + fill_passes if use == 0 else fill_passes):
            left = {p: n for p, n in left.items() if n > max(0, NEAR * asked[p])}
            if not left:
                break
            gaps = F.broadcast(spark.createDataFrame(list(left.items()), "pattern int, gap long"))
            free = (F.col("extra") == use) & (F.col("whole") + F.col("extra") < repeat)
            usable = mix.attach(base).filter(free & (F.col("size") > 0)).join(gaps, "pattern").filter("size <= gap").select("pattern", "size", "h", "hp")
            cuts = _cuts(usable, left)
            marks = spark.createDataFrame([(p, *cut) for p, cut in cuts.items()], "pattern int, ch long, chp long")
            hit = usable.join(F.broadcast(marks), "pattern").filter("h < ch or (h = ch and hp <= chp)")
            words = {r["pattern"]: r["w"] for r in hit.groupBy("pattern").agg(F.sum("size").alias("w")).collect()}
            for p, cut in cuts.items():
                mix.marks.setdefault(p, []).append((use, left[p], *cut))
            left = {p: n - words.get(p, 0) for p, n in left.items()}
    return mix


def _members(members_col: str | None) -> Column:
    """The sources of a row; a null list has none."""
    if members_col is None:
        return F.array(F.col("source").cast("string"))
    return F.coalesce(F.array_sort(F.array_distinct(F.col(members_col).cast("array<string>"))), F.array().cast("array<string>"))


def mix_sources(
    docs: DataFrame,
    members_col: str | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    repeat: int = MAX_REPEAT,
    seed: int = SEED,
    fill_passes: int = 3,
    targets: dict | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, taken) of each document.

    ``members_col`` names an array of sources where documents belong to several;
    without it, each belongs to its ``source``.  ``taken`` is the document's size
    times how often the mix uses it, at most ``repeat`` times.  After the cut in
    seeded order, ``fill_passes`` further cuts among smaller documents close the gap,
    and then the same among documents already in use, up to ``repeat`` times.
    """
    base = sized(docs, F.monotonically_increasing_id(), F.col("doc_id"), F.col("text"), F.col("source"), _members(members_col), [F.col("doc_id").alias("id")], seed)
    base = stored(docs.sparkSession, base, "sized")
    rows = decide(base, weights, repeat, fill_passes, targets).attach(base)
    return rows.select("id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, **kwargs) -> DataFrame:
    """The documents as often as the mix takes each, with all their columns; those without words are never taken.

    Rows are known by their place in their files, so neither ids nor texts are
    shuffled: the decisions of a pattern are sent to where its rows are read.
    """
    rows = positioned(docs)
    parts = (F.col("key"), F.col("row.doc_id"), F.col("row.text"), F.col("row.source"), F.array(F.col("row.source").cast("string")))
    mix = decide(stored(docs.sparkSession, sized(rows, *parts, []), "sized"), **kwargs)
    taken = mix.attach(sized(rows, *parts, [F.col("row")])).filter("times > 0 and size > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
