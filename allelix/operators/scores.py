"""Scores of binary features against a response, and rule searches over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson


def confusion(hits: DataFrame, response: DataFrame, key: str) -> DataFrame:
    """Confusion counts of each feature: ``hits`` are (key, sample_id) where the feature is on, absent rows are off."""
    totals = response.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") == 1).alias("_pos"))
    on = hits.join(response, "sample_id").groupBy(key).agg(F.count_if(F.col("y") == 1).alias("tp"), F.count_if(F.col("y") == 0).alias("fp"))
    j = on.join(F.broadcast(totals), F.lit(True))
    return j.withColumns({"fn": F.col("_pos") - F.col("tp"), "tn": F.col("_n") - F.col("_pos") - F.col("fp")}).drop("_n", "_pos")


def balanced_accuracy() -> Column:
    sens = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    spec = F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    return (F.coalesce(sens, F.lit(0.0)) + F.coalesce(spec, F.lit(0.0))) / 2


def mcc() -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(den > 0, (tp * tn - fp * fn) / F.sqrt(den)).otherwise(0.0)


def gains(hits: DataFrame, response: DataFrame, key: str) -> DataFrame:
    """Continuous response: mean difference, correlation and centred gain between samples with and without the feature."""
    totals = response.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    on = hits.join(response, "sample_id").groupBy(key).agg(F.count(F.lit(1)).alias("n_hit"), F.sum("y").alias("sum_hit")).join(F.broadcast(totals), F.lit(True))
    n, h, miss = F.col("n"), F.col("n_hit"), F.col("n") - F.col("n_hit")
    share = h / n
    off = F.col("sum_hit") - share * F.col("sy")
    return on.withColumns({
        "mean_diff": F.try_divide(F.col("sum_hit").cast("double"), h) - F.try_divide((F.col("sy") - F.col("sum_hit")).cast("double"), miss),
        "corr": pearson(n, h, F.col("sy"), h, F.col("syy"), F.col("sum_hit")),
        "gain": F.when((h == 0) | (miss == 0), 0.0).otherwise(n * off * off / (h * miss)),
    })


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def best_conjunctions(hits: DataFrame, response: DataFrame, key: str, beam: int, depth: int) -> DataFrame:
    """Beam search over conjunctions of features by MCC: (rule, depth, score).

    Each round joins the best ``beam`` rules with all features of their samples, so
    its size is the beam's hits times a sample's features; ``beam`` bounds both.
    """
    feats = hits.select(F.col(key).cast("long").alias("f"), "sample_id").distinct()
    rules = feats.select(F.array("f").alias("rule"), "sample_id")
    out = None
    for level in range(1, depth + 1):
        scored = confusion(rules, response, "rule").withColumn("score", F.round(mcc(), 9))
        best = scored.orderBy(F.desc("score"), "rule").limit(beam).select("rule", F.lit(level).cast("long").alias("depth"), "score")
        out = best if out is None else out.unionByName(best)
        if level < depth:
            grow = rules.join(F.broadcast(best.select("rule")), "rule").join(feats, "sample_id")
            grow = grow.filter(~F.array_contains("rule", F.col("f")))
            rules = grow.select(F.array_sort(F.concat("rule", F.array("f"))).alias("rule"), "sample_id").distinct()
    return out


#: Rules of two features, in the order in which ties are decided: (text, whether i counts, whether j counts).
LITERALS = (("{i}&{j}", True, True), ("{i}&!{j}", True, False), ("!{i}&{j}", False, True), ("!{i}&!{j}", False, False))


#: Pairs of cells looked at together.
PAIRS = 1 << 21


def _mcc_key(on: np.ndarray, tp: np.ndarray, n: int, p: int) -> np.ndarray:
    """Matthews correlation of rules that are on for ``on`` samples, ``tp`` of them cases, in whole 1e-9."""
    on, tp = np.asarray(on, float), np.asarray(tp, float)
    fp, fn, tn = on - tp, p - tp, n - p - on + tp
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    r = np.where(den > 0, (tp * tn - fp * fn) / np.sqrt(np.where(den > 0, den, 1.0)), 0.0)
    return (np.sign(r) * np.floor(np.abs(r) * 1e9 + 0.5)).astype(np.int64)


class _Features:
    """The samples of a group's features: cells sorted by feature, and by sample."""

    def __init__(self, f: np.ndarray, sample: np.ndarray, y: np.ndarray):
        self.ids, f = np.unique(f, return_inverse=True)
        _, sample = np.unique(sample, return_inverse=True)
        order = np.lexsort((f, sample))
        self.f, self.sample, self.y = f[order], sample[order], y[order].astype(np.int64)
        size = np.bincount(sample)
        self.later = np.cumsum(size)[self.sample] - np.arange(len(f)) - 1  # cells of the same sample with a higher feature
        self.cells = np.argsort(self.f, kind="stable")
        self.on = np.bincount(self.f)
        self.first = np.cumsum(self.on) - self.on
        self.tp = np.bincount(self.f, self.y).astype(np.int64)

    def shared(self):
        """(i, j, shared samples, shared cases) of features i < j with a common sample, by blocks of i."""
        work = np.cumsum(np.bincount(self.f, self.later))
        lo = 0
        while lo < len(self.ids):
            done = work[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(work, done + PAIRS, "right")))
            cells = self.cells[self.first[lo] : self.first[hi - 1] + self.on[hi - 1]]
            reps = self.later[cells]
            left = np.repeat(cells, reps)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
            code, at = np.unique(self.f[left] * len(self.ids) + self.f[right], return_inverse=True)
            if len(code):
                yield code // len(self.ids), code % len(self.ids), np.bincount(at), np.bincount(at, self.y[left]).astype(np.int64)
            lo = hi

    def apart(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
        """The first pair i < j, one of ``a`` and one of ``b``, without a common sample."""
        mark = np.zeros(int(self.sample[-1]) + 1, bool)
        samples = lambda f: self.sample[self.cells[self.first[f] : self.first[f] + self.on[f]]]
        in_a = np.isin(np.union1d(a, b), a)
        for i, left in zip(np.union1d(a, b).tolist(), in_a.tolist()):
            mark[samples(i)] = True
            other = b if left else a
            for j in other[other > i].tolist():
                if not mark[samples(j)].any():
                    return i, j
            mark[samples(i)] = False
        return None


def _best_rule(x: _Features, n: int, p: int) -> tuple[int, int, int, int, int]:
    """(-score in 1e-9, depth, place, i, j) of a group's best rule."""
    every = np.arange(len(x.ids))
    best = min((-int(k[i]), 1, place, i, -1) for place, k in enumerate((_mcc_key(x.on, x.tp, n, p), _mcc_key(n - x.on, p - x.tp, n, p))) for i in [int(k.argmax())])
    for i, j, both, cases in x.shared():
        forms = ((both, cases), (x.on[i] - both, x.tp[i] - cases), (x.on[j] - both, x.tp[j] - cases), (n - x.on[i] - x.on[j] + both, p - x.tp[i] - x.tp[j] + cases))
        for place, (on, tp) in enumerate(forms):
            k = _mcc_key(on, tp, n, p)
            at = int(k.argmax())  # the first is the one of smallest i, j
            best = min(best, (-int(k[at]), 2, place, int(i[at]), int(j[at])))
    # Without a common sample the first form scores 0 and the next two like one feature, so a shorter rule is as good; the
    # last is decided by the two features' counts, of which a group has few.
    kinds, kind = np.unique(np.column_stack([x.on, x.tp]), axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    of = np.split(order, np.flatnonzero(np.diff(kind[order])) + 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(len(kinds)):
        on, tp = kinds[a, 0] + kinds[a:, 0], kinds[a, 1] + kinds[a:, 1]
        k = _mcc_key(n - on, p - tp, n, p)
        b = np.flatnonzero((k >= -best[0]) & (on <= n))
        found.append((k[b], np.full(len(b), a), b + a))
    key, a, b = (np.concatenate(v) for v in zip(*found))
    for at in np.argsort(-key, kind="stable").tolist():
        if -int(key[at]) > best[0]:
            break
        pair = x.apart(every[of[a[at]]], every[of[b[at]]])
        if pair is not None:
            best = min(best, (-int(key[at]), 2, 3, *pair))
    return best


def best_and_not(hits: DataFrame, response: DataFrame, key: str, group: str) -> DataFrame:
    """(group, rule, depth, score): the best rule of each group by MCC among all single features, all pairs, and their negations.

    ``hits`` are distinct (group, key, sample_id) where a feature is on; a feature that
    no sample has is in no rule.  Nothing is pruned: a group is one task, which counts
    the pairs with a common sample block by block and judges all others by their
    features' counts, so no pair is a row.  Ties go to the shorter rule, then to the
    earlier form, then to smaller ids.
    """
    on = hits.select(group, F.col(key).cast("long").alias("f"), "sample_id").join(response.select("sample_id", F.col("y").cast("long").alias("y")), "sample_id")
    totals = response.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("p")).collect()[0]
    n, p = totals["n"], totals["p"]

    def run(t: pa.Table) -> pa.Table:
        x = _Features(*(t[c].to_numpy() for c in ("f", "sample_id", "y")))
        loss, depth, place, i, j = _best_rule(x, n, p)
        text = (LITERALS[place][0] if depth == 2 else ("{i}", "!{i}")[place]).replace("{i}", str(x.ids[i])).replace("{j}", str(x.ids[j]))
        return pa.table({group: t[group].slice(0, 1), "rule": [text], "depth": pa.array([depth], pa.int64()), "score": [-loss / 1e9 + 0.0]})

    kind = on.schema[group].dataType.simpleString()
    return on.groupBy(group).applyInArrow(run, f"{group} {kind}, rule string, depth long, score double")
