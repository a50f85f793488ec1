"""Table operators around the scans: averaging, ranking, voting, pivots, comparisons, registries, event windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from ..functions.stats import pearson

Z95 = 1.959963984540054


def average_duplicates(df: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """One row for each key with the mean of its values, and the first position at which it occurs."""
    return df.groupBy(key).agg(*(F.avg(v).alias(v) for v in values), F.min(order).alias("first_seen"))


def effective_counts(df: DataFrame, line: str, env: str) -> DataFrame:
    """Harmonic means, over lines, of the number of environments and of plots."""
    per = df.groupBy(line).agg(F.countDistinct(env).alias("e"), F.count(F.lit(1)).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("lines"), (F.count(F.lit(1)) / F.sum(1 / F.col("e"))).alias("h_env"), (F.count(F.lit(1)) / F.sum(1 / F.col("p"))).alias("h_plot"))


def rank_models(df: DataFrame) -> DataFrame:
    """Mean metrics of each model over traits, ranked by correlation, fit, time and name."""
    agg = df.groupBy("model").agg(F.countDistinct("trait").alias("n_traits"), F.round(F.avg("pearson"), 9).alias("pearson"), F.round(F.avg("r2"), 9).alias("r2"), F.round(F.avg("seconds"), 9).alias("seconds"))
    order = Window.orderBy(F.desc("pearson"), F.desc("r2"), "seconds", "model")  # one row for each model
    return agg.withColumn("rank", F.row_number().over(order).cast("long"))


def vote_best(df: DataFrame) -> DataFrame:
    """The model that is best in each fold (correlation to three digits, then fit, then name), and how often each wins."""
    w = Window.partitionBy("trait", "fold").orderBy(F.desc(F.round("pearson", 3)), F.desc("r2"), "model")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").groupBy("trait", "model").agg(F.count(F.lit(1)).alias("wins"))


def rank_within(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def best_per_position(df: DataFrame) -> DataFrame:
    return df.groupBy("chrom", "pos").agg(F.min("p").alias("p"))


#: A group is cut at one part in so many before and after each wanted quantile.
SLICES = 256


def quantile_thresholds(df: DataFrame, by: str, value: str, levels: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation; null for a group without values.

    A group is cut into slices at approximate quantiles around the wanted ones, and the
    rows of each slice are counted; the values of the slices that hold a wanted rank are
    then ranked.  So no task sees a group's values, but those of one slice, equal ones once.
    """
    spark, v = df.sparkSession, F.col(value)
    near = sorted({min(max(q + e / SLICES, 0.0), 1.0) for q in levels for e in (-1, 1)})
    rows = df.select(F.col(by).alias("_by"), v.cast("double").alias("_v"))
    cuts = rows.filter("_v is not null").groupBy(F.col("_by").alias("_group")).agg(F.array_distinct(F.percentile_approx("_v", near, 20 * SLICES)).alias("_cuts"))
    cut = rows.filter("_v is not null").join(F.broadcast(cuts), F.col("_by").eqNullSafe(F.col("_group"))).select("_by", "_v", F.expr("aggregate(_cuts, 0, (a, c) -> a + if(_v > c, 1, 0))").alias("_s"))
    wanted: list[tuple] = []
    counts: dict = {}
    for r in cut.groupBy("_by", "_s").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["_by"], {})[r["_s"]] = r["n"]
    for group, n in counts.items():
        total, ends = sum(n.values()), {}
        for s in sorted(n):
            ends[s] = max(ends.values(), default=0) + n[s]
        for q, level in enumerate(levels):
            at = level * (total - 1)
            for rank, weight in ((math.floor(at), 1 - (at - math.floor(at))), (math.floor(at) + 1, at - math.floor(at))):
                if weight > 0:
                    s = next(s for s in ends if ends[s] > rank)
                    wanted.append((group, s, q, rank - (ends[s] - n[s]), weight))
    found = spark.createDataFrame(wanted, rows.select("_by").schema.add("_s", IntegerType()).add("_q", IntegerType()).add("_rank", LongType()).add("_w", DoubleType()))
    here = found.select("_by", "_s").distinct()
    same = F.col("x._by").eqNullSafe(F.col("y._by")) & (F.col("x._s") == F.col("y._s"))
    some = cut.alias("x").join(F.broadcast(here.alias("y")), same, "left_semi").groupBy("_by", "_s", "_v").agg(F.count(F.lit(1)).alias("_n"))
    last = F.sum("_n").over(Window.partitionBy("_by", "_s").orderBy("_v"))
    placed = some.withColumn("_end", last).alias("x").join(F.broadcast(found.alias("y")), same & (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    names = [f"q{round(q * 1000):03d}" for q in levels]
    part = placed.groupBy("x._by").agg(*(F.sum(F.when(F.col("_q") == q, F.col("_v") * F.col("_w"))).alias(n) for q, n in enumerate(names)))
    groups = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_n")).alias("g")
    return groups.join(F.broadcast(part.alias("p")), F.col("g._by").eqNullSafe(F.col("p._by")), "left").select(F.col("g._by").alias(by), *names)


def frequent_groups(df: DataFrame, by: str, top: int, share: float) -> DataFrame:
    """Groups with at least ``share`` of the median count of the ``top`` largest."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    bar = counts.orderBy(F.desc("n"), by).limit(top).agg((F.median("n") * share).alias("_bar"))
    return counts.join(F.broadcast(bar), F.lit(True)).filter(F.col("n") >= F.col("_bar")).drop("_bar")


def pivot_first(df: DataFrame, index: list[str], columns: str, names: list[str], values: list[str]) -> DataFrame:
    """Wide table: for each value and column name one column ``value__name``."""
    aggs = [F.min(F.when(F.col(columns) == n, F.col(v))).alias(f"{v}__{n}") for v in values for n in names]
    return df.groupBy(*index).agg(*aggs)


def compare_pairs(df: DataFrame, keys: list[str], engine: str, value: str) -> DataFrame:
    """Correlation and root mean square difference of each pair of engines on rows that both have."""
    a = df.select(*keys, F.col(engine).alias("a"), F.col(value).alias("x"))
    b = df.select(*keys, F.col(engine).alias("b"), F.col(value).alias("y"))
    x, y = F.col("x"), F.col("y")
    s = a.join(b, keys).filter("a < b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.avg((x - y) * (x - y)).alias("ms"))
    return s.select("a", "b", "n", pearson(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("r"), F.sqrt("ms").alias("rmse"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 per cent interval of a proportion, within 0 and 1; both 0 for an empty group."""
    p, z2 = k / n, Z95 * Z95
    centre, width = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)
    empty = lambda c: F.when(n > 0, c).otherwise(0.0)
    return empty(F.greatest(centre - width, F.lit(0.0))), empty(F.least(centre + width, F.lit(1.0)))


def haplotypes(geno: DataFrame, sites: DataFrame, group: str) -> DataFrame:
    """(group, sample_id, haplotype): a sample's calls at the group's sites, in order of position; samples with a missing one are left out."""
    n = sites.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    calls = geno.filter("g is not null").join(sites.select("site_id", "pos", group), "site_id")
    rows = calls.groupBy(group, "sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "site_id", "g"))).alias("_a"))
    text = F.array_join(F.transform("_a", lambda v: v["g"].cast("string")), "")
    return rows.join(n, group).filter(F.size("_a") == F.col("_n")).select(group, "sample_id", text.alias("haplotype"))


def prefix_rhat(draws: DataFrame) -> DataFrame:
    """Convergence after each draw: (parameter, step, rhat) from (parameter, chain, step, x), at least 1; null before the second."""
    w = Window.partitionBy("parameter", "chain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    run = draws.withColumns({"n": F.count(F.lit(1)).over(w), "m": F.avg("x").over(w), "v": F.var_samp("x").over(w)})
    g = run.groupBy("parameter", "step").agg(F.max("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("bm"))
    var = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("bm")
    return g.select("parameter", "step", F.when((F.col("n") > 1) & (F.col("w") > 0), F.greatest(F.sqrt(var / F.col("w")), F.lit(1.0))).alias("rhat"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """INSERT OR REPLACE: of each key the row with the latest version."""
    both = old.unionByName(new)
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc(tie))
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON text; null where the text or the field is not there."""
    return F.get_json_object(text, path).cast(kind)


def sessions(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """Extension: sessions of events with no longer pause than ``gap``."""
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), "n")
