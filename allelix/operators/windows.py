"""Ordered operators: ranks over whole tables, sliding windows, bulked-segregant smoothing, plot coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, value: str, *ties: str, buckets: int = 200, name: str = "rank") -> DataFrame:
    """1, 2, ... in ascending order of a numeric column (ties by further columns), without one task sorting it all.

    Approximate quantiles cut the range into buckets; rows are numbered inside
    their bucket and moved up by the sizes of the buckets before.
    """
    spark = df.sparkSession
    cuts = df.agg(F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 10_000).alias("q")).collect()[0]["q"] or []
    edges = F.array(*(F.lit(float(x)) for x in sorted(set(cuts)))).cast("array<double>")
    df = df.withColumn("_b", F.size(F.filter(edges, lambda x: x < F.col(value))))
    run, table = 0, []
    for r in sorted(df.groupBy("_b").count().collect()):
        table.append((r["_b"], run))
        run += r["count"]
    before = F.broadcast(spark.createDataFrame(table, "_b int, _before long"))
    w = Window.partitionBy("_b").orderBy(value, *ties)
    return df.join(before, "_b").withColumn(name, (F.row_number().over(w) + F.col("_before")).cast("long")).drop("_b", "_before")


def qq_points(hits: DataFrame) -> DataFrame:
    """Observed and expected -log10 p, the latter from rank / (n + 1)."""
    n = hits.agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(hits, "p", "site_id").join(F.broadcast(n), F.lit(True))
    return ranked.withColumns({"expected": -F.log10(F.col("rank") / (F.col("_n") + 1)), "observed": -F.log10("p")}).drop("_n")


def holm(hits: DataFrame) -> DataFrame:
    """Step-down adjusted p: the running maximum of (n - rank + 1) p, at most 1.

    The running maximum goes by rank blocks: first inside a block, then over the
    maxima of the blocks before it.
    """
    block = 10_000
    n = hits.agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(hits, "p", "site_id").join(F.broadcast(n), F.lit(True))
    ranked = ranked.withColumns({"_x": (F.col("_n") - F.col("rank") + 1) * F.col("p"), "_k": F.floor((F.col("rank") - 1) / block)})
    tops = ranked.groupBy("_k").agg(F.max("_x").alias("_m"))
    tops = tops.withColumn("_prior", F.max("_m").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    inside = F.max("_x").over(Window.partitionBy("_k").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_in", inside).join(tops, "_k").withColumn("p_holm", F.least(F.greatest("_in", F.coalesce("_prior", F.lit(0.0))), F.lit(1.0))).drop("_n", "_x", "_k", "_in", "_prior")


def with_halo(df: DataFrame, reach: int, block: int) -> DataFrame:
    """Rows dealt to blocks of positions (``_block``), and again to the neighbours within reach of whose edge they lie (``_own`` is false there).

    A window of at most ``reach`` bases then needs one block, so a chromosome is as many tasks as it has blocks.
    """
    first, last = F.floor((F.col("pos") - reach) / block), F.floor((F.col("pos") + reach) / block)
    dealt = df.withColumn("_block", F.explode(F.sequence(first, last)))
    return dealt.withColumn("_own", F.col("_block") == F.floor(F.col("pos") / block))


def sliding(sites: DataFrame, by_bp: int | None = None, by_rows: int | None = None) -> DataFrame:
    """For each site the number of sites in the window around it, and the least and mean p, by bases or by rows."""
    if by_bp is not None:
        sites = with_halo(sites, by_bp, max(1_000_000, 50 * by_bp))
        w = Window.partitionBy("chrom", "_block").orderBy("pos").rangeBetween(-by_bp, by_bp)
    else:
        w = Window.partitionBy("chrom").orderBy("pos", "site_id").rowsBetween(-by_rows, by_rows)
    out = sites.withColumns({"n_window": F.count(F.lit(1)).over(w), "min_p": F.min("p").over(w), "mean_p": F.avg("p").over(w)})
    return out.filter("_own").drop("_block", "_own") if by_bp is not None else out


def sliding_cm(sites: DataFrame, reach: float) -> DataFrame:
    """For each site the number of sites at most ``reach`` centimorgans (column ``cm``) away, and the least and mean p.

    Windows go over whole millionths of a centimorgan, in blocks with halos as for bases.
    """
    size = round(reach * 1_000_000)
    dealt = with_halo(sites.withColumnRenamed("pos", "_bp").withColumn("pos", F.round(F.col("cm") * 1_000_000).cast("long")), size, 50 * size)
    w = Window.partitionBy("chrom", "_block").orderBy("pos").rangeBetween(-size, size)
    out = dealt.withColumns({"n_window": F.count(F.lit(1)).over(w), "min_p": F.min("p").over(w), "mean_p": F.avg("p").over(w)})
    return out.filter("_own").drop("_block", "_own", "pos").withColumnRenamed("_bp", "pos")


def merge_key(c: Column) -> list[Column]:
    """Order of merged panels: chromosomes whose name is a number come first, by it, then all others by name."""
    name = F.regexp_replace(F.trim(c), "^(?i)chr", "")
    number = F.when(name.rlike("^[0-9]{1,9}$"), name).try_cast("int")
    return [number.isNull(), F.coalesce(number, F.lit(0)), name]


def chrom_key(c: Column) -> list[Column]:
    """Natural order: numbers, then X, Y and mitochondria, then other names."""
    name = F.upper(F.regexp_replace(F.trim(c), "^(?i)chr", ""))
    number = F.try_to_number(F.when(name.rlike("^[0-9]{1,9}$"), name), F.lit("999999999")).cast("int")
    special = F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25)
    return [F.coalesce(number, special, F.lit(1 << 30)), name]


def offsets(sites: DataFrame, parts: int = 50) -> DataFrame:
    """(chrom, offset): each chromosome starts where the ones before end, with a gap of a fraction of the whole between."""
    tops = sites.groupBy("chrom").agg(F.max("pos").cast("long").alias("top"))
    tops = tops.join(F.broadcast(tops.agg(F.floor(F.sum("top") / parts).alias("gap"))), F.lit(True))
    order = Window.orderBy(*chrom_key(F.col("chrom"))).rowsBetween(Window.unboundedPreceding, -1)  # one row for each chromosome
    return tops.withColumn("offset", F.coalesce(F.sum(F.col("top") + F.col("gap")).over(order), F.lit(0))).select("chrom", "offset")


def manhattan(hits: DataFrame) -> DataFrame:
    """Plot coordinate and height of each site."""
    return hits.join(F.broadcast(offsets(hits)), "chrom").withColumns({"x": F.col("pos") + F.col("offset"), "height": -F.log10("p")})


def thin(hits: DataFrame, keep_below: float, size: int) -> DataFrame:
    """All sites below the threshold, and of the others the best in each bin of a chromosome."""
    w = Window.partitionBy("chrom", F.floor(F.col("pos") / size), F.col("p") < keep_below).orderBy("p", "site_id")
    return hits.withColumn("_rn", F.row_number().over(w)).filter((F.col("p") < keep_below) | (F.col("_rn") == 1)).drop("_rn")


def bsa_drop_stage(rows: DataFrame, total_dp: tuple[int, int], min_dp: int, min_gq: float) -> DataFrame:
    """The first filter that a row fails, in order, or ``kept``; rows without depth have null."""
    depth = F.col("dp1") + F.col("dp2")
    stage = (
        F.when((F.col("dp1") <= 0) | (F.col("dp2") <= 0), F.lit(None))
        .when(depth < total_dp[0], "low_total").when(depth > total_dp[1], "high_total")
        .when((F.col("dp1") < min_dp) | (F.col("dp2") < min_dp), "low_bulk")
        .when((F.col("gq1") < min_gq) | (F.col("gq2") < min_gq), "low_quality")
        .when((F.col("ad1") == 0) & (F.col("ad2") == 0), "no_alternate")
        .when((F.col("ad1") == F.col("dp1")) & (F.col("ad2") == F.col("dp2")), "no_reference")
        .otherwise("kept")
    )
    return rows.withColumn("stage", stage)


def bsa_statistics(rows: DataFrame) -> DataFrame:
    """SNP indices, their difference, Euclidean distance and G of each row."""
    eps = 1e-10
    i1, i2 = F.col("ad1") / F.col("dp1"), F.col("ad2") / F.col("dp2")
    out = rows.withColumns({"index1": i1, "index2": i2, "delta": i2 - i1})
    out = out.withColumn("ed", F.sqrt(2 * F.col("delta") * F.col("delta")))
    total = F.col("dp1") + F.col("dp2")
    alt, ref = F.col("ad1") + F.col("ad2"), total - F.col("ad1") - F.col("ad2")
    g = F.lit(0.0)
    for dp, ad in (("dp1", "ad1"), ("dp2", "ad2")):
        for seen, margin in ((F.col(ad), alt), (F.col(dp) - F.col(ad), ref)):
            o, e = F.greatest(seen.cast("double"), F.lit(eps)), F.greatest(F.col(dp) * margin / total, F.lit(eps))
            g = g + o * F.log(o / e)
    return out.withColumn("g", 2 * g)


def bsa_smooth(stats: DataFrame, window: int, step: int, least: int, power: float = 4.0) -> DataFrame:
    """Means in windows of ``window`` bases whose centres are ``step`` apart, and the tricube-weighted G'.

    Every row finds its centres by arithmetic, so rows are replicated window / step
    times and no row is compared with any other.
    """
    spans = stats.groupBy("chrom").agg(F.min("pos").cast("long").alias("lo"), F.max("pos").cast("long").alias("hi"))
    rows = stats.join(F.broadcast(spans), "chrom").filter(F.col("hi") - F.col("lo") >= window)
    half = window // 2
    first = F.greatest(F.ceil((F.col("pos") - half - F.col("lo")) / step), F.lit(1))
    last = F.least(F.floor((F.col("pos") + half - F.col("lo")) / step), F.ceil((F.col("hi") - F.col("lo")) / step) - 1)
    rows = rows.filter(first <= last).withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    rows = rows.withColumn("centre", F.col("lo") + F.col("k") * step)
    d = F.least(F.abs(F.col("pos") - F.col("centre")) / F.lit(float(half)), F.lit(1.0))
    weight = F.pow(1 - F.pow(d, 3.0), 3.0)
    return rows.groupBy("chrom", "centre").agg(
        F.count(F.lit(1)).alias("n"), F.avg("index1").alias("index1"), F.avg("index2").alias("index2"), F.avg("delta").alias("delta"),
        F.avg(F.pow("ed", F.lit(power))).alias("ed_power"), F.try_divide(F.sum(weight * F.col("g")), F.sum(weight)).alias("g_prime"),
    ).filter(F.col("n") >= least)


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Rank with ties averaged, inside each group."""
    w, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def folds(df: DataFrame, k: int, strata: str, key: str) -> DataFrame:
    """Fold 0 to k - 1 of each row, balanced inside each stratum, in the order of the key's MD5."""
    w = Window.partitionBy(strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))
