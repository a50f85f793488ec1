"""Operator 6: secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content (a blob).  The
ledger holds a row for each blob and rule version that was scanned, with the
spans found.  A run scans only pairs that the ledger lacks, each blob once
however many paths have it, and joins the findings back to all paths.

Positions come from two native functions that see the same matches, leftmost and
not overlapping: ``split`` gives the texts between them and ``regexp_extract_all``
the matches, so running lengths are the offsets, in code points.

Scale: digests are shuffled to find one representative path of each new blob; one
hash join on the rows' own keys, which no two rows share, brings its text, and only
that is scanned.  The ledger is a table that runs append to; what a lost run had
appended twice counts once.

Defined results: a null text is the empty blob; repeated rows and equal texts share
a blob and get the same findings; rows without an id are paths like others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positioned, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern``, a group whose length must reach ``least``, and a cheap test that is true wherever the pattern matches."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


#: In the order in which kinds are listed where spans start together.  The first three are the base kinds.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)password|passwd|secret|token|api_?key"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    # Runs shorter than 32 would be dropped; with {32,} they are never built, and longer runs match the same.
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh[pousr]_"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20, r"eyJ"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 32, "PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,rank:int,kind:string,stop:int>"
LEDGER = f"blob string, rule string, version int, spans array<{SPAN}>"


def blob_of(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All spans of a rule in a text, as an array of (start, rank, kind, stop); stop is exclusive."""
    quoted = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    hits = F.transform(F.regexp_extract_all(text, quoted, F.lit(0)), lambda x: F.length(x))
    tests = hits if rule.group == 0 else F.transform(F.regexp_extract_all(text, quoted, F.lit(rule.group)), lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        stop = begin + x["hit"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop"))
        grown = F.when(x["test"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), grown.alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), tests.alias("test"))
    found = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.hint) & text.rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing was written yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _current(rules: tuple[Rule, ...]) -> Column:
    """The ledger's row is of a rule version in use."""
    return F.concat_ws(":", "rule", F.col("version").cast("string")).isin([f"{r.kind}:{r.version}" for r in rules])


def unseen(rows: DataFrame, paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: a row for each blob of ``paths`` (key, blob) and rule version that it lacks.

    ``rows`` (row, key) hold the texts.  Of each blob one path, that with the smallest key,
    is scanned: keys are the rows' own, so however many copies there are, and whatever
    their ids, a blob is scanned once.
    """
    have = ledger.filter(_current(rules)).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", F.col("version").cast("string"))).alias("have"))
    todo = paths.groupBy("blob").agg(F.min("key").alias("key")).join(have, "blob", "left")
    todo = todo.filter(F.coalesce(F.size("have"), F.lit(0)) < len(rules)).withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    texts = rows.select("key", F.coalesce(F.col("row.text"), F.lit("")).alias("text"))
    found = texts.join(todo.hint("shuffle_hash"), "key")
    scanned = []
    for rank, rule in enumerate(rules):
        fresh = ~F.array_contains("have", f"{rule.kind}:{rule.version}")
        spans = F.when(fresh, spans_of(F.col("text"), rule, rank))
        scanned.append(F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), spans.alias("spans")))
    # Nothing above the join filters on what was found, so the optimizer has no test to evaluate on all paths below it.
    news = found.select("blob", F.explode(F.array(*scanned)).alias("x")).filter("x.spans is not null")
    return news.select("blob", "x.rule", "x.version", "x.spans")


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) for every path; ``spans`` are those of all rules, by start and then by the order of the rules.

    Reads the ledger's table, scans the pairs that it lacks, appends them, and joins what
    the ledger then holds back to the paths.  A run over blobs that it has scans no text.
    """
    spark = docs.sparkSession
    rows = positioned(docs)
    paths = stored(spark, rows.select("key", F.col("row.doc_id").alias("doc_id"), blob_of(F.col("row.text")).alias("blob")), "paths")
    unseen(rows, paths, read_ledger(spark, ledger_path), rules).write.mode("append").parquet(ledger_path)
    known = read_ledger(spark, ledger_path).filter(_current(rules) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule", "version"])
    # The order of the rules is that of this run, whatever it was when the ledger's row was written.
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    by_blob = known.withColumn("spans", ranked).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, by start and then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
