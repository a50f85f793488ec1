"""The corpus pipeline: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet in the
shared folder and read again as the next stage's documents.  Stages drop rows
(or, for mixing, repeat them) and otherwise return the columns of documents; the
last returns one row for each document in the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm import decontam, mixing, shingles, simhash, tokens, toxicity
from allelix.llm.common import load, positioned, stored
from allelix.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (3): documents that the model rejects go.

    It learns from the labels of the stage's own documents.  Rows are judged by their
    text, so null, empty and repeated rows, and null ids, are treated like any other.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash (5), and five-word shingles for copies with more edits: one document of each group stays.

    That is the one with the smallest id, an id that is null after all others; the row's
    place decides among equal ids.  Texts without words are alike and make one group.
    """
    rows = positioned(docs)
    # Order of a group's rows: known ids first, by id, then by place.
    place = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id").alias("id"), "key")
    texts = rows.select(place.alias("doc_id"), F.col("row.text").alias("text"))
    prints = stored(spark, simhash.fingerprints(texts), "prints")
    sketched = stored(spark, shingles.sketches(texts), "sketches")
    node = lambda kind, value: F.xxhash64(F.lit(kind), value)
    fps = stored(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    edges = simhash.links(fps).select(node("fp", F.col("a")).alias("a"), node("fp", F.col("b")).alias("b"))
    similar = shingles.similar_pairs(texts, sketched).select(node("set", F.col("a")).alias("a"), node("set", F.col("b")).alias("b"))
    # A fingerprint and a set of shingles are of one group where a text has both.
    both = prints.join(sketched.filter("name is not null").select("doc_id", "name"), "doc_id")
    both = both.select(node("fp", F.col("fp")).alias("a"), node("set", F.col("name")).alias("b")).distinct()
    roots = simhash.components(edges.unionByName(similar).unionByName(both))
    known = fps.withColumn("node", node("fp", F.col("fp"))).join(roots, "node", "left")
    keepers = known.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("least").alias("doc_id"))
    drop = prints.select("doc_id").join(stored(spark, keepers.select("doc_id"), "keepers"), "doc_id", "left_anti")
    drop = stored(spark, drop.select("doc_id.key"), "drop")
    return rows.join(drop.hint("shuffle_hash"), "key", "left_anti").select("row.*")  # texts are dealt by key at every size


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (4): documents with any 13-word window of an item go, and those that shorter items cover to a twentieth.

    Rows are judged by their text, so null, empty and repeated rows, and null ids, are treated like any other.
    """
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (8): each document as often as the mix takes it, so rows of heavy sources repeat and others go.

    Documents without words are never taken; every row is decided by itself, with or without an id of its own.
    """
    return mixing.repeat_rows(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output (10): the ids of all documents in compressed shards, read back; null and empty texts have the end id alone."""
    # Workers still hold some of what earlier stages took, so they remember fewer words than where this operator runs alone.
    return tokens.read_documents(tokens.write_shards(docs, vocabulary_path(), words=(150_000, 10_000)))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_weights),
    ("token_files", to_token_files),
]

#: The models, the flow's seeded choice and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, f"stage_{name}")
    return docs
