"""The registered queries of the corpus operators, and their SQL.

Each query calls its operator with production parameters on the whole table and
derives the digest columns from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, mixing, mpegts, secrets, simhash, suffixes, tokens, toxicity
from .common import load, stored, table_path


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A ledger of its own for each run, unless the session names one that runs share: a query's result and cost then depend on its input alone.
    path = spark.conf.get("spark.allelix.ledger", None) or table_path(spark, "ledger")
    found = secrets.scan(load(spark, sf_dir, "documents"), path)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id",
        *(secrets.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(load(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(load(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_media_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.describe(stored(spark, mpegts.to_media(load(spark, sf_dir, "documents")), "media"))


def vocabulary_path() -> str:
    """The tokenizer file that op10 and the pipeline use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_documents(tokens.write_shards(load(spark, sf_dir, "documents"), vocabulary_path()))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_repeated_strings": op2_repeated_strings,
    "op3_toxicity": op3_toxicity,
    "op5_simhash": op5_simhash,
    "op4_decontamination": op4_decontamination,
    "op6_secrets": op6_secrets,
    "op7_main_text": op7_main_text,
    "op8_source_mixing": op8_source_mixing,
    "op9_media_streams": op9_media_streams,
    "op10_token_shards": op10_token_shards,
}

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, lens WHERE len(w) >= n)
), hit AS (SELECT dw.id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), words AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY id
), items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT t.id AS doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t.w)) AS contaminated
FROM t LEFT JOIN words ON t.id = words.id LEFT JOIN items ON t.id = items.id
"""

ORACLES = {"op4_decontamination": OP4_SQL}
