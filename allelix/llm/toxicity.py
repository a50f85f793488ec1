"""Operator 3: toxicity by a factorization machine over hashed terms.

Terms are 32-bit hashes of lower-cased words and of the first bytes of longer
words, present or not.  Weights for single terms and factors for pairs are
learnt together, so that a pair (an insult with the mention of a group) can
weigh more, or less, than its parts.

Only the fit is bounded: at most ``SAMPLE`` labelled documents of each class, of at
most ``FIT_BYTES`` bytes each, the first in a hash order of their ids and one text for
each id, are reduced to term sets on the executors and gathered; class weights restore the proportions of all labels.  Every document
is scored on its whole text in one pass without a shuffle.

Defined results: a null or empty text has no terms and gets the bias alone;
labels that are null, of unknown documents or held out are not learnt from;
of repeated labels of a document the largest counts; without labels of both
classes the score is the share of label 1 (0 without any) for every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Roller, held_out, text_blocks, word_spans

SAMPLE = 3000
#: A longer text takes no part in the fit (it is scored like any other).
FIT_BYTES = 1 << 18
TERMS = 1024
FACTORS = 6
PREFIX_BYTES = (4, 5)
STEPS, RATE, DECAY = 150, 0.1, 2e-4


def block_terms(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """(text, 32-bit term hash) of every word and word beginning of a block."""
    data = data.copy()
    data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32  # capital letters of Latin-1, in UTF-8
    s, e, first = word_spans(data, offsets, ALNUM)
    prefix = roller.prefix(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    texts, terms = [text], [roller.spans(prefix, s, e)]
    for k in PREFIX_BYTES:
        long = e - s > k
        texts.append(text[long])
        terms.append(roller.spans(prefix, s[long], s[long] + k) ^ np.uint64(0x5851F42D4C957F2D))
    return np.concatenate(texts), (np.concatenate(terms) >> np.uint64(32)).astype(np.uint32)


def term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, distinct terms as little-endian 32-bit values)."""
    roller = Roller(fold=LOWER)
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1)):
            text, term = block_terms(data, offsets, roller)
            cuts = np.searchsorted(np.sort(text, kind="stable"), np.arange(hi - lo + 1))
            term = term[np.argsort(text, kind="stable")]
            sets = [np.unique(term[a:b]).astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], ["label", "terms"])


class Model:
    """bias + sum of w over present terms + sum over pairs of <v_i, v_j>."""

    def __init__(self, bias: float, terms: np.ndarray, w: np.ndarray, v: np.ndarray):
        order = np.argsort(terms)
        self.bias, self.terms, self.w, self.v = bias, terms[order], w[order], v[order]

    def scores(self, n: int, text: np.ndarray, term: np.ndarray) -> np.ndarray:
        raw = np.full(n, self.bias)
        if len(self.terms):
            sieve = np.zeros(1 << 18, bool)
            sieve[(self.terms >> np.uint32(14)).astype(np.int64)] = True
            near = np.flatnonzero(sieve[(term >> np.uint32(14)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, term[near]), len(self.terms) - 1)
            good = self.terms[at] == term[near]
            pairs = np.unique(text[near[good]] * len(self.terms) + at[good])
            t, k = pairs // len(self.terms), pairs % len(self.terms)
            raw += np.bincount(t, self.w[k], n)
            for f in range(self.v.shape[1]):
                x = self.v[k, f]
                raw += 0.5 * (np.bincount(t, x, n) ** 2 - np.bincount(t, x * x, n))
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def fit(labels: np.ndarray, sets: list[np.ndarray], totals: tuple[int, int], seed: int = 42) -> Model:
    """Full-batch Adam on the log loss; terms are chosen by chi-square with the label."""
    n = len(labels)
    if not totals[0] or not totals[1] or len(set(labels.tolist())) < 2:
        share = totals[1] / max(1, sum(totals))
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))), np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)))
    weight = np.where(labels == 1, totals[1] / max(1, (labels == 1).sum()), totals[0] / max(1, (labels == 0).sum()))
    weight = weight / weight.sum()
    vocab, term = np.unique(np.concatenate(sets), return_inverse=True)
    term, doc = term.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    df1 = np.bincount(term[labels[doc] == 1], minlength=len(vocab)).astype(float)
    df = np.bincount(term, minlength=len(vocab)).astype(float)
    n1 = float(labels.sum())
    expect = df * n1 / n
    chi = (df1 - expect) ** 2 / np.maximum(expect * (1 - n1 / n) * (1 - df / (n + 1)), 1e-9)
    chi[df < 3] = 0
    best = np.sort(np.lexsort((vocab, -chi))[:TERMS])
    best = best[chi[best] > 6.6]
    slot = np.full(len(vocab), -1)
    slot[best] = np.arange(len(best))
    keep = slot[term] >= 0
    x = np.zeros((n, len(best)), np.float32)
    x[doc[keep], slot[term[keep]]] = 1
    rng = np.random.default_rng(seed)
    p1 = totals[1] / sum(totals)
    params = [np.array([np.log(p1 / (1 - p1))]), np.zeros(len(best)), rng.normal(0, 0.03, (len(best), FACTORS))]
    params, weight, labels = [p.astype(np.float32) for p in params], weight.astype(np.float32), labels.astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        b, w, v = params
        xv = x @ v
        raw = b[0] + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        err = weight * (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels)
        grads = [np.array([err.sum()]), x.T @ err + DECAY * w, x.T @ (err[:, None] * xv) - v * (x.T @ err)[:, None] + DECAY * v]
        for k, g in enumerate(grads):
            m, s = moments[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            params[k] = (params[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(float(params[0][0]), vocab[best], params[1].astype(float), params[2].astype(float))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that are not held out."""
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES)
    known = known.join(short.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    texts = short.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).join(chosen, "id")
    # One text for each id, however often the id occurs; the maximum is taken before rows are sent.
    texts = texts.groupBy("id").agg(F.max("label").alias("label"), F.max("body").alias("body"))
    rows = texts.select("label", "body").mapInArrow(term_sets, "label int, terms binary").collect()
    rows = sorted((r["label"], r["terms"]) for r in rows)
    return fit(np.array([k for k, _ in rows], float), [np.frombuffer(t, "<u4") for _, t in rows], (totals.get(0, 0), totals.get(1, 0)))


def _scored(batches: Iterator[pa.RecordBatch], column: str, model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with the scores of the texts in a column."""
    roller = Roller(fold=LOWER)
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(column)):
            yield batch.slice(lo, hi - lo), model.scores(hi - lo, *block_terms(data, offsets, roller))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not predict to be toxic, with all their columns, in one pass without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, p in _scored(batches, "text", model):
            yield block.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, p in _scored(batches, "text", model):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
