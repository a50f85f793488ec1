"""Operator 1: language identification by a byte convolutional network.

A text is cut into fixed windows of ``WINDOW`` bytes, the last one padded.  Bytes
are folded to ``ALPHABET`` classes; filters of several widths slide over the
window, their maxima go through one ReLU layer's pooling into a softmax.  The
network is trained in numpy on labelled windows; a text's language is the one
with the largest mean log-probability over all of its windows.

For scoring, the sum of a filter's weights over two neighbouring bytes is
tabulated, so a filter of width w costs w/2 table rows at a byte.

Only the fit is bounded: about ``SAMPLE`` documents of each language, the first
in a hash order of their ids, give ``WINDOWS_EACH`` windows each.  Every document
is then scored on its whole text in one pass without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0;
languages that are null are not learnt; without any labelled text every text is
``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ranges, text_blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
ALPHABET = 64
SAMPLE = 400
WINDOWS_EACH = 3
EPOCHS, BATCH, RATE = 8, 64, 0.02
UNKNOWN = "und"
#: Windows scored at a time.
SLICE = 256
MAX_LANGUAGES = 1000


def fold_table() -> np.ndarray:
    """Byte to class: 0 padding, a-z, digits, white space and controls, punctuation, lead bytes, 32 classes of continuation bytes."""
    t = np.full(256, 29, np.uint8)
    t[0x61:0x7B] = np.arange(1, 27)
    t[0x41:0x5B] = np.arange(1, 27)
    t[0x30:0x3A] = 27
    t[:0x21] = 28
    t[0x80:0xC0] = 32 + np.arange(64) % 32  # capital and small Latin-1 letters share a class
    t[0xC0:] = 30
    t[0xC3] = 31
    return t


FOLD = fold_table()


def window_starts(offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, text) of every window of every text, in order."""
    count = -(-np.diff(offsets) // window)
    text = np.repeat(np.arange(len(count)), count)
    return offsets[:-1][text] + ranges(count) * window, text


def window_classes(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Byte classes of windows, padded with class 0 from the end of the text on."""
    at = start[:, None] + np.arange(window)
    inside = at < end[:, None]
    classes = FOLD[data[np.minimum(at, max(len(data) - 1, 0))]]
    classes[~inside] = 0
    return classes


class Network:
    """Embedding-free convolution: filter weights are indexed by offset and byte class."""

    def __init__(self, languages: list[str], seed: int = 42):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: rng.normal(0, 0.3, (w, ALPHABET, FILTERS)).astype(np.float32) for w in WIDTHS}
        hidden = FILTERS * len(WIDTHS)
        self.out = rng.normal(0, 0.1, (hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of every filter in each window, and where it is."""
        best, where = [], []
        for w, f in self.filters.items():
            m = x.shape[1] - w + 1
            y = f[0][x[:, :m]]
            for k in range(1, w):
                y = y + f[k][x[:, k : k + m]]
            at = y.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, rows for pairs of classes (and for the last one of an odd width)."""
        out = {}
        for w, f in self.filters.items():
            pairs = [(f[k][:, None] + f[k + 1][None]).reshape(-1, FILTERS) for k in range(0, w - 1, 2)]
            out[w] = pairs + ([f[w - 1]] if w % 2 else [])
        return out

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        z = np.maximum(hidden, 0) @ self.out + self.bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss: filters in the order of ``WIDTHS``, weights, bias."""
        hidden, where = self.pool(x)
        err = np.exp(self.logits(hidden))
        err[np.arange(len(x)), y] -= 1
        err /= len(x)
        back = (err @ self.out.T) * (hidden > 0)
        grads = []
        for j, w in enumerate(WIDTHS):
            part = slice(j * FILTERS, (j + 1) * FILTERS)
            g = np.zeros_like(self.filters[w])
            for k in range(w):
                cls = np.take_along_axis(x, where[:, part] + k, 1)
                np.add.at(g[k], (cls, np.arange(FILTERS)[None]), back[:, part])
            grads.append(g)
        return [*grads, np.maximum(hidden, 0).T @ err, err.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(order), BATCH):
                rows, step = order[a : a + BATCH], step + 1
                for p, g, (m, s) in zip(params, self.gradients(x[rows], y[rows]), moments):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 42) -> Network:
    """Fit on texts that are not held out; the same number of each language."""
    known = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("lang").alias("label"))
    known = known.filter(~held_out(F.col("id")) & F.col("label").isNotNull() & F.col("body").rlike(r"\p{L}"))
    known = known.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1) / float(1 << 63))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    net = Network(languages, seed)
    if not languages:
        return net
    spark = docs.sparkSession
    share = F.broadcast(spark.createDataFrame([(k, 1.2 * sample / n) for k, n in counts.items()], "label string, share double"))
    some = known.join(share, "label").filter("h < share")
    for k in range(WINDOWS_EACH):
        some = some.withColumn(f"w{k}", F.expr(f"substring(body, cast(1 + pmod(xxhash64({seed + k}, id), greatest(length(body) - {WINDOW}, 1)) as int), {WINDOW})"))
    columns = ["label", *(f"w{k}" for k in range(WINDOWS_EACH))]
    rows = some.select("h", *columns).orderBy("h", *columns).limit(int(1.5 * sample * len(languages))).select(*columns).collect()
    texts, y = [], []
    for r in rows:
        for k in range(WINDOWS_EACH):
            texts.append(r[f"w{k}"])
            y.append(languages.index(r["label"]))
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        b = FOLD[np.frombuffer(t.encode()[:WINDOW], np.uint8)]
        x[i, : len(b)] = b
    net.fit(x, np.array(y), seed)
    return net


def _pooled(net_tables: dict[int, list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """What ``Network.pool`` gives, from the tables."""
    pair = (x[:, :-1].astype(np.int16) << 6) | x[:, 1:]  # ALPHABET is 64
    best = []
    for w, tables in net_tables.items():
        m = x.shape[1] - w + 1
        y = tables[0][pair[:, :m]]
        for k, t in enumerate(tables[1:], 1):
            y += t[pair[:, 2 * k : 2 * k + m]] if len(t) > ALPHABET else t[x[:, 2 * k : 2 * k + m]]
        best.append(y.max(1))
    return np.concatenate(best, 1)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                n = hi - lo
                total = np.zeros((n, max(len(net.languages), 1)))
                start, text = window_starts(offsets)
                for a in range(0, len(text) if net.languages else 0, SLICE):
                    some = text[a : a + SLICE]
                    x = window_classes(data, start[a : a + SLICE], offsets[1:][some])
                    np.add.at(total, some, net.logits(_pooled(tables, x)))
                count = np.bincount(text, minlength=n)
                mean = total / np.maximum(count, 1)[:, None]
                best = mean.argmax(1)
                p = np.exp(mean - mean.max(1, keepdims=True))
                score = (p.max(1) / p.sum(1))
                good = np.asarray(batch.column(2).slice(lo, n)).astype(bool) & (count > 0) & bool(net.languages)
                names = np.array([*net.languages, UNKNOWN], object)
                pred = np.where(good, names[np.minimum(best, len(names) - 1)], UNKNOWN)
                columns = [batch.column(0).slice(lo, n), pa.array(pred, pa.string()), pa.array(np.where(good, score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), letters)
    out = source.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
