"""Operator 10: token ids in shards, compressed by a Re-Pair grammar.

Texts are encoded in ascending order of their ids; id 2 ends each document.  A
shard holds whole documents.  Its ids are compressed by Re-Pair: in every round
frequent pairs of neighbouring symbols are replaced by new nonterminals, until no
pair occurs ``MIN_COUNT`` times (where a rule takes as much room as it saves).  Pairs
replaced in one round do not overlap (no symbol is the right of one and the left
of another; of a run of one symbol every second place is taken), so a round is a
handful of array operations.  Pairs never span the end of a document; rules and expansion lengths are stored, and any document, or
any range of its ids, is decoded without the others.

Shard layout (little endian): magic ``RPG1``; u32 documents, rules, symbols,
terminals (the last is the end of a document); then i64 ids, u8 null flags of the ids, u32 expanded length of each
document, u32 first symbol of each document and the end; u32 pairs of the rules;
u32 expansion lengths of the rules; u16 symbols, or u32 where any is above 65535.

Encoding by words is exact for tokenizers that normalise and part texts as ``WORDWISE``
says, which is looked up in the tokenizer's file; any other tokenizer encodes whole
texts.  By words, each distinct word between ASCII white space, and each distinct
piece of words, is encoded once while a worker keeps it, and texts are put together from ids.
Pieces of plain words go to the tokenizer's model in its byte letters, other words
through the whole tokenizer.

Scale: one range shuffle puts texts in order, in tasks of about ``TASK_BYTES`` of
input; ids that repeat, or are null, are dealt on by a hash of the text and by the
row's place, so that they fill as many tasks as they need.  A task keeps one shard in
memory.  Only one row for each partition, its number of ids, reaches the driver.

Defined results: a null or empty text has the end id alone; ids that are null come
first; repeated rows are documents of their own, in the order of a hash of their
texts; an empty table writes no shard.  Other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, known_bytes, ranges, stored, text_blocks

END = 2
SHARD_IDS = 1 << 20
SLOT_BITS = 18
PAIRS_A_ROUND, MIN_COUNT = 8192, 16
CACHE_WORDS, REST_WORDS = 800_000, 250_000
TASK_BYTES = 32 << 20
#: How a tokenizer's file says that texts are normalised and parted, where encoding by words is exact.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: The tokenizer's own pieces, and the ends of words.
PIECES = regex.compile(r"\n|" + SPLIT)
MAGIC = b"RPG1"
SHARDS = "part int, seq int, first long, start long, n_ids long, n_docs int, shard binary"


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it prints, else from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
_ENCODERS: dict[str, "WordEncoder"] = {}


def encoder_of(path: str, words: tuple[int, int] | None = None) -> "WordEncoder":
    """The worker's encoder for a file; it keeps the words that it meets often from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].most, _ENCODERS[path].kept = words or (CACHE_WORDS, REST_WORDS)
    return _ENCODERS[path]


class _Numbers(dict):
    """Word to number; unknown words get the next number."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, with room for n values at least."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


class WordEncoder:
    """Encodes texts by way of their distinct words; ``most`` words are known at most, and those of a block."""

    most, kept = CACHE_WORDS, REST_WORDS

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        marks = all(t["content"].startswith("<|") and " " not in t["content"] for t in spec["added_tokens"])
        self.wordwise = marks and spec["model"]["type"] == "BPE" and all(spec[k] == v for k, v in WORDWISE.items())
        self._clear()
        self._clear_pieces()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)

    def rest(self) -> None:
        """Keep less between tasks: a worker may not run this operator's next one."""
        self._evict(self.kept)
        if len(self.pieces) > self.kept:
            self._clear_pieces()

    def _evict(self, most: int) -> None:
        """Keep the words that were met again since the last time, ``most`` at most; many words never are."""
        self.uses = _room(self.uses, len(self.numbers))
        uses = self.uses[: len(self.numbers)]
        bar = 2
        while np.count_nonzero(uses >= bar) > most:
            bar *= 2
        keep = np.flatnonzero(uses >= bar)
        words = list(self.numbers)
        lo = self.first[keep]
        size = self.first[keep + 1] - lo
        flat = self.flat[np.repeat(lo, size) + ranges(size)]
        self._clear()
        self.numbers.update((words[k], n) for n, k in enumerate(keep.tolist()))
        self.flat, self.first = _room(flat, 1), np.concatenate([[0], np.cumsum(size)])

    def _clear_pieces(self) -> None:
        self.pieces = _Numbers()
        self.pieces["\n"]  # number 0, a piece of no ids' use
        self.piece_flat, self.piece_first = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        new = self.numbers.new
        if not new:
            return
        have = len(self.numbers) - len(new)
        # Below U+0130 NFC changes nothing and lower() goes letter by letter, so the pattern gives the tokenizer's own pieces.
        words = b"\n".join(new).decode("utf-8").split("\n")
        plain = [w.isascii() or max(w) < "\u0130" for w in words]
        odd = [k for k, ok in enumerate(plain) if not ok or "<|" in words[k]]
        number = self.pieces.__getitem__
        whole = {k: number((words[k],)) for k in odd}
        for k in odd:
            words[k] = "a"  # a piece in its place, replaced below
        parts = PIECES.findall("\n".join(words).lower())
        piece = np.fromiter(map(number, parts), np.int64, len(parts))
        ends = np.flatnonzero(piece == number("\n"))
        edge = np.concatenate([ends - np.arange(len(ends)), [len(parts) - len(ends)]])  # pieces up to the end of each word
        piece = np.delete(piece, ends)
        for k, n in whole.items():
            piece[edge[k] - 1] = n
        self._learn_pieces()
        lo = self.piece_first[piece]
        size = self.piece_first[piece + 1] - lo
        flat = self.piece_flat[np.repeat(lo, size) + ranges(size)]
        run = np.concatenate([[0], np.cumsum(size)])
        end = self.first[have]
        self.first = _room(self.first, len(self.numbers) + 1)
        self.flat = _room(self.flat, end + len(flat))
        self.flat[end : end + len(flat)] = flat
        self.first[have + 1 : have + 1 + len(new)] = end + run[edge]
        self.numbers.new = []

    def _learn_pieces(self) -> None:
        new = self.pieces.new
        at = len(self.pieces) - len(new)
        tokenize = self.tokenizer.model.tokenize
        got = [
            [t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_LETTERS))]
            if type(p) is str
            else self.tokenizer.encode(p[0], add_special_tokens=False).ids
            for p in new
        ]
        end = self.piece_first[at]
        run = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        self.piece_first = _room(self.piece_first, len(self.pieces) + 1)
        self.piece_first[at + 1 : at + 1 + len(new)] = end + run
        total = int(run[-1]) if len(run) else 0
        self.piece_flat = _room(self.piece_flat, end + total)
        self.piece_flat[end : end + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.pieces.new = []

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with an end id after each, number of ids of each text)."""
        if not self.wordwise:
            return self._encode_whole(data.tobytes(), offsets)
        if len(self.numbers) > self.most:
            self._evict(self.most // 2)
        if len(self.pieces) > self.most:
            self._clear_pieces()
        body = data.tobytes()
        numbers, count = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words = body[a:b].split()
            numbers.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            count.append(len(words))
        self._learn()
        word = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.uses = _room(self.uses, len(self.numbers))
        self.uses[: len(self.numbers)] += np.bincount(word, minlength=len(self.numbers)).astype(np.int32)
        lo = self.first[word]
        size = self.first[word + 1] - lo
        run = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(count)])
        per_text = run[edge[1:]] - run[edge[:-1]] + 1
        out = np.empty(int(per_text.sum()), np.uint32)
        ends = np.cumsum(per_text) - 1
        out[ends] = END
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = self.flat[np.repeat(lo - run[:-1], size) + np.arange(run[-1])]
        return out, per_text


    def _encode_whole(self, body: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [body[a:b].decode("utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        got = [[*x.ids, END] for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum())), count


def repair(
    ids: np.ndarray, terminals: int, end: int, rounds: int | None = None, pairs: int = PAIRS_A_ROUND, min_count: int = MIN_COUNT
) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule r stands for its pair and has symbol terminals + r; the symbol ``end`` is in no pair.

    Rounds go on until no pair occurs ``min_count`` times (2 at least), or for ``rounds`` of them.
    """
    seq, rules, void, min_count = ids.astype(np.uint32), [], 1 << SLOT_BITS, max(2, min_count)
    while len(seq) > 1 and (rounds is None or rounds > 0):
        rounds = None if rounds is None else rounds - 1
        # A pair is one 32-bit code where all symbols fit 16 bits, else one 64-bit code.
        narrow = terminals + len(rules) <= 1 << 16
        kind, half, factor, shift = (np.uint32, 16, 0x9E3779B1, 32 - SLOT_BITS) if narrow else (np.uint64, 32, 0x9E3779B97F4A7C15, 64 - SLOT_BITS)
        a, b = seq[:-1], seq[1:]
        code = a.astype(kind, copy=False) << kind(half)
        code |= b
        slot = code * kind(factor)
        slot >>= kind(shift)
        slot = slot.astype(np.int64)
        twins = np.flatnonzero(a == b)
        if len(twins):  # of a run of one symbol, every second place
            first = np.concatenate([[True], np.diff(twins) != 1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(twins)), 0))
            slot[twins[(np.arange(len(twins)) - begin) % 2 == 1]] = void
        heat = np.bincount(slot, minlength=void + 1)
        heat[void] = 0
        bar = max(min_count, int(np.partition(heat, -2 * pairs)[-2 * pairs]))
        for least in sorted({bar, min_count}, reverse=True):  # the hottest slots may hold nothing but many rare pairs, or ends
            at = np.flatnonzero((heat >= least)[slot])
            found, count = np.unique(code[at], return_counts=True)
            fit = (count >= min_count) & (found >> kind(half) != end) & (found & kind((1 << half) - 1) != end)
            found, count = found[fit], count[fit]
            if len(found):
                break
        code, slot = code[at], slot[at]
        found = found[np.lexsort((found, -count))]
        lefts, rights, taken = set(), set(), []
        for k, x, y in zip(range(len(found)), (found >> kind(half)).tolist(), (found & kind((1 << half) - 1)).tolist()):
            if x not in rights and y not in lefts and (x != y or (x not in lefts and y not in rights)):
                lefts.add(x)
                rights.add(y)
                taken.append(k)
                if len(taken) == pairs:
                    break
        # One pair for each slot of the table, so that a table finds a position's pair; another of the slot waits for the next round.
        taken = found[taken]
        where = (taken * kind(factor)) >> kind(shift)
        _, best = np.unique(where, return_index=True)
        best.sort()
        taken, where = taken[best], where[best].astype(np.int64)
        if not len(taken):
            break
        wanted = np.full(void + 1, np.iinfo(kind).max, kind)
        symbol = np.zeros(void + 1, np.uint32)
        wanted[where] = taken
        symbol[where] = terminals + len(rules) + np.arange(len(taken))
        rules += zip((taken >> kind(half)).tolist(), (taken & kind((1 << half) - 1)).tolist())
        good = wanted[slot] == code
        at = at[good]
        seq[at] = symbol[slot[good]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return seq, np.array(rules, np.uint32).reshape(-1, 2)


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out: list[int] = []
    for x, y in rules.tolist():
        out.append((out[x - terminals] if x >= terminals else 1) + (out[y - terminals] if y >= terminals else 1))
    return np.array(out, np.int64)


def expansions(rules: np.ndarray, sizes: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """(all expansions back to back, first position of each symbol's): terminals first, each its own, then rules."""
    first = np.concatenate([np.arange(terminals + 1), terminals + np.cumsum(sizes)])
    flat = np.empty(int(first[-1]), np.uint32)
    flat[:terminals] = np.arange(terminals)
    at = first.tolist()
    for r, (x, y) in enumerate(rules.tolist()):
        a, b, m = at[terminals + r], at[terminals + r + 1], at[x + 1] - at[x]
        flat[a : a + m] = flat[at[x] : at[x + 1]]
        flat[a + m : b] = flat[at[y] : at[y + 1]]
    return flat, first


def pack(doc_ids: list[int | None], ids: np.ndarray, per_doc: np.ndarray, vocabulary: int, **grammar) -> bytes:
    """One shard.  Inside it, the end of a document is a terminal of its own, as id 2 may also occur in a text.

    ``grammar`` are the parameters of ``repair``.
    """
    terminals = vocabulary + 1
    inner = ids.copy()
    inner[np.cumsum(per_doc) - 1] = vocabulary
    symbols, rules = repair(inner, terminals, vocabulary, **grammar)
    edge = np.concatenate([[0], np.flatnonzero(symbols == vocabulary) + 1])
    wide = len(symbols) and int(symbols.max()) > 0xFFFF
    return b"".join([
        MAGIC, struct.pack("<4I", len(doc_ids), len(rules), len(symbols), terminals),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(),
        per_doc.astype("<u4").tobytes(), edge.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
        lengths(rules, terminals).astype("<u4").tobytes(), symbols.astype("<u4" if wide else "<u2").tobytes(),
    ])


class Shard:
    """Random access to a packed shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        n, r, s, self.terminals = struct.unpack_from("<4I", blob, 4)
        at = 20

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        ids, nulls = read("<i8", n), read("u1", n)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls)]
        self.per_doc, self.edge = read("<u4", n).astype(np.int64), read("<u4", n + 1).astype(np.int64)
        self.rules, self.sizes = read("<u4", 2 * r).reshape(-1, 2), read("<u4", r).astype(np.int64)
        self.symbols = read("<u4" if len(blob) - at == 4 * s and s else "<u2", s)
        flat, first = expansions(self.rules, self.sizes, self.terminals)
        flat[self.terminals - 1] = END  # no rule holds the end of a document
        self.flat, self.first, self.length = flat, first.astype(np.int32), np.diff(first).astype(np.int32)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.length[symbols]
        end = np.cumsum(size)
        at = np.repeat(self.first[symbols] - (end - size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.edge[k] : self.edge[k + 1]])

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k, expanding only the symbols that hold them."""
        part = self.symbols[self.edge[k] : self.edge[k + 1]]
        run = np.concatenate([[0], np.cumsum(self.length[part])])
        a, b = int(np.searchsorted(run, start, "right")) - 1, int(np.searchsorted(run, stop, "left"))
        return self._expand(part[a:b])[start - run[a] : stop - run[a]]

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)


def _encode(path: str, shard_ids: int, words: tuple[int, int] | None, grammar: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, words)
        vocabulary = encoder.tokenizer.get_vocab_size()
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def shard():
            flat, per_doc = np.concatenate(ids), np.concatenate(sizes)
            values = [part, seq, doc_ids[0], start, len(flat), len(doc_ids), pack(doc_ids, flat, per_doc, vocabulary, **grammar)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            names = ["part", "seq", "first", "start", "n_ids", "n_docs", "shard"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        gc.disable()  # what is made here has no cycles
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1), 4 << 20):
                got, per_doc = encoder.encode(data, offsets)
                doc_ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                ids.append(got)
                sizes.append(per_doc)
                held += len(got)
                if held >= shard_ids:
                    yield shard()
                    seq, start, held = seq + 1, start + held, 0
                    doc_ids, ids, sizes = [], [], []
        if doc_ids:
            yield shard()
        encoder.rest()
        gc.enable()
        give_back()

    return run


def parts_for(docs: DataFrame) -> int:
    """Tasks of about ``TASK_BYTES`` of input, as Spark knows its size; two for each core at least."""
    spark = docs.sparkSession
    size = known_bytes(docs)
    if size is None:
        size = TASK_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def write_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS, words: tuple[int, int] | None = None, **grammar) -> DataFrame:
    """Encode and write; returns the shard table as read back from its files.

    ``words`` are how many words a worker remembers, within a task and from task to task:
    fewer take less memory and more time.  ``grammar`` are the parameters of ``repair``.
    """
    order = ["doc_id", "hash", "place"]
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")
    )
    ordered = source.repartitionByRange(parts_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(docs.sparkSession, ordered.mapInArrow(_encode(path, shard_ids, words, grammar), SHARDS), "shards")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part, start, blob in zip(parts, starts, batch.column(2).to_pylist()):
            shard = Shard(blob)
            flat = shard.all().astype("<u4")
            edge = np.concatenate([[0], np.cumsum(shard.per_doc)])
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            n = len(shard.doc_ids)
            columns = [pa.array([part] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(start + edge[:-1]), pa.array(shard.per_doc), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards."""
    spark: SparkSession = shards.sparkSession
    parts = shards.groupBy("part").agg(F.min("part").alias("p"), F.sum("n_ids").alias("n")).collect()
    run, table = 0, []
    for r in sorted(parts, key=lambda r: r["part"]):  # range partitions are numbered in ascending order
        table.append((r["part"], run))
        run += r["n"]
    before = F.broadcast(spark.createDataFrame(table, "part int, before long"))
    rows = shards.select("part", "start", "shard").mapInArrow(_digests, "part int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
