"""Pages, mixing, media, token files and the pipeline: brute force, round trips, invariants."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from allelix.llm import htmltext, mixing, mpegts, queries, tokens

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href=x>Home</a><li>About</ul></nav><!-- ad --><div class="ad">Buy</div>
<main><aside>See also</aside><article><h1>Head &amp; line</h1><p><b>One<br><p>Two\n  three&nbsp;four<p>caf&eacute; &#x41;&#66;
<script>if (a<b) x("</article>")</script><div class="comments"><article><p>First!</article></div><form><p>Mail</form>
<table><tr><td>c1<td>c2</table></article></main><div id='cookie-notice'>We use</div><footer>&copy; x</footer></body></html>"""


def text_of(page):
    lines = htmltext.lines_of(page)
    kept = [x for x in lines if x[1] != htmltext.GONE]
    best = max((p for _, p in kept), default=0)
    return " ".join(t for t, p in kept if p == best)


def test_article_without_its_surroundings():
    assert text_of(ARTICLE) == "Head & line One Two three four café AB c1 c2"
    assert text_of("") == "" and text_of("no markup < 3 &lt;") == "no markup < 3 <"
    assert text_of("<p>a<!-- never ends") == "a" and text_of("<script>x") == "" and text_of("<div><p>a<p>b") == "a b"
    assert text_of('<p title="a>b">x</p>') == "x" and text_of("<p title='unclosed>x</p>") == "x"
    assert text_of("<article><header><h1>T</h1></header><p>x</p></article>") == "T x"


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=150, deadline=None)
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    at = htmltext.shared(a, b)
    picked, rest = [a[i] for i in at], iter(b)
    assert len(at) == table[-1][-1] and at == sorted(set(at)) and all(x in rest for x in picked)


@pytest.mark.parametrize("bits", [1 << 27, 500])
def test_alignment_of_lines_that_repeat_hundreds_of_times(bits, monkeypatch):
    monkeypatch.setattr(htmltext, "TABLE_BITS", bits)
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 3, 260).tolist(), rng.integers(0, 3, 240).tolist()
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    at = htmltext.shared(a, b)
    rest = iter(b)
    assert len(at) == table[-1, -1] and at == sorted(set(at)) and all(a[i] in rest for i in at)
    assert len(htmltext.shared([1] * 200 + [2], [3] + [1] * 150)) == 150 and htmltext.shared([1] * 200, [1] * 150 + [4]) == list(range(150))


def test_shared_lines_go_and_content_stays(spark):
    page = lambda body: f"<body><div>Menu one</div><div>{body}</div><div>All rights</div></body>"
    rows = [(k, f"http://h.example/a/{k}", page(f"story {k}"), "clash") for k in range(30)]
    rows += [(100, "http://alone.example/x", page("alone"), "c"), (101, None, None, "c"), (102, "http://h.example/b", "", "c"), (103, "::bad[", page("odd"), "c")]
    rows += [(0, "http://h.example/a/0", page("story 0"), "clash"), (None, "http://art.example/a/31", ARTICLE, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((r["page_id"], r["url"], r["text"]) for r in htmltext.extract(df).collect())
    assert got[0, "http://h.example/a/0", "story 0"] == 2
    assert all(got[k, f"http://h.example/a/{k}", f"story {k}"] == 1 for k in range(3, 29))
    assert got[100, "http://alone.example/x", "Menu one alone All rights"] == 1 and got[101, None, ""] == 1 and got[102, "http://h.example/b", ""] == 1
    assert got[None, "http://art.example/a/31", "Head & line One Two three four café AB c1 c2"] == 1
    assert sum(got.values()) == len(rows)
    assert htmltext.extract(df.limit(0)).collect() == []


def brute_quotas(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    t = {s: 0.0 for s in order}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        for s in free:
            t[s] = rest * w[s] / sum(w[x] for x in free)
        over = {s for s in free if t[s] > 3 * sizes[s]}
        for s in over:
            t[s] = 3.0 * sizes[s]
        if not over:
            return t
        capped |= over


def test_pages_in_a_run_of_copies_pair_with_the_nearest_that_differs(spark):
    page = lambda body: f"<html><body><p>Menu</p>{body}<p>Foot</p></body></html>"
    main = lambda body: f"<html><body><p>Menu</p><main><p>Notice</p>{body}</main></body></html>"
    rows = [(k, f"http://a.b/p{k}", page("<p>Copied text</p>")) for k in range(1, 8)]
    rows += [(8, "http://a.b/p8", page("<p>Other text</p>"))]
    rows += [(9, "http://m.b/1", main("<p>One</p>")), (10, "http://m.b/2", main("<p>Two</p>"))]
    rows += [(k, f"http://c.b/{k}", page("<p>Alike</p>")) for k in (11, 12, 13)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(1, 8), "Copied text") | {8: "Other text", 9: "Notice One", 10: "Notice Two"} | dict.fromkeys((11, 12, 13), "Menu Alike Foot")


def test_quotas():
    for sizes in ({"a": 10, "b": 1000, None: 5, "c": 2}, {"a": 1}, {"x": 0, "y": 9}, {f"s{k}": k * k + 1 for k in range(30)}):
        want = brute_quotas(sizes)
        got = mixing.quotas(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_flow_spreads_repetition_and_serves_overlaps():
    given_words = mixing.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 100})
    assert sum(given_words.values()) == 220 and given_words[("a", "b")] <= 150 and given_words[("b",)] <= 30
    assert mixing.route({("a",): 10}, {"a": 25}) == {("a",): 25}
    assert mixing.route({("a",): 10}, {"a": 99}) == {("a",): 30}


def test_mix_meets_its_targets(docs, corpus, no_docs):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert Counter(rows) == Counter(again)
    assert len(rows) == len(corpus)
    size = Counter()
    for _, t, _, s, _ in corpus:
        size[s] += len((t or "").split())
    want = mixing.quotas(size)
    taken = Counter()
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) and r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    # s1 has one text of 30,000 words, above its target: its other texts are then used three times each
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in size if size[s] and s != "s1")
    assert taken["s1"] == 3 * (size["s1"] - 30_000) < want["s1"]
    assert mixing.mix_sources(no_docs).collect() == []


def test_mix_with_memberships(spark):
    rows = [(k, "w " * (k % 9 + 1), None, ["a"] if k % 3 else ["a", "b"]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, members array<string>")
    got = mixing.mix_sources(df, members_col="members", targets={"a": 400.0, "b": 300.0}).collect()
    assert len(got) == 300 and abs(sum(r["taken"] for r in got) - 700) < 20


@pytest.mark.parametrize("small", [50_000, 5])
def test_rows_without_ids_and_repeats_meet_the_target(spark, small, monkeypatch):
    """A third of the rows are one row over and over, another third have no id; both are cut where the target is."""
    monkeypatch.setattr(mixing, "SMALL_BIN", small)
    rows = [(7, "five words of one row", "c")] * 2000 + [(None, "w " * (k % 7 + 2) + str(k), "d") for k in range(2000)] + [(k, "a b c", "ab"[k % 2]) for k in range(6000)]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, source string, members array<string>")
    got = mixing.mix_sources(df).collect()
    for s in "abcd":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.002 * mine[0]["target"] + 3
    none = mixing.mix_sources(df, members_col="members").collect()
    assert len(none) == len(rows) and not any(r["taken"] for r in none)


def test_flow_of_many_patterns_is_optimal_and_quick():
    import time

    rng = np.random.default_rng(3)
    patterns = {}
    for _ in range(3000):
        patterns[tuple(sorted({f"s{int(x)}" for x in rng.integers(0, 40, rng.integers(1, 5))}))] = int(rng.integers(1, 1000))
    total = sum(patterns.values())
    began = time.time()
    given_words = mixing.route(patterns, {f"s{k}": 2 * total / 40 for k in range(40)})
    assert time.time() - began < 20 and abs(sum(given_words.values()) - 2 * total) <= 40
    # convex costs: with every target within reach, no pattern is used a third time while another is not used twice
    assert sum(max(0, g - 2 * patterns[p]) for p, g in given_words.items()) <= 0.1 * total


def test_mixing_stage_keeps_columns_and_repeats_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(None if k % 3 == 0 else k // 2, "w " * (k % 5 + 1) + str(k), "ab"[k % 7 == 0], k, k, "x") for k in range(1500)] + [(1, None, None, 0, 0, "x"), (None, "", "a", 0, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, id long, times int, copy string")
    df.write.parquet(str(tmp_path / "d"))
    for docs in (df, spark.read.parquet(str(tmp_path / "d"))):
        out = corpus_pipeline.mix_to_weights(spark, docs, "")
        assert out.columns == df.columns
        got = Counter(map(tuple, out.collect()))
        assert set(got) <= set(rows) and max(got.values()) <= 3
        taken, size = Counter(), Counter()
        for r in rows:
            size[r[2]] += len((r[1] or "").split())
            taken[r[2]] += len((r[1] or "").split()) * got[r]
        want = mixing.quotas(size)
        assert all(abs(taken[s] - want[s]) <= 0.002 * want[s] + 5 for s in want)
    assert corpus_pipeline.mix_to_weights(spark, df.limit(0), "").collect() == []


def test_cut_narrows_hot_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL_BIN", 3)
    df = spark.createDataFrame([(k, "w " * (k % 5 + 1), "ab"[k % 7 == 0]) for k in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2


@given(st.binary(max_size=30_000))
@settings(max_examples=40, deadline=None)
def test_streams_round_trip(text):
    payload = mpegts.padded(text)
    media = mpegts.mux(payload)
    s = mpegts.Stream(media)
    assert s.payload == payload and len(media) % 188 == 0 and s.stream_type == mpegts.STREAM_TYPE
    assert s.timestamps == [k * 16 * 1080 for k in range(len(s.timestamps))]
    assert len(s.random_access) == len(s.timestamps) and s.seek(s.timestamps[-1]) == s.random_access[-1]


def test_damage_is_found():
    media = bytearray(mpegts.mux(mpegts.padded(b"x" * 20_000)))
    for at, value in ((0, 0), (10, 99), (188 * 3 + 3, 0x10), (188 * 5, 1)):
        bad = bytearray(media)
        bad[at] = value
        with pytest.raises(mpegts.StreamError):
            mpegts.Stream(bytes(bad))
    for bad in (b"", bytes(media[:-1]), bytes(media[: 188 * 2]), bytes(media[: 188 * 8] + media[188 * 9 :])):
        with pytest.raises(mpegts.StreamError):
            mpegts.Stream(bad)


def test_media_table(docs, corpus, no_docs):
    rows = mpegts.to_media(docs).collect()
    assert Counter((r["doc_id"], mpegts.Stream(bytes(r["media"])).payload) for r in rows) == Counter((i, mpegts.padded((t or "").encode())) for i, t, *_ in corpus)
    for r in rows:
        s = mpegts.Stream(bytes(r["media"]))
        assert s.timestamps == r["timestamps"] and s.random_access.tolist() == r["access_points"]
    assert mpegts.to_media(no_docs).collect() == []


def test_streams_are_read_back_from_the_stored_table(spark, docs, corpus, tmp_path):
    """Digests against a plain computation, and damage in the stored table is found."""
    import hashlib

    path = str(tmp_path / "media")
    mpegts.to_media(docs).write.parquet(path)
    got = mpegts.describe(spark.read.parquet(path)).collect()
    want = []
    for i, t, *_ in corpus:
        body = (t or "").encode()
        padded = body + b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        want.append((i, len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert len({(r["media_sha256"], r["feature"]) for r in got}) == len({t or "" for _, t, *_ in corpus})
    bad = spark.read.parquet(path).withColumn("timestamps", F.transform("timestamps", lambda x: x + 1))
    with pytest.raises(Exception, match="not what its columns say"):
        mpegts.describe(bad).collect()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


TRICKY = ["don't 'S we'll  x'", "ÀÉÎ straße İstanbul ΟΔΟΣ ǅ", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd\x85e", "é ́x #\n## ###", "１２ 3½ ², 中文字 한글", "\x00\x01 ﻿", "", " ", "A1b2!!c 😀👍🏽"]


def test_words_encode_like_whole_texts(plain):
    import pyarrow as pa

    from allelix.llm.common import text_blocks

    e = tokens.WordEncoder(queries.vocabulary_path())
    for _ in range(2):
        for lo, hi, data, offsets in text_blocks(pa.array(TRICKY)):
            ids, count = e.encode(data, offsets)
            want = [plain.encode(t, add_special_tokens=False).ids + [tokens.END] for t in TRICKY]
            assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_any_text_encodes_like_the_tokenizer(plain, texts):
    import pyarrow as pa

    from allelix.llm.common import text_blocks

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    e = tokens.encoder_of(queries.vocabulary_path())
    for _, _, data, offsets in text_blocks(pa.array(texts)):
        ids, _ = e.encode(data, offsets)
        assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids + [tokens.END]]


@pytest.mark.parametrize("vocabulary", [49408, 100_000])
def test_grammar_round_trip_and_random_access(vocabulary):
    rng = np.random.default_rng(2)
    docs = [np.append(rng.zipf(1.4, n) % 500 + (60_000 if vocabulary > 1 << 16 else 0), tokens.END).astype(np.uint32) for n in (0, 1, 5000, 3, 20_000, 777)]
    docs[3][:2] = tokens.END  # the end id may also occur in a text
    flat, per = np.concatenate(docs), np.array([len(x) for x in docs])
    blob = tokens.pack([7, None, 9, 9, 10, 11], flat, per, vocabulary)
    s = tokens.Shard(blob)
    assert s.doc_ids == [7, None, 9, 9, 10, 11] and (s.all() == flat).all() and len(s.rules) > 10
    assert len(s.symbols) < 0.8 * len(flat)
    for k, x in enumerate(docs):
        assert (s.document(k) == x).all()
        for a, b in ((0, len(x)), (len(x) // 3, len(x) // 2), (len(x) - 1, len(x))):
            assert (s.slice(k, a, b) == x[a:b]).all()
    size = s.sizes
    assert all(size[r] == sum(1 if x < s.terminals else size[x - s.terminals] for x in pair) for r, pair in enumerate(s.rules.tolist()))


def test_repair_replaces_the_most_frequent_pair_first():
    seq, rules = tokens.repair(np.array([5, 6, 7] * 50 + [8, 9] * 20, np.uint32), 100, 99, rounds=1, pairs=1, min_count=2)
    assert rules.tolist() == [[5, 6]] or rules.tolist() == [[6, 7]]
    assert len(seq) == 140


def test_grammar_to_the_end_and_runs_of_one_symbol():
    rng = np.random.default_rng(9)
    flat = np.concatenate([np.full(1000, 7), rng.integers(0, 4, 3000), np.tile([1, 2, 3, 9], 200)]).astype(np.uint32)
    for least in (2, 16):
        seq, rules = tokens.repair(flat, 100, 99, min_count=least)
        pairs, last = Counter(), None
        for k, p in enumerate(zip(seq.tolist(), seq[1:].tolist())):  # places of a pair that do not overlap
            if p != last or p[0] != p[1]:
                pairs[p] += 1
                last = p
            else:
                last = None
        assert max(pairs.values()) < least and len(seq) < 1500
        out = seq.tolist()
        for r in range(len(rules) - 1, -1, -1):
            out = [y for x in out for y in (rules[r].tolist() if x == 100 + r else [x])]
        assert out == flat.tolist()


def test_grammar_where_most_pairs_hold_the_end(monkeypatch):
    flat = np.array(([5, 99] * 400 + [6, 99] * 300 + [1, 2] * 20), np.uint32)
    seq, rules = tokens.repair(flat, 100, 99, pairs=1)
    assert rules[0].tolist() == [1, 2] and (seq == 99).sum() == 700


@pytest.mark.parametrize("name", ["cased", "byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(spark, tmp_path, name):
    from tokenizers import Tokenizer, models, pre_tokenizers

    if name == "cased":
        t = Tokenizer(models.BPE({"A": 0, "a": 1, "b": 2, "B": 3, "ab": 4}, [("a", "b")]))
        t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        path = str(tmp_path / "t.json")
        t.save(path)
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
    texts = ["AB ab", "ab  ba A", "", None, "aAbB"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokens.read_documents(tokens.write_shards(df, path)).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_repeated_ids_fill_several_tasks(spark):
    rows = [(None, f"text {k}") for k in range(300)] + [(4, "the same")] * 300 + [(k, "x y") for k in range(5, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shards = tokens.write_shards(df, queries.vocabulary_path())
    assert shards.filter("first is null").select("part").distinct().count() > 1 and shards.filter("first = 4").select("part").distinct().count() > 1
    got = sorted(tokens.read_documents(shards).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert [r["doc_id"] for r in got] == [None] * 300 + [4] * 300 + list(range(5, 20))


@pytest.mark.parametrize("shard_ids", [1 << 20, 500])
def test_token_files(spark, docs, corpus, no_docs, plain, shard_ids):
    got = tokens.read_documents(tokens.write_shards(docs, queries.vocabulary_path(), shard_ids)).collect()
    run, want = 0, []
    for i, t in sorted(((r[0], r[1]) for r in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, run, len(ids), zlib.crc32(ids.tobytes())))
        run += len(ids)
    assert Counter(map(tuple, got)) == Counter(want)
    assert tokens.read_documents(tokens.write_shards(no_docs, queries.vocabulary_path())).collect() == []


def _tables(spark, path, docs, labels, items):
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_stages(spark, docs, corpus, no_docs, tmp_path):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "token_files"]
    item = " ".join(corpus[9][1].split()[:40])
    _tables(spark, str(tmp_path / "a"), docs, [(i, 1, int(i % 17 == 0)) for i in range(100)], [(1, item)])
    d, seen = docs, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path / "a"))
        assert d.columns == docs.columns, name
        d.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        seen.append(d.count())
    near = spark.read.parquet(str(tmp_path / "simhash"))
    assert near.filter("doc_id = 135").count() <= 1
    clean = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "decontamination")).collect()}
    assert 9 not in clean and None not in clean and len(clean) > 80  # the row without an id is a copy of document 5
    out = pipeline.run(spark, str(tmp_path / "a")).collect()
    assert len(out) == d.count() and {r["doc_id"] for r in out} == {r["doc_id"] for r in d.collect()}
    _tables(spark, str(tmp_path / "b"), no_docs, [], [])
    assert pipeline.run(spark, str(tmp_path / "b")).collect() == []


def test_registry():
    import __spark_entry__ as entry

    q = entry.queries()
    assert {k.split("_")[0] for k in q if k.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in q
    assert set(entry.oracle_sql()) <= set(q)
