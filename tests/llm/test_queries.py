"""The registered queries: columns and digests of their contracts, on small tables in Parquet."""

import hashlib
from collections import Counter

import duckdb
import pytest

from allelix.llm import queries, simhash
from allelix.llm.common import shared_dir

from .test_other_operators import ARTICLE
from .test_text_operators import SECRETS, brute_contamination, brute_simhash, brute_spans

COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_repeated_strings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op8_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_media_streams": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_token_shards": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}


@pytest.fixture(scope="module", params=["rows", "empty"])
def tables(request, spark, docs, corpus, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    secrets = spark.createDataFrame([(None if i is None else i + 5000, t, "en", "s1", "x") for i, t in SECRETS], docs.schema)
    every = docs.unionByName(secrets)
    item = " ".join(corpus[9][1].split()[:30])
    parts = {
        "documents": every, "labels": spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(120)] + [(None, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item), (2, None), (3, "of the")], "item_id long, text string"),
        "pages": spark.createDataFrame([(1, "http://a.b/c", ARTICLE), (2, None, None)], "page_id long, url string, html string"),
    }
    for name, df in parts.items():
        (df if request.param == "rows" else df.limit(0)).write.parquet(f"{d}/{name}.parquet")
    return str(d), [r for r in every.collect()] if request.param == "rows" else []


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, tables, name):
    path, rows = tables
    df = queries.QUERIES[name](spark, path)
    kinds = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind
    got = df.collect()
    if name != "op7_main_text":
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    if name == "op4_decontamination":
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        unique = Counter(r["doc_id"] for r in rows)
        sql = con.execute(queries.ORACLES[name]).fetchall()
        assert {r for r in sql if unique[r[0]] == 1} == {tuple(r) for r in got if unique[r["doc_id"]] == 1 and r["doc_id"] is not None} | {r for r in sql if r[0] is None and unique[None] == 1}
    if name == "op5_simhash":
        assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((r["doc_id"], f"{brute_simhash(r['text']):016x}") for r in rows)
    if name == "op6_secrets":
        want = Counter()
        for r in rows:
            spans = brute_spans(r["text"])
            joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
            want[r["doc_id"], *(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()] += 1
        assert Counter(tuple(r)[:5] for r in got) == want
    if name == "op7_main_text" and rows:
        assert {(r["page_id"], r["n_chars"]) for r in got} == {(1, len("Head & line One Two three four café AB c1 c2")), (2, 0)}


def test_shared_folder_is_the_sessions(spark):
    path = shared_dir(spark)
    assert path and path == shared_dir(spark)
    assert simhash.stored(spark, spark.range(3), "x").count() == 3


def test_brute_contamination_counts_words():
    assert brute_contamination([(1, "a b c")], [("i", "B c")]) == [(1, 3, 2, 1, ("i",), True)]
