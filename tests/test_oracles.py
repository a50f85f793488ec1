"""Every registered query with SQL returns the rows that DuckDB returns for it, on small tables made here."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

from allelix.catalog import ORACLES, QUERIES


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    """Tables with the columns of the driver's, smaller, with a few awkward values."""
    import random

    rng, d = random.Random(11), tmp_path_factory.mktemp("sf")
    put = lambda name, rows, columns, kinds=None: pd.DataFrame(rows, columns=columns).astype(kinds or {}).to_parquet(d / f"{name}.parquet", index=False, coerce_timestamps="us")
    day = dt.datetime(2024, 1, 1)
    put("supplier", [(k, f"S{k}", k % 25, round(rng.uniform(-900, 9000), 2)) for k in range(30)], ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], {"s_nationkey": "int32"})
    put("part", [(k, "p", f"Brand#{k % 9}", ("ECONOMY", "PROMO")[k % 2], 1 + k * 7 % 50, 900 + k % 13 / 10) for k in range(160)], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], {"p_size": "int32"})
    put("customer", [(k, f"C{k}", k % 25, 1.5 * k, "X") for k in range(90)], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    put("orders", [(k, rng.randrange(90), "F", 10.0 * k, day, "1") for k in range(700)], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    put("lineitem", [(rng.randrange(700), rng.randrange(160), rng.randrange(30), 1 + k % 7, float(rng.randint(1, 50)), round(rng.uniform(1000, 90000), 2), 0.05, 0.01, "ANR"[k % 3], "F", day) for k in range(6000)],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"], {"l_linenumber": "int32"})
    put("events", [(k, day + dt.timedelta(minutes=rng.randrange(40000), seconds=k), rng.randrange(40), ("click", "view", "error", "signup", "purchase")[rng.randrange(5)], round(rng.uniform(0, 30), 2), '{"k": %d}' % (k % 90)) for k in range(900)],
        ["event_id", "ts", "user_id", "event_type", "value", "props"])
    put("embeddings", [(k, [rng.gauss(0, 0.1) for _ in range(64)], k % 3) for k in range(40)], ["vec_id", "embedding", "label"], {"label": "int32"})
    put("documents", [(k, " ".join("".join(rng.choice("etaoin shrdlué") for _ in range(9)) for _ in range(60)), "en", f"src{k % 20}", 100) for k in range(60)], ["doc_id", "text", "lang", "source", "n_chars"])
    return str(d)


def tidy(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.7g}") + 0.0
    return v


def rows(pdf):
    pdf = pdf.reindex(sorted(pdf.columns), axis=1)
    return list(pdf.columns), sorted((tuple(tidy(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("supplier", "part", "customer", "orders", "lineitem", "events", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(con.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == pytest.approx(b, rel=1e-5, abs=1e-5) if all(not isinstance(x, (str, dt.datetime, list, bool)) and x is not None for x in a) else all(x == y or x == pytest.approx(y, rel=1e-5, abs=1e-5) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and len(df.collect()) > 0 or name in ("king_unrelated", "ld_prune")
