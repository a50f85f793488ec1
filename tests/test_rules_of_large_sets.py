"""Rule search where most pairs have no sample in common: against all pairs by SQL's own formula, without a row for a pair."""

import itertools

import numpy as np
import pytest

from allelix.operators import scores


@pytest.mark.parametrize("density", [0.03, 0.5])
def test_best_rule_of_all_pairs(spark, monkeypatch, density):
    monkeypatch.setattr(scores, "PAIRS", 50, raising=False)
    rng = np.random.default_rng(int(density * 100))
    n, y = 40, (np.arange(40) % 3 == 0).astype(int)
    on = rng.random((30, n)) < density
    on[rng.integers(0, 30)] = False
    rows = [("x" if f < 18 else "y", f, s) for f, s in zip(*map(list, np.nonzero(on)))]
    df = scores.best_and_not(spark.createDataFrame([(g, int(f), int(s)) for g, f, s in rows], "grp string, f long, sample_id long"), spark.createDataFrame([(k, int(y[k])) for k in range(n)], "sample_id long, y int"), "f", "grp")

    def score(m):
        t, k, p = int(y[m].sum()), int(m.sum()), int(y.sum())
        den = float(k) * p * (n - p) * (n - k)
        return round((t * (n - p - k + t) - (k - t) * (p - t)) / den**0.5, 9) if den > 0 else 0.0

    for g, ids in (("x", range(18)), ("y", range(18, 30))):
        ids = [f for f in ids if on[f].any()]
        rules = [(-score(m), 1, k, f, -1, text) for f in ids for k, (m, text) in enumerate(((on[f], f"{f}"), (~on[f], f"!{f}")))]
        for i, j in itertools.combinations(ids, 2):
            a, b = on[i], on[j]
            rules += [(-score(m), 2, k, i, j, t) for k, (m, t) in enumerate(((a & b, f"{i}&{j}"), (a & ~b, f"{i}&!{j}"), (~a & b, f"!{i}&{j}"), (~a & ~b, f"!{i}&!{j}")))]
        want = min(rules)
        got = [r for r in df.collect() if r["grp"] == g][0]
        assert (got["rule"], got["depth"]) == (want[5], want[1]) and got["score"] == pytest.approx(-want[0], abs=1e-9)
    assert "i#" not in df._jdf.queryExecution().toString()
