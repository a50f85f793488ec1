"""Queries without SQL that must cover every kept site and run until they are done."""

from allelix.models import structure
from allelix.plans import models

from allelix import catalog

D = "/root/testdata/sf0.001"


def test_bayes_effects_cover_all_kept_sites(spark):
    kept = {r["site_id"] for r in models._dense(spark, D)[2].select("site_id").collect()}
    got = catalog.QUERIES["bayes_effects"](spark, D).collect()
    assert {m: {r["site_id"] for r in got if r["method"] == m} for m in ("A", "B", "Cpi")} == dict.fromkeys(("A", "B", "Cpi"), kept)
    assert len(got) == 3 * len(kept)


def test_admixture_runs_to_its_stopping_rule(spark, monkeypatch):
    asked, em = [], structure.admixture_em

    def recorded(rows, n, k, steps=30, seed=42):
        asked.append(steps)
        return em(rows, n, k, 1, seed)

    monkeypatch.setattr(structure, "admixture_em", recorded)
    catalog.QUERIES["admixture"](spark, D)
    assert asked[0] > 100
