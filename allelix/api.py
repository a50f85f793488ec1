"""Objects with fit and predict over the operators, for use from notebooks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .models import farmcpu, mixed, predict, structure
from .operators import assoc, qc


class Study:
    """Calls, sites and phenotypes of one analysis, with quality control applied."""

    def __init__(self, geno: DataFrame, pheno: DataFrame, sites: DataFrame | None = None, maf: float = 0.02, miss: float = 0.05, het: float = 1.0):
        self.rates = qc.qc_filter(geno, maf, miss, het)
        self.geno, self.pheno, self.sites = geno.join(self.rates.select("site_id"), "site_id", "left_semi"), pheno, sites

    def _dense(self) -> tuple[list[int], np.ndarray, DataFrame]:
        known = self.geno.select("sample_id").distinct().join(self.pheno.filter("y is not null"), "sample_id").select("sample_id", "y").orderBy("sample_id").limit(mixed.MAX_SAMPLES + 1).collect()
        samples = [r["sample_id"] for r in known]
        return samples, np.array([r["y"] for r in known], float), mixed.dense_rows(self.geno, samples)


class Association(Study):
    """Association scans: ``model`` is lm, lmm, lmm2, fvlmm or farmcpu."""

    def scan(self, model: str = "lm", covariates: tuple[str, ...] = ()) -> DataFrame:
        if model == "lm":
            return assoc.lm_covariates(self.geno, self.pheno, covariates)
        samples, y, rows = self._dense()
        if model == "farmcpu":
            return farmcpu.farmcpu(rows, self.sites, y)[0]
        spec = mixed.Spectrum(mixed.relationship(rows, len(samples)), y)
        return mixed.scan(rows, spec, model)


class Prediction(Study):
    """Genomic prediction by GBLUP."""

    def fit(self) -> "Prediction":
        self.samples, self.y, self.rows = self._dense()
        self.k = mixed.relationship(self.rows, len(self.samples))
        return self

    def cross_validate(self, folds: int = 5, seed: int = 42):
        order = np.random.default_rng(seed).permutation(len(self.y))
        fold = np.empty(len(self.y), int)
        fold[order] = np.arange(len(self.y)) % folds
        return predict.cross_validate(self.k, self.y, fold)

    def components(self, n: int = 10) -> tuple[np.ndarray, np.ndarray]:
        return structure.principal_components(self.k, n)
