"""The analyzers by name: operator, least length and reading. analyze() gives the common result shape for all series at once."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftwood.functions.results import READINGS, to_result
from driftwood.operators import distributions as dist, geometry as geo, networks as net, numeric as num, order_statistics as order, windows as win


class InvalidParameter(ValueError):
    def __init__(self, name: str, value: object, constraint: str):
        super().__init__(f"parameter {name} is {value!r}, must be {constraint}")
        self.name, self.value, self.constraint = name, value, constraint


@dataclass(frozen=True)
class Analyzer:
    """config overrides the operator's defaults. A series shorter than least has status insufficient_data and no metrics, one
    with a value that isn't finite has validation, and one that the operator refuses has analysis_failed."""

    framework: str
    operator: Callable[..., DataFrame]
    least: int
    reading: Callable[[], Column] | None = None
    config: dict = field(default_factory=dict)

    def configured(self, **config) -> Analyzer:
        """With other settings of the operator; InvalidParameter for names that it doesn't know and for numbers below 0."""
        known = inspect.signature(getattr(self.operator, "rows", None) or inspect.unwrap(self.operator)).parameters
        for name, value in config.items():
            if name not in known:
                raise InvalidParameter(name, value, f"one of {sorted(set(known) - {'d', 's', 'x', 'y'})}")
            if isinstance(value, (int, float)) and not isinstance(value, bool) and value < 0:
                raise InvalidParameter(name, value, "0 or more")
        return Analyzer(self.framework, self.operator, self.least, self.reading, self.config | config)

    def validate(self, series: DataFrame) -> DataFrame:
        """series_id, n, status of each series."""
        bad = F.max((F.isnan("value") | (F.abs("value") == float("inf"))).cast("int")) if "value" in series.columns else F.lit(0)
        return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).select("series_id", "n", F.when(F.col("n") < self.least, "insufficient_data").when(F.col("bad") == 1, "validation").otherwise("ok").alias("status"))

    def recommend(self, results: DataFrame) -> list[str]:
        """Advice on results; no analyzer has any yet."""
        return []

    def visualization_data(self, metrics: DataFrame, x: str, y: str) -> DataFrame:
        """(series_id, x, y) of an operator's rows, for plotting."""
        return metrics.select("series_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def analyze(self, series: DataFrame) -> DataFrame:
        told = to_result(self.operator(series, **self.config), self.framework, self.reading() if self.reading else None)
        checked = self.validate(series).select("series_id", F.col("status").alias("checked"))
        joined = checked.join(told, "series_id", "left")
        ok = (F.col("checked") == "ok") & F.coalesce(F.col("status") == "ok", F.lit(False))
        kept = [F.when(ok, F.col(c)).alias(c) for c in ("metrics", "p_value", "interpretation", "metadata")]
        return joined.select("series_id", F.lit(self.framework).alias("framework"), F.when(F.col("checked") != "ok", F.col("checked")).otherwise(F.coalesce("status", F.lit("analysis_failed"))).alias("status"), *kept)


def _of(framework: str, operator: Callable, least: int, reading: str | None = None, **config) -> Analyzer:
    return Analyzer(framework, operator, least, READINGS.get(reading) if reading else None, config)


ANALYZERS: dict[str, Analyzer] = {
    "chi_squared": _of("Chi-Squared Test", dist.chi_squared_test, 30, "chi_squared_test"),
    "kolmogorov_smirnov": _of("Kolmogorov-Smirnov Test", order.ks_test, 20, "ks_test"),
    "anderson_darling": _of("Anderson-Darling Test", order.anderson_darling, 8, "anderson_darling_normal"),
    "dirichlet": _of("Dirichlet-Multinomial Bayesian Model", dist.dirichlet_log_evidence, 10),
    "metropolis": _of("Metropolis-Hastings", num.metropolis_hastings, 2),
    "birkhoff": _of("Birkhoff Ergodic Theorem", win.birkhoff_ratio, 100, "birkhoff_ratio"),
    "mixing": _of("Mixing Properties & Autocorrelation", win.mixing_summary, 100, "mixing_summary"),
    "partition_balance": _of("Partition Balance (Chi-Squared)", dist.partition_balance, 50, "partition_balance"),
    "parity": _of("Parity Distribution Test", dist.parity_test, 50, "parity_test"),
    "finite_field": _of("Finite Field GF(p)", dist.finite_field, 485, "finite_field"),
    "quadratic_residues": _of("Quadratic Residue Analysis", dist.quadratic_residues, 100, "quadratic_residues"),
    "dfa": _of("Detrended Fluctuation Analysis (DFA)", win.dfa_hurst, 100, "dfa_hurst"),
    "lyapunov": _of("Lyapunov Exponent (Rosenstein)", geo.lyapunov_exponent, 100, "lyapunov_exponent"),
    "takens": _of("Takens Embedding", num.takens, 550),
    "correlation_dimension": _of("Correlation Dimension (Grassberger-Procaccia)", geo.correlation_dimension, 1004, "correlation_dimension"),
    "shannon_entropy": _of("Shannon Entropy", dist.shannon_entropy, 10),
    "mutual_information": _of("Mutual Information", dist.mutual_information, 30),
    "kolmogorov_complexity": _of("Kolmogorov Complexity (Compression Approximation)", num.kolmogorov_complexity, 20),
    "zscore": _of("Z-Score (Standard)", order.zscore, 30, "zscore"),
    "zscore_modified": _of("Z-Score (Modified/MAD)", order.zscore, 30, "zscore", modified=True),
    "shapiro_wilk": _of("Shapiro-Wilk Normality Test", order.shapiro_wilk, 20, "shapiro_wilk"),
    "persistence": _of("Persistent Homology", num.persistence, 30, "persistence"),
    "betti": _of("Betti Numbers", num.betti_summary, 30, "betti_summary"),
    "vietoris_rips": _of("Vietoris-Rips Complex", num.vietoris_rips, 20, "vietoris_rips"),
    "fft": _of("Fast Fourier Transform (FFT)", num.fft_features, 8),
    "psd": _of("Power Spectral Density (Welch)", num.psd_bands, 256),
    "coherence": _of("Magnitude-Squared Coherence", num.coherence_summary, 256),
    "visibility_natural": _of("Natural Visibility Graph", net.graph_metrics, 10, "visibility_metrics"),
    "visibility_horizontal": _of("Horizontal Visibility Graph", net.graph_metrics, 10, "visibility_metrics", kind="horizontal"),
    "centrality": _of("Network Centrality Analysis", net.centrality_degree, 5, "centrality_degree"),
    "clustering": _of("Network Clustering Analysis", net.clustering_coefficients, 5, "clustering_coefficients"),
    "density_matrix": _of("Density Matrix", num.density_matrix, 2),
    "von_neumann": _of("Von Neumann Entropy", num.von_neumann_entropy, 10),
    "integrated_information": _of("Integrated Information (Φ)", num.integrated_information, 10),
}


def analyze_batch(series: DataFrame, names: list[str]) -> DataFrame:
    """The results of several analyzers over all series."""
    return reduce(DataFrame.unionByName, (ANALYZERS[n].analyze(series) for n in names))
