"""Names every query and its SQL twin: an operator, the series view it reads, and its configuration."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from driftwood.operators import distributions as dist
from driftwood.operators import draws
from driftwood.operators import geometry as geo
from driftwood.operators import networks as net
from driftwood.operators import numeric as num
from driftwood.operators import order_statistics as order
from driftwood.operators import windows as win
from driftwood.plans import twins
from driftwood.plans.dialect import DUCK, SPARK, joined
from driftwood.sources import views


class Entry(NamedTuple):
    operator: Callable[..., DataFrame]
    view: Callable
    config: dict = {}
    text: str | None = None  # the twin of an operator that isn't SQL itself
    columns: tuple[str, ...] = ()  # as the twin has them, if arrays are taken apart

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.operator(series(spark, sf_dir, self.view), **self.config)
        return out.selectExpr(*self.columns) if self.columns else out

    def twin(self) -> str | None:
        text = self.operator.sql(DUCK, "src", **self.config) if hasattr(self.operator, "sql") else self.text
        return text and joined(f"src AS ({self.view(DUCK)})", text)


def series(spark: SparkSession, sf_dir: str, view: Callable) -> DataFrame:
    """A series view over the tables in a directory."""
    return spark.sql(view(SPARK), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in views.TABLES[view]})


ENTRIES: dict[str, Entry] = {
    "series_statistics": Entry(dist.series_statistics, views.by_type),
    "chi_squared_test": Entry(dist.chi_squared_test, views.by_type),
    "chi_squared_bins": Entry(dist.chi_squared_bins, views.by_type),
    "partition_balance": Entry(dist.partition_balance, views.whole, {"partitions": 4}),
    "parity_test": Entry(dist.parity_test, views.whole),
    "digit_parity": Entry(dist.digit_parity, views.whole),
    "parity_runs": Entry(dist.parity_runs, views.whole),
    "finite_field": Entry(dist.finite_field, views.whole),
    "finite_field_orders": Entry(dist.finite_field_orders, views.whole),
    "quadratic_residues": Entry(dist.quadratic_residues, views.whole),
    "qr_patterns": Entry(dist.qr_patterns, views.whole),
    "qr_run_lengths": Entry(dist.qr_run_lengths, views.whole),
    "shannon_entropy": Entry(dist.shannon_entropy, views.by_type),
    "shannon_entropy_discrete": Entry(dist.shannon_entropy, views.by_type, {"discrete": True}),
    "mutual_information": Entry(dist.mutual_information, views.pairs),
    "dirichlet_posterior": Entry(dist.dirichlet_posterior, views.categories),
    "dirichlet_log_evidence": Entry(dist.dirichlet_log_evidence, views.categories),
    "acf": Entry(win.acf, views.by_type),
    "ljung_box": Entry(win.ljung_box, views.by_type),
    "mixing_coefficient": Entry(win.mixing_coefficient, views.by_type),
    "mixing_summary": Entry(win.mixing_summary, views.by_type),
    "birkhoff_ratio": Entry(win.birkhoff_ratio, views.by_type),
    "birkhoff_multiscale": Entry(win.birkhoff_multiscale, views.by_type),
    "birkhoff_convergence": Entry(win.birkhoff_convergence, views.daily),
    "dfa_fluctuation": Entry(win.dfa_fluctuation, views.daily),
    "dfa_hurst": Entry(win.dfa_hurst, views.daily),
    "delay_embedding": Entry(win.delay_embedding, views.by_user),
    "ami_curve": Entry(win.ami_curve, views.by_type),
    "ami_first_minimum": Entry(win.ami_first_minimum, views.by_type),
    "ks_test": Entry(order.ks_test, views.by_type),
    "ks_test_greater": Entry(order.ks_test, views.by_type, {"alternative": "greater"}),
    "ks_test_less": Entry(order.ks_test, views.by_type, {"alternative": "less"}),
    "anderson_darling_normal": Entry(order.anderson_darling, views.by_type),
    "anderson_darling_exponential": Entry(order.anderson_darling, views.by_type, {"distribution": "exponential", "rate": 0.02}),
    "anderson_darling_uniform": Entry(order.anderson_darling, views.by_type, {"distribution": "uniform"}),
    "anderson_darling_uniform_std": Entry(order.anderson_darling, views.by_type, {"distribution": "uniform", "clamp": 1e-12}),
    "zscore": Entry(order.zscore, views.by_type),
    "zscore_modified": Entry(order.zscore, views.by_type, {"modified": True}),
    "zscore_values": Entry(order.zscore_values, views.by_user),
    "zscore_outliers": Entry(order.zscore_outliers, views.by_type),
    "shapiro_wilk": Entry(order.shapiro_wilk, views.by_type),
    "shapiro_order_stats": Entry(order.shapiro_order_stats, views.by_type),
    "box_cox": Entry(order.box_cox, views.by_type),
    "lyapunov_neighbors": Entry(geo.lyapunov_neighbors, views.by_user),
    "lyapunov_divergence": Entry(geo.lyapunov_divergence, views.by_user),
    "lyapunov_exponent": Entry(geo.lyapunov_exponent, views.hourly),
    "correlation_curve": Entry(geo.correlation_curve, views.hourly),
    "correlation_dimension": Entry(geo.correlation_dimension, views.hourly),
    "correlation_dimensions": Entry(geo.correlation_dimensions, views.hourly),
    "fnn_fraction": Entry(geo.fnn_fraction, views.by_user),
    "planar_edges_filtration": Entry(geo.filtration_edges, views.by_user),
    "vietoris_rips": Entry(num.vietoris_rips, views.by_user, {}, geo.vietoris_rips.sql(DUCK, "src")),
    "nvg_edges": Entry(net.graph_edges, views.by_user, {"kind": "natural"}),
    "hvg_edges": Entry(net.graph_edges, views.by_user, {"kind": "horizontal"}),
    "visibility_degrees": Entry(net.degree_distribution, views.by_user),
    "visibility_metrics": Entry(net.graph_metrics, views.by_user),
    "hvg_metrics": Entry(net.graph_metrics, views.by_user, {"kind": "horizontal"}),
    "centrality_degree": Entry(net.centrality_degree, views.by_user),
    "top_nodes": Entry(net.top_nodes, views.by_user),
    "triangles": Entry(net.triangles, views.by_user),
    "clustering_distribution": Entry(net.clustering_distribution, views.by_user),
    "clustering_coefficients": Entry(net.clustering_coefficients, views.by_user),
    "modularity": Entry(net.modularity, views.by_user),
    "draw_distribution": Entry(draws.draw_distribution, views.draws),
    "draw_frequency": Entry(draws.draw_frequency, views.draws),
    "draw_bayes": Entry(draws.draw_bayes, views.draws),
    "draw_ergodic": Entry(draws.draw_ergodic, views.draws),
    "draw_autocorrelation": Entry(draws.draw_autocorrelation, views.draws),
    "draw_range": Entry(draws.draw_range, views.draws),
    "draw_galois": Entry(draws.draw_galois, views.draws),
    "draw_multifractal": Entry(draws.draw_multifractal, views.draws),
    "draw_chaos": Entry(draws.draw_chaos, views.draws, {}, draws.draw_chaos_pairs.sql(DUCK, "src")),
    "draw_normalization": Entry(draws.draw_normalization, views.draws),
    "draw_candidates": Entry(draws.draw_candidates, views.draws),
    "draw_critical_path": Entry(draws.critical_path, views.draws),
    "fft_spectrum": Entry(num.fft_spectrum, views.hourly, {}, twins.fft_power()),
    "fft_phase": Entry(num.fft_spectrum, views.by_user, {}, twins.fft_power()),
    "fft_features": Entry(num.fft_features, views.by_user, {}, twins.fft_features()),
    "psd_welch": Entry(num.psd_welch, views.hourly, {}, twins.psd_welch()),
    "periodogram": Entry(num.periodogram, views.by_user, {}, twins.periodogram()),
    "psd_bands": Entry(num.psd_bands, views.hourly, {}, twins.psd_bands()),
    "coherence": Entry(num.coherence, views.pairs_long, {}, twins.coherence()),
    "coherence_summary": Entry(num.coherence_summary, views.pairs_long, {}, twins.coherence_summary()),
    "density_matrix": Entry(num.density_matrix, views.by_user, {}, twins.density_matrix(), ("series_id", "n", "purity", "participation_ratio", "effective_dimension", "eigenvalues[0] AS eigenvalue_1", "eigenvalues[1] AS eigenvalue_2")),
    "density_matrix_entries": Entry(num.density_matrix_entries, views.by_user, {}, twins.density_matrix_entries()),
    "density_checks": Entry(num.density_checks, views.by_user, {}, twins.density_checks()),
    "density_matrix_embedded": Entry(num.density_matrix, views.by_user, {"dim": 3, "stride": 2}),
    "von_neumann_entropy": Entry(num.von_neumann_entropy, views.by_user, {}, twins.von_neumann_entropy()),
    "integrated_information": Entry(num.integrated_information, views.by_user, {}, twins.integrated_information(), ("series_id", "n", "phi", "total_entropy", "integration_ratio", "complexity", "mip[0] AS mip_cut", "is_integrated", "is_reducible")),
    "effective_information": Entry(num.effective_information, views.by_user, {}, twins.effective_information()),
    "entanglement": Entry(num.entanglement, views.by_user, {}, twins.entanglement()),
    "kolmogorov_complexity": Entry(num.kolmogorov_complexity, views.by_user),
    "compression_distance": Entry(num.compression_distance, views.pairs_long),
    "dfa_quadratic": Entry(num.dfa_polynomial, views.daily, {"order": 2}, twins.dfa_polynomial(2)),
    "dfa_cubic": Entry(num.dfa_polynomial, views.daily, {"order": 3}, twins.dfa_polynomial(3)),
    "takens": Entry(num.takens, views.daily),
    "graph_paths": Entry(num.graph_paths, views.by_user, {}, twins.graph_paths(net.graph_edges.sql(DUCK, "src", kind="natural"))),
    "centrality_closeness": Entry(num.centralities, views.by_user, {"measures": ("closeness",)}, twins.closeness(net.graph_edges.sql(DUCK, "src", kind="mean"))),
    "centrality_betweenness": Entry(num.centralities, views.by_user, {"measures": ("betweenness",)}, twins.betweenness(net.graph_edges.sql(DUCK, "src", kind="mean"))),
    "centralities": Entry(num.centralities, views.by_user),
    "label_propagation": Entry(num.label_propagation, views.by_user),
    "community_sizes": Entry(num.community_sizes, views.by_user),
    "small_world": Entry(num.small_world, views.by_user),
    "persistence": Entry(num.persistence, views.by_user),
    "persistence_pairs": Entry(num.persistence_pairs, views.by_user),
    "betti_curve": Entry(num.betti_curve, views.by_user, {}, twins.betti_curve()),
    "betti_summary": Entry(num.betti_summary, views.by_user, {}, twins.betti_summary()),
    "dirichlet_credible": Entry(num.dirichlet_credible, views.categories),
    "metropolis_hastings": Entry(num.metropolis_hastings, views.by_type),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.frame for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, e in ENTRIES.items() if (sql := e.twin())}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-squared test and entropy of each event type's series, side by side."""
    by_type = series(spark, sf_dir, views.by_type)
    return dist.chi_squared_test(by_type).join(dist.shannon_entropy(by_type).select("series_id", "entropy", "normalized_entropy"), "series_id")
