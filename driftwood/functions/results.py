"""The common result shape, and readings of metrics in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def to_result(metrics: DataFrame, framework: str, reading: Column | None = None) -> DataFrame:
    """One row a series: framework, status, metrics (map of all numbers), p_value, interpretation, metadata (map of texts)."""
    kinds = dict(metrics.dtypes)
    numbers = [c for c in metrics.columns if kinds[c] in NUMBERS]
    texts = [c for c in metrics.columns if kinds[c] == "string" and c not in ("series_id", "status")]
    pairs = lambda names, kind: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast(kind) for c in names))), lambda _, v: v.isNotNull()) if names else F.create_map().cast(f"map<string,{kind}>")
    p = F.col("p_value").cast("double") if "p_value" in kinds else F.lit(None).cast("double")
    status = F.col("status") if "status" in kinds else F.lit("ok")
    return metrics.select("series_id", F.lit(framework).alias("framework"), status.alias("status"), pairs(numbers, "double").alias("metrics"), p.alias("p_value"), (reading if reading is not None else F.lit(None).cast("string")).alias("interpretation"), pairs(texts, "string").alias("metadata"))


def bands(x: Column | str, *steps: tuple[float, str], other: str) -> Column:
    """The text of the first step that x is above; `other` if it is above none."""
    x = F.col(x) if isinstance(x, str) else x
    chain = F.when(x.isNull(), F.lit(None).cast("string"))
    for low, text in steps:
        chain = chain.when(x > low, text)
    return chain.otherwise(other)


def said(*parts: Column | str) -> Column:
    return F.concat_ws("; ", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def decision(what: str, against: str, p: str = "p_value", alpha: float = 0.05) -> Column:
    return F.when(F.col(p) > alpha, F.concat(F.lit(f"{what}, p = "), F.format_number(p, 4))).otherwise(F.concat(F.lit(f"{against}, p = "), F.format_number(p, 4)))


ERGODICITY = lambda: said(F.when(F.abs(F.col("ergodicity_ratio") - 1) < 0.2, "time and ensemble averages agree").when(F.col("ergodicity_ratio") > 1.5, "block means vary too much").when(F.col("ergodicity_ratio") < 0.5, "block means vary too little").otherwise("weakly ergodic"))
#: Readings of each analyzer's metrics, as column expressions.
READINGS = {
    "chi_squared_test": lambda: decision("uniform", "not uniform"),
    "ks_test": lambda: decision("uniform on its range", "not uniform on its range"),
    "anderson_darling_normal": lambda: decision("fits", "does not fit"),
    "birkhoff_ratio": ERGODICITY,
    "mixing_summary": lambda: said(decision("no autocorrelation", "autocorrelated", "ljung_box_p"), bands("max_abs_acf", (0.6, "strong dependence"), (0.3, "moderate dependence"), other="weak dependence"), bands("decay_time", (20.0, "slow mixing"), (5.0, "moderate mixing"), other="fast mixing")),
    "parity_test": lambda: said(decision("even and odd balanced", "even and odd unbalanced"), bands("balance_ratio", (0.95, "excellent balance"), (0.85, "good balance"), (0.70, "fair balance"), other="poor balance")),
    "partition_balance": lambda: said(decision("partitions balanced", "partitions unbalanced"), bands("normalized_entropy", (0.95, "very even"), (0.85, "even"), (0.70, "somewhat even"), other="uneven"), bands("balance_coefficient", (0.9, "narrow spread"), (0.75, "moderate spread"), (0.5, "wide spread"), other="very wide spread")),
    "finite_field": lambda: said(F.when(F.col("is_uniform"), "residues uniform").otherwise("residues not uniform"), F.concat(F.format_number(100 * F.col("primitive_roots") / F.col("n"), 1), F.lit("% primitive roots"))),
    "quadratic_residues": lambda: said(F.when(F.col("is_balanced"), "residues and nonresidues balanced").otherwise("residues and nonresidues unbalanced"), F.concat(F.format_number("residue_percent", 1), F.lit("% residues"))),
    "zscore": lambda: bands("outlier_percent", (10.0, "many outliers"), (5.0, "several outliers"), (1.0, "some outliers"), other="few outliers"),
    "shapiro_wilk": lambda: said(F.when(F.col("is_normal"), "normal").otherwise("not normal"), F.when(F.abs("skewness") > 0.5, "skewed").otherwise("symmetric"), F.when(F.abs("kurtosis") > 0.5, "unusual tails").otherwise("ordinary tails")),
    "lyapunov_exponent": lambda: said(bands("lyapunov_exponent", (0.01, "chaotic"), (-0.01, "near neutral"), other="stable"), bands("r_squared", (0.9, "clear fit"), (0.7, "fair fit"), other="poor fit")),
    "correlation_dimension": lambda: said(bands("correlation_dimension", (3.5, "high dimension"), (2.5, "about three dimensions"), (1.5, "about two dimensions"), (0.5, "about one dimension"), other="a point"), F.when(F.abs(F.col("correlation_dimension") - F.round("correlation_dimension")) > 0.1, "fractal").otherwise("near a whole number")),
    "fnn_fraction": lambda: bands("fnn", (0.15, "dimension too small"), (0.05, "marginal dimension"), (0.01, "good dimension"), other="full unfolding"),
    "dfa_hurst": lambda: bands("hurst_std", (0.6, "persistent"), (0.4, "near random"), other="anti-persistent"),
    "draw_multifractal": lambda: bands("hurst_exponent", (0.6, "strongly persistent"), (0.5, "weakly persistent"), (0.4, "weakly anti-persistent"), other="anti-persistent"),
    "visibility_metrics": lambda: said(bands("density", (0.5, "dense"), (0.1, "moderately dense"), other="sparse"), bands("average_degree", (10.0, "highly linked"), (3.0, "linked"), other="loosely linked"), bands("transitivity", (0.3, "clustered"), other="not clustered")),
    "centrality_degree": lambda: said(bands("centralization", (0.7, "centralized"), (0.3, "partly centralized"), other="decentralized"), bands("variance", (0.1, "uneven"), other="even")),
    "clustering_coefficients": lambda: bands("average_clustering", (0.6, "highly clustered"), (0.2, "clustered"), other="barely clustered"),
    "label_propagation": lambda: bands("modularity", (0.3, "strong communities"), (0.1, "weak communities"), other="no communities"),
    "small_world": lambda: bands("sigma", (1.5, "small world"), other="no small world"),
    "vietoris_rips": lambda: F.format_string("%d vertices, %d edges, %d triangles, Euler number %d", "vertices", "edges", "triangles", "euler_characteristic"),
    "betti_summary": lambda: F.format_string("richest at scale %.4f: %d components, %d loops, Euler number %d; on average %.2f components and %.2f loops", "optimal_scale", "b0", "b1", "euler", "avg_b0", "avg_b1"),
    "persistence": lambda: F.format_string("%d components merged, %d loops, %d of them lasting", "h0_features", "h1_features", "significant_features"),
}
