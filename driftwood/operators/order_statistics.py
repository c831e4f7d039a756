"""Tests and scores on sorted values. Ranks are windows over a series; ties are ordered by position."""

from __future__ import annotations

from driftwood.plans.dialect import Spark, erf, operator


def _ranked(s: str) -> str:
    return f"""ranked AS (SELECT series_id, pos, value, row_number() OVER (PARTITION BY series_id ORDER BY value, pos) AS i, count(*) OVER (PARTITION BY series_id) AS n,
  min(value) OVER (PARTITION BY series_id) AS low, max(value) OVER (PARTITION BY series_id) AS high, avg(value) OVER (PARTITION BY series_id) AS mu FROM {s})"""


@operator
def ks_test(d: Spark, s: str, alternative: str = "two_sided", alpha: float = 0.05) -> str:
    """Kolmogorov and Smirnov's test against the uniform distribution on the series' own range."""
    plus, minus = "(i / n - f)", "(f - (i - 1) / n)"
    gap = {"two_sided": f"greatest({plus}, {minus})", "greater": plus, "less": minus}[alternative]
    lam = "(dd * sqrt(n))"
    if alternative == "two_sided":
        p = f"CASE WHEN {lam} >= 10 THEN 0e0 ELSE least(1e0, greatest(0e0, 2 * {d.series(1, 100, f'(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * dd * dd * n)')})) END"
        crit = f"CASE WHEN n >= 30 THEN sqrt(-0.5 * ln({alpha / 2}) / n) ELSE 1.36 / sqrt(n) END"
    else:
        p = f"CASE WHEN dd <= 0 THEN 1e0 ELSE least(1e0, exp(-2 * {lam} * {lam})) END"
        crit = f"CASE WHEN n >= 30 THEN sqrt(-0.5 * ln({alpha}) / n) ELSE 1.22 / sqrt(n) END"
    return f"""WITH {_ranked(s)}, f AS (SELECT series_id, n, low, high, i, value, CASE WHEN high > low THEN (value - low) / (high - low) ELSE 0.5e0 END AS f FROM ranked),
stat AS (SELECT series_id, n, low, high, greatest(0e0, max({gap})) AS dd FROM f GROUP BY series_id, n, low, high)
SELECT series_id, CASE WHEN n < 20 THEN 'insufficient_data' WHEN high = low THEN 'validation' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r('dd')} AS d_statistic, {d.r(crit)} AS critical_value, {d.r(p)} AS p_value FROM stat"""


#: Critical values of the statistic at each level.
AD_CRITICAL = {
    "uniform": {0.25: 1.248, 0.10: 1.933, 0.05: 2.492, 0.025: 3.070, 0.01: 3.857, 0.0: 4.500},
    "normal": {0.25: 0.470, 0.10: 0.631, 0.05: 0.752, 0.025: 0.873, 0.01: 1.035, 0.0: 1.159},
    "exponential": {0.25: 0.990, 0.10: 1.062, 0.05: 1.321, 0.025: 1.591, 0.01: 1.959, 0.0: 2.244},
}


def _ad_p(kind: str) -> str:
    """The piecewise approximations of the tail, of the statistic corrected for n as `w`."""
    if kind == "uniform":
        low = "exp(-1.2337141e0 / w) * (2.00012e0 + w * (0.247105e0 - w * (0.0649821e0 - w * 0.0347962e0)))"
        high = "exp(1.0776e0 - (2.30695e0 * w - 0.43424e0 * w * w - 0.082433e0 * w * w * w - 0.008056e0 * w * w * w * w))"
        return f"CASE WHEN w < 0 THEN 1e0 WHEN w > 13 THEN 0e0 WHEN w < 2 THEN greatest(0e0, least(1e0, {low})) ELSE greatest(0e0, least(1e0, {high})) END"
    if kind == "normal":
        return "CASE WHEN w < 0 THEN 1e0 WHEN w > 13 THEN 0e0 WHEN w < 0.2 THEN 1 - exp(-3.8e0 * w) * sqrt(w) WHEN w < 2 THEN exp(-1.2337e0 / w) * (1 + w * 0.2e0) ELSE exp(-2.5e0 * w + 1.2e0) END"
    return "CASE WHEN w < 0 THEN 1e0 WHEN w > 10 THEN 0e0 ELSE least(1e0, exp(-2e0 * w)) END"


@operator
def anderson_darling(d: Spark, s: str, distribution: str = "normal", rate: float = 1.0, alpha: float = 0.05, clamp: float | None = None) -> str:
    """Anderson and Darling's statistic. The normal is taken at the min-max scaled value, as the reference results have it.

    Where a distribution function reaches 1 the statistic is infinite; with `clamp` it is kept inside (clamp, 1 - clamp).
    """
    scaled = "(CASE WHEN high > low THEN (value - low) / (high - low) ELSE 0.5e0 END)"
    cdf = {"uniform": f"greatest(0e0, least(1e0, {scaled}))", "normal": f"0.5 * (1 + {erf(f'({scaled} / sqrt(2e0))')})", "exponential": f"CASE WHEN value < 0 THEN 0e0 ELSE 1 - exp(-{rate} * value) END"}[distribution]
    bound = f"greatest({clamp}, least(1 - {clamp}, f))" if clamp else "f"
    star = {"uniform": "a * (1 + 0.75 / n + 2.25 / (n * n))", "normal": "a * (1 + 4.0 / n - 25.0 / (n * n))", "exponential": "a * (1 + 0.6 / n)"}[distribution]
    critical = next(v for k, v in AD_CRITICAL[distribution].items() if alpha >= k)
    return f"""WITH {_ranked(s)}, f AS (SELECT series_id, n, low, high, i, {cdf} AS f FROM ranked), g AS (SELECT series_id, n, low, high, i, {bound} AS f FROM f),
terms AS (SELECT series_id, n, low, high, CASE WHEN f >= 1 THEN 1 ELSE 0 END AS infinite, (2 * i - 1) * ln(CASE WHEN f > 1e-300 THEN f ELSE 1e-300 END) + (2 * (n + 1 - i) - 1) * ln(CASE WHEN f < 1 THEN 1 - f ELSE 1e0 END) AS t FROM g),
stat AS (SELECT series_id, n, low, high, CASE WHEN max(infinite) = 1 THEN {d.inf()} ELSE -n - sum(t) / n END AS a FROM terms GROUP BY series_id, n, low, high), corrected AS (SELECT *, {star} AS w FROM stat)
SELECT series_id, CASE WHEN n < 8 THEN 'insufficient_data' WHEN high = low THEN 'validation' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r(f'CASE WHEN a < {d.inf()} THEN a END')} AS a_squared, a = {d.inf()} AS is_infinite, {d.r(str(critical))} AS critical_value, {d.r(_ad_p(distribution))} AS p_value FROM corrected"""


def _z(s: str, modified: bool) -> str:
    """z (series_id, pos, value, n, z)."""
    if not modified:
        return f"z AS (SELECT series_id, pos, value, n, CASE WHEN sd < 1e-10 THEN 0e0 ELSE (value - mu) / sd END AS z FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS mu, stddev_pop(value) OVER (PARTITION BY series_id) AS sd, count(*) OVER (PARTITION BY series_id) AS n FROM {s}) q)"
    return f"""mid AS (SELECT series_id, median(value) AS med, count(*) AS n FROM {s} GROUP BY series_id), off AS (SELECT x.series_id, pos, value, n, value - med AS dev FROM {s} x JOIN mid m ON m.series_id = x.series_id),
mads AS (SELECT series_id AS sid, median(abs(dev)) AS mad FROM off GROUP BY series_id), z AS (SELECT series_id, pos, value, n, CASE WHEN mad < 1e-10 THEN 0e0 ELSE 0.6745e0 * dev / mad END AS z FROM off JOIN mads ON sid = series_id)"""


@operator
def zscore_values(d: Spark, s: str, modified: bool = False) -> str:
    """A row for each value."""
    return f"WITH {_z(s, modified)} SELECT series_id, pos, {d.r('z')} AS z, CASE WHEN abs(z) > 3.5 THEN 'extreme' WHEN abs(z) > 3 THEN 'mild' ELSE 'none' END AS outlier FROM z"


@operator
def zscore(d: Spark, s: str, modified: bool = False) -> str:
    """Counts of mild (over 3) and extreme (over 3.5) outliers, and the moments of the scores."""
    return f"""WITH {_z(s, modified)}, m AS (SELECT *, avg(z) OVER (PARTITION BY series_id) AS mz FROM z),
stat AS (SELECT series_id, n, mz, sqrt(avg((z - mz) * (z - mz))) AS sd, max(abs(z)) AS most, avg((z - mz) * (z - mz) * (z - mz) * (z - mz)) AS m4, avg((z - mz) * (z - mz)) AS m2, sum(CASE WHEN abs(z) > 3.5 THEN 1 ELSE 0 END) AS extreme, sum(CASE WHEN abs(z) > 3 AND abs(z) <= 3.5 THEN 1 ELSE 0 END) AS mild FROM m GROUP BY series_id, n, mz)
SELECT series_id, CASE WHEN n < 30 THEN 'insufficient_data' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r('mz')} AS z_mean, {d.r('sd')} AS z_std, {d.r('most')} AS max_abs_z, {d.r('CASE WHEN m2 > 1e-20 THEN m4 / (m2 * m2) - 3 ELSE 0 END')} AS excess_kurtosis, cast(mild AS bigint) AS mild_outliers, cast(extreme AS bigint) AS extreme_outliers, {d.r('100 * (mild + extreme) / n')} AS outlier_percent FROM stat"""


@operator
def zscore_outliers(d: Spark, s: str, modified: bool = False, first: int = 10) -> str:
    """The positions of the first outliers of each kind."""
    return f"""WITH {_z(s, modified)}, o AS (SELECT series_id, pos, z, CASE WHEN abs(z) > 3.5 THEN 'extreme' ELSE 'mild' END AS kind FROM z WHERE abs(z) > 3), r AS (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY pos) AS place FROM o)
SELECT series_id, kind, pos, {d.r('z')} AS z FROM r WHERE place <= {first}"""


#: Beasley, Springer and Moro's coefficients.
MORO_A = (2.50662823884, -18.61500062529, 41.39119773534, -25.44106049637)
MORO_B = (-8.47351093090, 23.08336743743, -21.06224101826, 3.13082909833)
MORO_C = (0.3374754822726147, 0.9761690190917186, 0.1607979714918209, 0.0276438810333863, 0.0038405729373609, 0.0003951896511919, 0.0000321767881768, 0.0000002888167364, 0.0000003960315187)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[-1]:.16e}"
    for c in reversed(coefficients[:-1]):
        out = f"(({out}) * {x} + {c:.16e})"
    return out


def normal_quantile(u: str) -> str:
    """The approximate quantile with the tail in sqrt(-ln r), as the reference results have it."""
    y, r = f"({u} - 0.5e0)", f"(({u} - 0.5e0) * ({u} - 0.5e0))"
    t = f"sqrt(-ln(CASE WHEN {y} > 0 THEN 1 - {u} ELSE {u} END))"
    return f"CASE WHEN abs({y}) < 0.42 THEN {y} * {_horner(MORO_A, r)} / ({_horner(MORO_B, r)} * {r} + 1) WHEN {y} > 0 THEN {_horner(MORO_C, t)} ELSE -({_horner(MORO_C, t)}) END"


def _phi(x: str) -> str:
    """Abramowitz and Stegun 26.2.17."""
    t = f"(1 / (1 + 0.2316419e0 * abs({x})))"
    tail = f"(0.3989423e0 * exp(-({x}) * ({x}) / 2) * {t} * (0.3193815e0 + {t} * (-0.3565638e0 + {t} * (1.781478e0 + {t} * (-1.821256e0 + {t} * 1.330274e0)))))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


@operator
def shapiro_wilk(d: Spark, s: str, alpha: float = 0.05) -> str:
    """W from order statistics (20 to 5000 values), its p as the reference results have it, skewness and excess kurtosis."""
    u = "greatest(0.000001e0, least(0.999999e0, i / (n + 1e0)))"
    mean = "CASE WHEN n <= 11 THEN -0.0006714e0 * n * n + 0.025054e0 * n - 0.39978e0 ELSE 0.0038915e0 * ln(n) * ln(n) - 0.083751e0 * ln(n) - 0.31082e0 END"
    sigma = "exp(CASE WHEN n <= 11 THEN -0.0020322e0 * n + 0.062767e0 * sqrt(n) - 0.77857e0 ELSE 0.0030302e0 * ln(n) - 0.082676e0 * sqrt(ln(n)) - 0.4803e0 END)"
    return f"""WITH {_ranked(s)}, m AS (SELECT series_id, n, i, value, mu, {normal_quantile(u)} AS m FROM ranked),
halves AS (SELECT a.series_id, a.n, b.m - a.m AS w, b.value - a.value AS gap FROM m a JOIN m b ON b.series_id = a.series_id AND b.i = a.n + 1 - a.i WHERE a.i <= {d.idiv('a.n', '2')}),
weighed AS (SELECT series_id, sum(w * gap) / sqrt(sum(w * w)) AS top FROM halves GROUP BY series_id),
moments AS (SELECT series_id AS sid, n, sum((value - mu) * (value - mu)) AS ss, avg((value - mu) * (value - mu)) AS m2, avg((value - mu) * (value - mu) * (value - mu)) AS m3, avg((value - mu) * (value - mu) * (value - mu) * (value - mu)) AS m4 FROM m GROUP BY series_id, n),
stat AS (SELECT sid AS series_id, n, m2, m3, m4, CASE WHEN ss < 1e-10 THEN 1e0 ELSE greatest(0e0, least(1e0, top * top / ss)) END AS w FROM moments JOIN weighed g ON g.series_id = sid),
z AS (SELECT *, (ln(greatest(1 - w, 1e-10)) - ({mean})) / ({sigma}) AS z FROM stat), p AS (SELECT *, greatest(0.0001e0, least(0.9999e0, {_phi('z')})) AS p FROM z)
SELECT series_id, CASE WHEN n < 20 THEN 'insufficient_data' WHEN n > 5000 THEN 'validation' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r('w')} AS w_statistic, {d.r('p')} AS p_value, p > {alpha} AS is_normal, {d.r('CASE WHEN m2 > 0 THEN m3 / (m2 * sqrt(m2)) ELSE 0 END')} AS skewness, {d.r('CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END')} AS kurtosis FROM p"""


@operator
def shapiro_order_stats(d: Spark, s: str) -> str:
    """Smallest, quartiles and largest by place, not interpolated."""
    at = lambda k: f"max(CASE WHEN i = {k} + 1 THEN value END)"
    return f"""WITH {_ranked(s)} SELECT series_id, {d.r('min(value)')} AS min, {d.r(at(d.idiv('n', '4')))} AS q1, {d.r(at(d.idiv('n', '2')))} AS median, {d.r(at(d.idiv('3 * n', '4')))} AS q3, {d.r('max(value)')} AS max FROM ranked GROUP BY series_id"""


@operator
def box_cox(d: Spark, s: str) -> str:
    """The power, of -1 to 2 by halves, whose transform has the least |skewness| + |excess kurtosis|; ties to the smaller."""
    return f"""WITH low AS (SELECT series_id AS sid, min(value) AS low FROM {s} GROUP BY series_id), grid AS (SELECT sid, low, {d.seq('-2', '4')} AS half FROM low),
t AS (SELECT sid AS series_id, half / 2 AS pow_, CASE WHEN half = 0 THEN ln(v) ELSE (power(v, half / 2) - 1) / (half / 2) END AS y FROM (SELECT sid, half, CASE WHEN low <= 0 THEN value - low + 1 ELSE value END AS v FROM {s} x JOIN grid g ON g.sid = x.series_id) q),
c AS (SELECT series_id, pow_, y - avg(y) OVER (PARTITION BY series_id, pow_) AS y FROM t),
m AS (SELECT series_id, pow_, count(*) AS n, avg(y * y) AS m2, avg(y * y * y) AS m3, avg(y * y * y * y) AS m4 FROM c GROUP BY series_id, pow_),
score AS (SELECT series_id, pow_, CASE WHEN n < 3 OR sqrt(m2) < 1e-10 THEN 0e0 ELSE -abs(m3 / (m2 * sqrt(m2))) - abs(m4 / (m2 * m2) - 3) END AS score FROM m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, pow_) AS place FROM score)
SELECT series_id, {d.r('pow_')} AS box_cox_lambda, {d.r('score')} AS score FROM ranked WHERE place = 1"""
