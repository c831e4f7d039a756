"""Operators on the order of a series: autocorrelation, mixing, block means, running means, detrended fluctuation.

All windows are partitioned by series; a series is the unit of parallelism.
"""

from __future__ import annotations

from driftwood.plans.dialect import Spark, operator


def _acf(d: Spark, s: str, max_lag: int | str) -> str:
    """acf (series_id, n, lag, r): products at a lag over all n, by an equi-join on the shifted position."""
    return f"""mid AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS x FROM {s}),
size AS (SELECT series_id, count(*) AS n, sum(x * x) AS ss FROM mid GROUP BY series_id),
lagged AS (SELECT series_id, pos, x, {d.seq('1', str(max_lag))} AS lag FROM mid),
products AS (SELECT a.series_id, lag, sum(a.x * b.x) AS c FROM lagged a JOIN mid b ON b.series_id = a.series_id AND b.pos = a.pos + a.lag GROUP BY a.series_id, lag),
lags AS (SELECT series_id, n, ss, {d.seq('1', str(max_lag))} AS lag FROM size),
acf AS (SELECT l.series_id, n, l.lag, CASE WHEN ss > 0 THEN coalesce(c, 0) / ss ELSE 0 END AS r FROM lags l LEFT JOIN products c ON c.series_id = l.series_id AND c.lag = l.lag WHERE l.lag < n)"""


@operator
def acf(d: Spark, s: str, max_lag: int = 20) -> str:
    """A row for each lag."""
    return f"WITH {_acf(d, s, max_lag)} SELECT series_id, cast(lag AS int) AS lag, {d.r('r')} AS acf FROM acf"


@operator
def ljung_box(d: Spark, s: str, lags: int = 10) -> str:
    return f"""WITH {_acf(d, s, lags)}, q AS (SELECT series_id, n, count(*) AS h, n * (n + 2) * sum(r * r / (n - lag)) AS q FROM acf GROUP BY series_id, n)
SELECT series_id, cast(h AS int) AS lags, {d.r('q')} AS q, {d.r(d.chi2_sf('q', 'h'))} AS p_value FROM q"""


def _mixing(d: Spark, s: str, lag: str, bins: int) -> str:
    """mix (series_id, lag, alpha): the largest |p_ij - p_i p_j| over all cells of the two bins, for each lag in `lag`."""
    return f"""extent AS (SELECT series_id, min(value) AS low, (max(value) - min(value)) / {bins} AS w FROM {s} GROUP BY series_id),
binned AS (SELECT x.series_id, pos, CASE WHEN w = 0 THEN 0 ELSE cast(least({bins - 1}, floor((value - low) / w)) AS int) END AS bin FROM {s} x JOIN extent e ON e.series_id = x.series_id),
shifted AS (SELECT a.series_id, l.lag, a.bin AS i, b.bin AS j FROM binned a JOIN ({lag}) l ON l.series_id = a.series_id JOIN binned b ON b.series_id = a.series_id AND b.pos = a.pos + l.lag),
pairs AS (SELECT series_id, lag, i, j, count(*) AS o FROM shifted GROUP BY series_id, lag, i, j),
left_side AS (SELECT series_id, lag, i, sum(o) AS oi FROM pairs GROUP BY series_id, lag, i),
right_side AS (SELECT series_id, lag, j, sum(o) AS oj FROM pairs GROUP BY series_id, lag, j),
total AS (SELECT series_id, lag, sum(o) AS n FROM pairs GROUP BY series_id, lag),
mix AS (SELECT a.series_id, a.lag, max(abs(coalesce(o, 0) / n - oi / n * (oj / n))) AS alpha FROM left_side a JOIN right_side b ON b.series_id = a.series_id AND b.lag = a.lag
  JOIN total t ON t.series_id = a.series_id AND t.lag = a.lag LEFT JOIN pairs p ON p.series_id = a.series_id AND p.lag = a.lag AND p.i = a.i AND p.j = b.j GROUP BY a.series_id, a.lag)"""


@operator
def mixing_coefficient(d: Spark, s: str, max_lag: int = 10, bins: int = 5) -> str:
    """A row for each lag."""
    lags = f"SELECT series_id, {d.seq('1', str(max_lag))} AS lag FROM (SELECT DISTINCT series_id FROM {s}) u"
    return f"WITH {_mixing(d, s, lags, bins)} SELECT series_id, cast(lag AS int) AS lag, {d.r('alpha')} AS alpha FROM mix"


@operator
def mixing_summary(d: Spark, s: str, max_lag: int = 20, lb_lags: int = 10, bins: int = 5) -> str:
    """Ljung-Box, decorrelation, effective sample size and mixing at lag 1 and at half the largest lag (which is at most n / 4)."""
    lags = f"SELECT series_id, 1 AS lag FROM {s} GROUP BY series_id UNION SELECT series_id, {d.idiv(f'least({max_lag}, {d.idiv("count(*)", "4")})', '2')} AS lag FROM {s} GROUP BY series_id"
    fit = "regr_slope(ln(abs(CASE WHEN abs(r) > 1e-10 THEN r END)), lag)"
    return f"""WITH {_acf(d, s, max_lag)}, kept AS (SELECT *, least({max_lag}, {d.idiv('n', '4')}) AS top FROM acf WHERE lag <= least({max_lag}, {d.idiv('n', '4')})),
sums AS (SELECT series_id, n, top, n * (n + 2) * sum(CASE WHEN lag <= {lb_lags} THEN r * r / (n - lag) ELSE 0 END) AS q, cast(sum(CASE WHEN lag <= {lb_lags} THEN 1 ELSE 0 END) AS int) AS h, max(abs(r)) AS most, min(CASE WHEN abs(r) < 2 / sqrt(n) THEN lag END) AS decorrelation,
  sum(r) AS total, {fit} AS slope, sum(CASE WHEN abs(r) > 1e-10 THEN 1 ELSE 0 END) AS points FROM kept GROUP BY series_id, n, top), {_mixing(d, s, lags, bins)}
SELECT x.series_id, CASE WHEN n < {max(4 * max_lag, 100)} THEN 'insufficient_data' ELSE 'ok' END AS status, cast(n AS bigint) AS n, cast(top AS int) AS max_lag, {d.r('q')} AS ljung_box_q, {d.r(d.chi2_sf('q', 'h'))} AS ljung_box_p, {d.r('most')} AS max_abs_acf, cast(decorrelation AS int) AS decorrelation_lag,
  {d.r('CASE WHEN points >= 3 AND slope < 0 THEN -1 / slope END')} AS decay_time, {d.r('CASE WHEN 1 + 2 * total <= 0 THEN n ELSE n / (1 + 2 * total) END')} AS effective_sample_size, {d.r('0.5 + total')} AS integrated_time, {d.r('a.alpha')} AS mixing_alpha_1, {d.r('b.alpha')} AS mixing_alpha_mid
FROM sums x LEFT JOIN mix a ON a.series_id = x.series_id AND a.lag = 1 LEFT JOIN mix b ON b.series_id = x.series_id AND b.lag = {d.idiv('top', '2')}"""


def _block_ratio(d: Spark, s: str, blocks: str) -> str:
    """ratios (series_id, b, ratio): variance of the means of full blocks over that of single values by b. blocks: (series_id, b)."""
    return f"""sizes AS ({blocks}), whole AS (SELECT series_id AS sid, count(*) AS n, var_samp(value) AS v FROM {s} GROUP BY series_id),
means AS (SELECT x.series_id, b, {d.idiv('pos', 'b')} AS block, n, v, avg(value) AS m FROM {s} x JOIN sizes z ON z.series_id = x.series_id JOIN whole w ON w.sid = x.series_id WHERE {d.idiv('pos', 'b')} < {d.idiv('n', 'b')} GROUP BY x.series_id, b, {d.idiv('pos', 'b')}, n, v),
ratios AS (SELECT series_id, n, b, count(*) AS blocks, CASE WHEN v > 0 THEN var_samp(m) / (v / b) END AS ratio FROM means GROUP BY series_id, n, b, v)"""


@operator
def birkhoff_ratio(d: Spark, s: str, blocks: int = 10) -> str:
    sizes = f"SELECT series_id, {d.idiv('count(*)', str(blocks))} AS b FROM {s} GROUP BY series_id HAVING count(*) >= {blocks}"
    return f"WITH {_block_ratio(d, s, sizes)} SELECT series_id, CASE WHEN n < {10 * max(blocks, 5)} THEN 'insufficient_data' ELSE 'ok' END AS status, cast(b AS bigint) AS block_size, cast({d.idiv('n', 'b')} AS bigint) AS num_blocks, {d.r('ratio')} AS ergodicity_ratio FROM ratios"


def _scales(d: Spark, s: str, most: int = 12) -> str:
    """Block sizes from max(n / 20, 10) up to n / 4, each one and a half times the one before, rounded down."""
    ctes = [f"z0 AS (SELECT series_id, greatest({d.idiv('count(*)', '20')}, 10) AS b, {d.idiv('count(*)', '4')} AS top FROM {s} GROUP BY series_id)"]
    ctes += [f"z{k} AS (SELECT series_id, {d.idiv(f'3 * b', '2')} AS b, top FROM z{k - 1})" for k in range(1, most)]
    return ", ".join(ctes), " UNION ALL ".join(f"SELECT series_id, b FROM z{k} WHERE b <= top" for k in range(most))


@operator
def birkhoff_multiscale(d: Spark, s: str) -> str:
    tables, sizes = _scales(d, s)
    return f"WITH {tables}, {_block_ratio(d, s, sizes)} SELECT series_id, cast(count(ratio) AS bigint) AS num_scales_tested, {d.r('avg(ratio)')} AS avg_ratio, {d.r('var_pop(ratio)')} AS ratio_variance FROM ratios GROUP BY series_id"


@operator
def birkhoff_convergence(d: Spark, s: str, points: int = 50) -> str:
    """How running means close in on the mean: deviations, and the exponent over the later half."""
    return f"""WITH run AS (SELECT series_id, pos, avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS m, count(*) OVER (PARTITION BY series_id) AS n, avg(value) OVER (PARTITION BY series_id) AS mu FROM {s}),
steps AS (SELECT *, greatest(1, {d.idiv('n', str(points))}) AS step FROM run),
kept AS (SELECT series_id, pos + 1 AS size, n, abs(m - mu) AS dev, {d.idiv('pos + 1', 'step')} AS i, least({points}, n) AS k FROM steps WHERE (pos + 1) % step = 0 AND {d.idiv('pos + 1', 'step')} <= least({points}, n)),
fit AS (SELECT series_id, max(dev) AS most, max(CASE WHEN i = k THEN dev END) AS final, avg(CASE WHEN i > k - {d.idiv('k', '4')} THEN dev END) AS late, sum(CASE WHEN i > {d.idiv('k', '2')} AND dev > 1e-10 THEN 1 ELSE 0 END) AS used,
  regr_slope(CASE WHEN i > {d.idiv('k', '2')} AND dev > 1e-10 THEN ln(dev) END, CASE WHEN i > {d.idiv('k', '2')} AND dev > 1e-10 THEN ln(size) END) AS slope FROM kept GROUP BY series_id)
SELECT series_id, {d.r('final')} AS final_deviation, {d.r('most')} AS max_deviation, {d.r('late')} AS late_deviation, {d.r('CASE WHEN used < 2 THEN 0.5 ELSE -slope END', 4)} AS convergence_exponent FROM fit"""


def box_sizes(n: int, low: int = 4, count: int = 20, high: int | None = None) -> list[int]:
    """Log-spaced whole box sizes from low to the smaller of high (a quarter of n) and half of n."""
    import math

    top = min(high or n // 4, n // 2)
    if top <= low:
        return [low]
    step = (math.log(top) - math.log(low)) / (count - 1)
    return sorted({size for i in range(count) if low <= (size := int(math.exp(math.log(low) + i * step) + 0.5)) <= top})


def _fluctuation(d: Spark, s: str, count: int) -> str:
    """fluct (series_id, n, box, rank, f): box sizes come from each series' own length; the tail box is a second row of its values."""
    size = f"cast(round(exp(ln(4e0) + i * (ln(cast({d.idiv('n', '4')} AS double)) - ln(4e0)) / {count - 1})) AS int)"
    rss = "(CASE WHEN regr_sxx(y, pos) > 0 THEN regr_syy(y, pos) - regr_sxy(y, pos) * regr_sxy(y, pos) / regr_sxx(y, pos) ELSE 0 END)"
    return f"""profile AS (SELECT series_id, pos, sum(value - mu) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT series_id, pos, value, avg(value) OVER (PARTITION BY series_id) AS mu FROM {s}) c),
len AS (SELECT series_id, count(*) AS n FROM {s} GROUP BY series_id HAVING count(*) >= 20),
grid AS (SELECT series_id, n, {d.seq('0', str(count - 1))} AS i FROM len),
boxes AS (SELECT DISTINCT series_id, n, {size} AS box FROM grid WHERE {size} <= {d.idiv('n', '4')}),
members AS (SELECT p.series_id, n, box, {d.idiv('pos', 'box')} AS part, pos, y FROM profile p JOIN boxes b ON b.series_id = p.series_id WHERE {d.idiv('pos', 'box')} < {d.idiv('n', 'box')}
  UNION ALL SELECT p.series_id, n, box, -1 AS part, pos, y FROM profile p JOIN boxes b ON b.series_id = p.series_id WHERE pos >= n - box AND n % box >= {d.idiv('box', '2')}),
residuals AS (SELECT series_id, n, box, part, greatest(0e0, {rss}) AS ssr FROM members GROUP BY series_id, n, box, part),
fluct AS (SELECT series_id, n, box, row_number() OVER (PARTITION BY series_id ORDER BY box) - 1 AS rank, sqrt(avg(ssr)) AS f, sqrt(avg(ssr) / box) AS f_std FROM residuals GROUP BY series_id, n, box)"""


@operator
def dfa_fluctuation(d: Spark, s: str, count: int = 20) -> str:
    """A row for each box size: fluctuation after linear detrending (from summed squares; _std from mean squares)."""
    return f"WITH {_fluctuation(d, s, count)} SELECT series_id, cast(box AS int) AS box, {d.r('f', 4)} AS fluctuation, {d.r('f_std', 4)} AS fluctuation_std FROM fluct"


@operator
def dfa_hurst(d: Spark, s: str, count: int = 20) -> str:
    """hurst_exponent is the slope against the rank of the box size, as the reference results have it; hurst_std the log-log slope."""
    return f"""WITH {_fluctuation(d, s, count)}, fit AS (SELECT series_id, n, count(*) AS k, regr_slope(ln(f), rank) AS h, regr_r2(ln(f), rank) AS r2, regr_slope(ln(f_std), ln(box)) AS hs, regr_r2(ln(f_std), ln(box)) AS r2s FROM fluct WHERE f > 0 GROUP BY series_id, n)
SELECT series_id, CASE WHEN n < 100 THEN 'insufficient_data' ELSE 'ok' END AS status, cast(k AS int) AS boxes, {d.r('h')} AS hurst_exponent, {d.r('2 - h')} AS fractal_dimension, {d.r('r2')} AS r_squared, {d.r('hs')} AS hurst_std, {d.r('r2s')} AS r_squared_std FROM fit"""


def _delays(m: int, tau: int, of: str = "value") -> str:
    return ", ".join(f"lead({of}, {j * tau}) OVER (PARTITION BY series_id ORDER BY pos) AS x{j}" for j in range(m))


@operator
def delay_embedding(d: Spark, s: str, m: int = 3, tau: int = 1) -> str:
    """A row for each delay vector."""
    return f"SELECT series_id, pos, {', '.join(d.r(f'x{j}') + f' AS x{j}' for j in range(m))} FROM (SELECT series_id, pos, {_delays(m, tau)} FROM {s}) v WHERE x{m - 1} IS NOT NULL"


def _ami(d: Spark, s: str, max_delay: int, bins: int) -> str:
    cell = f"CASE WHEN high > low THEN cast(floor((value - low) / (high - low) * ({bins} - 0.001e0)) AS int) ELSE 0 END"
    return f"""extent AS (SELECT series_id, count(*) AS n, min(value) AS low, max(value) AS high FROM {s} GROUP BY series_id),
binned AS (SELECT x.series_id, pos, n, {cell} AS bin FROM {s} x JOIN extent e ON e.series_id = x.series_id),
delays AS (SELECT series_id, pos, n, bin, {d.seq('1', f'least({max_delay}, {d.idiv("n", "4")})')} AS delay FROM binned),
cells AS (SELECT a.series_id, delay, a.bin AS i, b.bin AS j FROM delays a JOIN binned b ON b.series_id = a.series_id AND b.pos = a.pos + delay),
counts AS (SELECT series_id, delay, i, j, count(*) AS o FROM cells GROUP BY series_id, delay, i, j),
rated AS (SELECT series_id, delay, o, sum(o) OVER (PARTITION BY series_id, delay) AS n, sum(o) OVER (PARTITION BY series_id, delay, i) AS oi, sum(o) OVER (PARTITION BY series_id, delay, j) AS oj FROM counts),
ami AS (SELECT series_id, delay, sum(o / n * log2((o / n) / ((oi / n) * (oj / n)))) AS mi FROM rated GROUP BY series_id, delay)"""


@operator
def ami_curve(d: Spark, s: str, max_delay: int = 50, bins: int = 16) -> str:
    """A row for each delay: average mutual information in bits."""
    return f"WITH {_ami(d, s, max_delay, bins)} SELECT series_id, cast(delay AS int) AS delay, {d.r('mi')} AS mutual_information FROM ami"


@operator
def ami_first_minimum(d: Spark, s: str, max_delay: int = 50, bins: int = 16) -> str:
    """The first strict local minimum of the curve, else its smallest value."""
    return f"""WITH {_ami(d, s, max_delay, bins)}, near AS (SELECT series_id, delay, round(mi, 9) AS mi, lag(round(mi, 9)) OVER (PARTITION BY series_id ORDER BY delay) AS before, lead(round(mi, 9)) OVER (PARTITION BY series_id ORDER BY delay) AS after FROM ami),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mi, delay) AS place FROM near)
SELECT series_id, cast(coalesce(min(CASE WHEN mi < before AND mi < after THEN delay END), max(CASE WHEN place = 1 THEN delay END)) AS int) AS delay FROM ranked GROUP BY series_id"""
