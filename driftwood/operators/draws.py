"""The draw-history report: nine analyses of repeated draws of numbers, over (series_id, pos, number).

The domain is given (low to high); numbers of it that were never drawn count as zeros.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

from driftwood.operators.distributions import _runs, is_prime, mod_power
from driftwood.operators.order_statistics import box_cox
from driftwood.plans.dialect import SPARK, Spark, doubles, operator

LOW, HIGH, SIZE = 1, 50, 5


def _dense(d: Spark, s: str, low: int, high: int) -> str:
    """dense (series_id, number, o, n, k): how often each number of the domain was drawn."""
    return f"""who AS (SELECT series_id, count(*) AS n FROM {s} GROUP BY series_id), dom AS (SELECT series_id, n, {d.seq(str(low), str(high))} AS number FROM who),
seen AS (SELECT series_id, number, count(*) AS o FROM {s} GROUP BY series_id, number),
dense AS (SELECT d.series_id, d.number, coalesce(o, 0) AS o, n, {high - low + 1} AS k FROM dom d LEFT JOIN seen c ON c.series_id = d.series_id AND c.number = d.number)"""


def _per_draw(s: str) -> str:
    return f"per_draw AS (SELECT series_id, pos, avg(number) AS mean, sum(number) AS total FROM {s} GROUP BY series_id, pos)"


@operator
def draw_distribution(d: Spark, s: str, low: int = LOW, high: int = HIGH) -> str:
    """A row for each number of the domain."""
    return f"WITH {_dense(d, s, low, high)} SELECT series_id, cast(number AS int) AS number, cast(o AS bigint) AS drawn, {d.r('n / k')} AS expected FROM dense"


@operator
def draw_frequency(d: Spark, s: str, low: int = LOW, high: int = HIGH) -> str:
    return f"""WITH {_dense(d, s, low, high)}, c AS (SELECT series_id, max(n) AS n, max(k) AS k, sum((o - n / k) * (o - n / k) / (n / k)) AS chi FROM dense GROUP BY series_id)
SELECT series_id, cast(n AS bigint) AS numbers, {d.r('chi')} AS chi_squared, cast(k - 1 AS int) AS dof, {d.r(d.chi2_sf('chi', 'k - 1'))} AS p_value, {d.chi2_sf('chi', 'k - 1')} > 0.05 AS is_uniform FROM c"""


@operator
def draw_bayes(d: Spark, s: str, low: int = LOW, high: int = HIGH, prior: float = 0.5) -> str:
    """A row for each number: posterior, normal interval of its beta marginal, and rank (ties to the smaller number)."""
    return f"""WITH {_dense(d, s, low, high)}, p AS (SELECT series_id, number, ({prior} + o) / ({prior} * k + n) AS p, {prior} * k + n AS total FROM dense),
q AS (SELECT *, sqrt(p * (1 - p) / (total + 1)) AS sd, row_number() OVER (PARTITION BY series_id ORDER BY p DESC, number) AS place FROM p)
SELECT series_id, cast(number AS int) AS number, {d.r('p', 9)} AS posterior, {d.r('greatest(0, p - 1.96 * sd)', 9)} AS low, {d.r('least(1, p + 1.96 * sd)', 9)} AS high, cast(place AS int) AS place, place <= 10 AS is_top FROM q"""


@operator
def draw_ergodic(d: Spark, s: str, low: int = LOW, high: int = HIGH) -> str:
    """Temporal against ensemble mean, and runs of draw means about their median; the ensemble is the domain drawn from."""
    return f"""WITH {_per_draw(s)}, mid AS (SELECT series_id AS sid, median(mean) AS med FROM per_draw GROUP BY series_id), flags AS (SELECT series_id, pos, CASE WHEN mean > med THEN 1 ELSE 0 END AS up FROM per_draw JOIN mid ON sid = series_id),
{_runs(d, 'flags')}, t AS (SELECT series_id AS sid, avg(number) AS temporal FROM {s} GROUP BY series_id)
SELECT series_id, {d.r('temporal')} AS temporal_mean, {d.r(str((low + high) / 2))} AS ensemble_mean, cast(runs AS bigint) AS runs, {d.r('coalesce(z, 0)')} AS runs_z, abs(temporal - {(low + high) / 2}) < 0.05 AND abs(coalesce(z, 0)) < 1.96 AS is_ergodic FROM scored JOIN t ON sid = series_id"""


@operator
def draw_autocorrelation(d: Spark, s: str, max_lag: int = 10) -> str:
    """A row for each lag of the draws' sums; 0 where the lag is too long."""
    return f"""WITH {_per_draw(s)}, c AS (SELECT series_id, pos, total - avg(total) OVER (PARTITION BY series_id) AS x FROM per_draw), z AS (SELECT series_id, sum(x * x) AS ss FROM c GROUP BY series_id), far AS (SELECT series_id, pos, x, {d.seq('1', str(max_lag))} AS lag FROM c),
m AS (SELECT a.series_id, lag, sum(a.x * b.x) AS p FROM far a JOIN c b ON b.series_id = a.series_id AND b.pos = a.pos + lag GROUP BY a.series_id, lag), g AS (SELECT series_id, ss, {d.seq('1', str(max_lag))} AS lag FROM z)
SELECT g.series_id, cast(g.lag AS int) AS lag, {d.r('CASE WHEN ss <> 0 THEN coalesce(p, 0) / ss ELSE 0 END')} AS acf FROM g LEFT JOIN m ON m.series_id = g.series_id AND m.lag = g.lag"""


_RANGE = "CASE WHEN number BETWEEN 1 AND 9 THEN 'low' WHEN number BETWEEN 20 AND 28 THEN 'high' ELSE 'medium' END"


@operator
def draw_range(d: Spark, s: str) -> str:
    """Shares of low, medium and high numbers (all others are medium) and of even ones; chi-squared against 9, 10 and 9 of 28."""
    chi = " + ".join(f"({c} - n * {e} / 28e0) * ({c} - n * {e} / 28e0) / (n * {e} / 28e0)" for c, e in (("lo", 9), ("mid", 10), ("hi", 9)))
    return f"""WITH c AS (SELECT series_id, count(*) AS n, sum(CASE WHEN {_RANGE} = 'low' THEN 1 ELSE 0 END) AS lo, sum(CASE WHEN {_RANGE} = 'medium' THEN 1 ELSE 0 END) AS mid, sum(CASE WHEN {_RANGE} = 'high' THEN 1 ELSE 0 END) AS hi, sum(CASE WHEN number % 2 = 0 THEN 1 ELSE 0 END) AS even FROM {s} GROUP BY series_id), x AS (SELECT *, {chi} AS chi FROM c)
SELECT series_id, {d.r('100 * lo / n')} AS low_percent, {d.r('100 * mid / n')} AS medium_percent, {d.r('100 * hi / n')} AS high_percent, {d.r('100 * even / n')} AS even_percent, {d.r('100 * (n - even) / n')} AS odd_percent, {d.r('chi')} AS chi_squared, {d.r('exp(-least(chi, 1000) / 2)')} AS p_value, exp(-least(chi, 1000) / 2) > 0.05 AS is_balanced FROM x"""


FIELD = 29


@operator
def draw_galois(d: Spark, s: str, high: int = HIGH, size: int = SIZE) -> str:
    """The field's order and generator, its quadratic residues, how many drawn numbers are residues, and log2 of the number of draws possible."""
    residues = sorted({a * a % FIELD for a in range(1, FIELD)})
    euler = mod_power(f"(cast(number AS bigint) % {FIELD})", (FIELD - 1) // 2, FIELD)
    return f"""SELECT series_id, {FIELD} AS field_order, 2 AS generator, '{','.join(map(str, residues))}' AS quadratic_residues, cast(sum(CASE WHEN {euler} = 1 THEN 1 ELSE 0 END) AS bigint) AS residue_draws, {d.r(str(math.log2(math.comb(high, size))))} AS combinatorial_dimension FROM {s} GROUP BY series_id"""


@operator
def draw_multifractal(d: Spark, s: str, low: int = LOW, high: int = HIGH) -> str:
    """Hurst exponent of draw means from boxes of 4, 8 and 16, and the normalized entropy of the numbers."""
    rss = "(CASE WHEN regr_sxx(y, pos) > 0 THEN regr_syy(y, pos) - regr_sxy(y, pos) * regr_sxy(y, pos) / regr_sxx(y, pos) ELSE 0 END)"
    return f"""WITH {_per_draw(s)}, prof AS (SELECT series_id, pos, n, sum(mean - mu) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT *, avg(mean) OVER (PARTITION BY series_id) AS mu, count(*) OVER (PARTITION BY series_id) AS n FROM per_draw) q),
w AS (SELECT series_id, pos, n, y, {d.seq('2', '4')} AS e FROM prof), b AS (SELECT series_id, pos, n, y, cast(power(2, e) AS int) AS w FROM w), ssr AS (SELECT series_id, w, {d.idiv('pos', 'w')} AS part, greatest(0e0, {rss}) / w AS ms FROM b WHERE w < {d.idiv('n', '2')} AND {d.idiv('pos', 'w')} < {d.idiv('n', 'w')} GROUP BY series_id, w, {d.idiv('pos', 'w')}),
f AS (SELECT series_id, w, sqrt(avg(ms)) AS f FROM ssr GROUP BY series_id, w), fit AS (SELECT series_id, CASE WHEN count(*) < 2 THEN 0.5e0 ELSE greatest(0e0, least(1e0, regr_slope(ln(f), ln(w)))) END AS h FROM f WHERE f > 0 GROUP BY series_id),
{_dense(d, s, low, high)}, ent AS (SELECT series_id AS sid, -sum(CASE WHEN o > 0 THEN o / n * log2(o / n) ELSE 0 END) / log2(max(k)) AS e FROM dense GROUP BY series_id)
SELECT series_id, {d.r('h')} AS hurst_exponent, {d.r('2 - h')} AS fractal_dimension, {d.r('e')} AS normalized_entropy, h > 0.5 AS is_persistent FROM fit JOIN ent ON sid = series_id"""


_VECTORS = """v AS (SELECT series_id, pos, count(*) OVER (PARTITION BY series_id) AS n, mean AS x0, lead(mean, 1) OVER (PARTITION BY series_id ORDER BY pos) AS x1, lead(mean, 2) OVER (PARTITION BY series_id ORDER BY pos) AS x2 FROM per_draw), u AS (SELECT * FROM v WHERE pos < n - 2)"""
_EXPONENT = "lam AS (SELECT series_id, coalesce(avg(CASE WHEN j > 0 AND d1 > 1e-10 THEN ln(d1 / d0) END), 0e0) AS lam FROM near GROUP BY series_id)"
_SQUARES = " + ".join(f"(a.x{j} - b.x{j}) * (a.x{j} - b.x{j})" for j in range(3))


def _dimension(d: Spark) -> str:
    """The result from lam and counts (sid, x, c): at a logarithm of distance, the pairs that are nearer."""
    return f"""dim AS (SELECT sid, CASE WHEN count(*) < 2 THEN 1e0 ELSE greatest(0e0, least(3e0, regr_slope(ln(c), x))) END AS dim FROM counts WHERE c > 0 GROUP BY sid)
SELECT series_id, {d.r('lam', 4)} AS lyapunov_exponent, {d.r('dim', 4)} AS correlation_dimension, lam > 0 AS is_chaotic FROM lam JOIN dim ON sid = series_id"""


@operator
def draw_chaos_pairs(d: Spark, s: str) -> str:
    """Divergence of nearest draw means (two or more places apart, neighbour 0 passed over), and the correlation dimension of
    three-draw vectors from half, one and two times the upper median distance: by its definition, over all pairs."""
    return f"""WITH {_per_draw(s)}, {_VECTORS},
far AS (SELECT a.series_id, a.pos AS i, b.pos AS j, abs(a.x0 - b.x0) AS d0, abs(a.x1 - b.x1) AS d1 FROM u a JOIN u b ON a.series_id = b.series_id AND abs(a.pos - b.pos) >= 2), near AS (SELECT series_id, i, min(round(d0, 9)) AS d0, min_by(j, round(d0, 9) + j * 1e-12) AS j, min_by(d1, round(d0, 9) + j * 1e-12) AS d1 FROM far WHERE d0 > 1e-10 GROUP BY series_id, i),
{_EXPONENT},
pr AS (SELECT a.series_id, round(sqrt({_SQUARES}), 9) AS r FROM u a JOIN u b ON a.series_id = b.series_id AND a.pos < b.pos), hist AS (SELECT series_id, r, count(*) AS c FROM pr GROUP BY series_id, r),
cum AS (SELECT series_id, r, sum(c) OVER (PARTITION BY series_id ORDER BY r) AS upto, sum(c) OVER (PARTITION BY series_id) AS n FROM hist), med AS (SELECT series_id AS sid, min(r) AS med FROM cum WHERE upto > {d.idiv('n', '2')} GROUP BY series_id),
three AS (SELECT sid, med, {d.seq('-1', '1')} AS e FROM med), counts AS (SELECT sid, ln(power(2, e) * med) AS x, sum(CASE WHEN r < power(2, e) * med THEN c ELSE 0 END) AS c FROM three JOIN hist h ON h.series_id = sid WHERE med >= 1e-10 GROUP BY sid, e, med),
{_dimension(d)}"""


#: Draws of one size have sums on a grid; with this many and sums at most so far apart, pairs are counted by transforms.
GRID_DRAWS, GRID_SPAN = 4096, 263
#: The sum of squared counts up to which doubles tell the counts of pairs exactly.
GRID_SQUARES = 1e13


def grid_distances(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of points on whole numbers from 0 in three dimensions (cells, each `counts` times): pairs by squared distance.

    The counts' autocorrelation says how many pairs are any offset apart. The first dimension is transformed in place, a
    few rows at a time, so that the grid is held once.
    """
    n = int(cells.max()) + 1
    size = next(k for k in itertools.count(2 * n - 1) if 30**12 % k == 0)  # products of 2, 3 and 5 are fast
    grid = np.empty((n, size, size // 2 + 1), np.complex128)
    order = np.argsort(cells[:, 0], kind="stable")
    cells, counts = cells[order], counts[order]
    ends = np.searchsorted(cells[:, 0], np.arange(n + 1))
    for k in range(n):
        of = slice(ends[k], ends[k + 1])
        plane = np.bincount(cells[of, 1] * n + cells[of, 2], counts[of], n * n).reshape(n, n)
        grid[k] = np.fft.rfft2(plane, (size, size))
    for k in range(0, size, 4):
        rows = np.fft.fft(grid[:, k : k + 4], size, axis=0)
        grid[:, k : k + 4] = np.fft.ifft(rows.real**2 + rows.imag**2, axis=0)[:n]
    step = np.minimum(np.arange(size), size - np.arange(size)) ** 2
    flat = (step[:, None] + step).ravel()
    out = np.zeros(3 * (n - 1) ** 2 + 1, np.int64)
    for k in range(n):
        pairs = np.fft.irfft2(grid[k], (size, size)).ravel()
        whole = np.rint(pairs)
        if np.abs(pairs - whole).max() > 0.25:
            raise ArithmeticError("counts of pairs are too large for this transform")
        found = np.bincount(flat, whole)[: len(out) - k * k].astype(np.int64)
        if k == 0:  # each pair in both directions, and each point with itself
            found[0] -= int(counts.sum())
            found //= 2
        out[k * k : k * k + len(found)] += found
    return out


def draw_chaos(draws: DataFrame) -> DataFrame:
    """As draw_chaos_pairs, without its pairs. The nearest mean that differs is found from the first three places of each mean,
    as at most two of them are too near; distances of vectors on a grid are counted by `grid_distances`, others by pairs."""
    spark = draws.sparkSession
    whole = isinstance(draws.schema["number"].dataType, IntegralType)
    text = f"""WITH totals AS (SELECT series_id, pos, cast(sum(number) AS bigint) AS t0, count(number) AS size FROM {{f0}} GROUP BY series_id, pos),
shape AS (SELECT series_id AS sid, min(t0) AS low, max(size) AS size FROM totals GROUP BY series_id HAVING {str(whole).lower()} AND count(*) = count(t0) AND min(size) = max(size) AND count(*) >= {GRID_DRAWS} AND max(t0) - min(t0) <= {GRID_SPAN}),
t AS (SELECT series_id, pos, count(*) OVER (PARTITION BY series_id) AS n, t0, lead(t0, 1) OVER (PARTITION BY series_id ORDER BY pos) AS t1, lead(t0, 2) OVER (PARTITION BY series_id ORDER BY pos) AS t2 FROM totals)
SELECT series_id, size, cast(t0 - low AS int) AS x, cast(t1 - low AS int) AS y, cast(t2 - low AS int) AS z, count(*) AS c FROM t JOIN shape ON sid = series_id WHERE pos < n - 2 GROUP BY series_id, size, 3, 4, 5"""
    cells = spark.sql(text, f0=draws)
    fits = spark.sql(f"SELECT series_id FROM {{f0}} GROUP BY series_id HAVING sum(cast(c AS double) * c) <= {GRID_SQUARES}", f0=cells)

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = grid_distances(part[["x", "y", "z"]].to_numpy(np.int64), part["c"].to_numpy(np.int64))
        squares = np.flatnonzero(found)
        return pd.DataFrame({"series_id": key[0], "size": key[1], "squares": squares, "c": found[squares]})

    counted = cells.join(fits, "series_id").groupBy("series_id", "size").applyInPandas(count, "series_id string, size long, squares long, c long")
    d = SPARK
    text = f"""WITH {_per_draw('{f0}')}, {_VECTORS},
places AS (SELECT *, row_number() OVER (PARTITION BY series_id, x0 ORDER BY pos) AS place FROM u), heads AS (SELECT series_id, x0, x1, pos AS j FROM places WHERE place <= 3), means AS (SELECT series_id, x0 FROM places WHERE place = 1),
far AS (SELECT a.series_id, a.x0, b.x1, b.j, round(abs(a.x0 - b.x0), 9) AS d0 FROM means a JOIN heads b ON a.series_id = b.series_id AND abs(a.x0 - b.x0) > 1e-10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, x0 ORDER BY d0, j) AS by_distance, row_number() OVER (PARTITION BY series_id, x0 ORDER BY d0 + j * 1e-12, j) AS by_key FROM far),
best AS (SELECT series_id AS sid, x0 AS mean, array_sort(collect_list(struct(d0 + j * 1e-12 AS key, j, d0, x1))) AS best FROM ranked WHERE by_distance <= 3 OR by_key <= 3 GROUP BY series_id, x0),
open_ AS (SELECT series_id, x1, filter(best, b_ -> abs(b_.j - pos) >= 2) AS best FROM u JOIN best ON sid = series_id AND mean = x0),
near AS (SELECT series_id, array_min(transform(best, b_ -> b_.d0)) AS d0, best[0].j AS j, abs(x1 - best[0].x1) AS d1 FROM open_ WHERE size(best) > 0),
{_EXPONENT},
counted AS (SELECT series_id, round(sqrt(cast(squares AS double)) / size, 9) AS r, c FROM {{f1}}), others AS (SELECT u.* FROM u LEFT ANTI JOIN {{f2}} k ON k.series_id = u.series_id),
pr AS (SELECT a.series_id, round(sqrt({_SQUARES}), 9) AS r FROM others a JOIN others b ON a.series_id = b.series_id AND a.pos < b.pos), hist AS (SELECT series_id, r, count(*) AS c FROM pr GROUP BY series_id, r UNION ALL SELECT series_id, r, c FROM counted),
cum AS (SELECT series_id, r, c, sum(c) OVER (PARTITION BY series_id ORDER BY r) AS upto, sum(c) OVER (PARTITION BY series_id) AS n FROM hist), mid AS (SELECT series_id, r, c, min(CASE WHEN upto > n div 2 THEN r END) OVER (PARTITION BY series_id) AS med FROM cum),
three AS (SELECT series_id AS sid, r, c, med, {d.seq('-1', '1')} AS e FROM mid WHERE med >= 1e-10), counts AS (SELECT sid, ln(power(2, e) * med) AS x, sum(CASE WHEN r < power(2, e) * med THEN c ELSE 0 END) AS c FROM three GROUP BY sid, e, med),
{_dimension(d)}"""
    return spark.sql(doubles(text), f0=draws, f1=counted, f2=fits)


@operator
def draw_normalization(d: Spark, s: str, low: int = LOW, high: int = HIGH) -> str:
    """Numbers drawn unusually often or rarely, a simplified normality statistic of the frequencies, and their best power transform."""
    k = high - low + 1
    if k > 50:
        w = "1 - least(1, m3 * m3 / (m2 * m2 * m2) / 6 + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 24)"
    else:
        w = "greatest(0e0, least(1e0, num * num / ss))"
    half = k // 2
    return f"""WITH {_dense(d, s, low, high)}, f AS (SELECT series_id, number, o, avg(o) OVER (PARTITION BY series_id) AS mu, stddev_pop(o) OVER (PARTITION BY series_id) AS sd, row_number() OVER (PARTITION BY series_id ORDER BY o, number) - 1 AS i FROM dense),
odd AS (SELECT series_id AS sid, {"array_join(array_sort(collect_list(CASE WHEN sd >= 1e-10 AND abs((o - mu) / sd) > 2 THEN cast(number AS int) END)), ',')" if d.name == 'spark' else "coalesce(string_agg(CASE WHEN sd >= 1e-10 AND abs((o - mu) / sd) > 2 THEN cast(number AS varchar) END, ',' ORDER BY number), '')"} AS outliers FROM f GROUP BY series_id),
m AS (SELECT series_id, sum((o - mu) * (o - mu)) AS ss, avg(power(o - mu, 2)) AS m2, avg(power(o - mu, 3)) AS m3, avg(power(o - mu, 4)) AS m4,
  sum(CASE WHEN i < {half} THEN -({half} - i) / ({half} * sqrt({k}e0)) * o WHEN i >= {k - half} THEN ({half} - ({k - 1} - i)) / ({half} * sqrt({k}e0)) * o ELSE 0 END) AS num FROM f GROUP BY series_id),
w AS (SELECT series_id, CASE WHEN ss < 1e-10 THEN 1e0 ELSE {w} END AS w FROM m), p AS (SELECT series_id, w, greatest(0e0, least(1e0, w * (1 + 0.1 / ln({k}e0)))) AS p FROM w),
freq AS (SELECT series_id, number AS pos, cast(o AS double) AS value FROM dense), bc AS ({box_cox.sql(d, 'freq')})
SELECT p.series_id, outliers, {d.r('w')} AS w_statistic, {d.r('p')} AS p_value, p > 0.05 AS is_normal, box_cox_lambda FROM p JOIN odd ON sid = p.series_id JOIN bc ON bc.series_id = p.series_id"""


# --- critical path --------------------------------------------------------------------------------------------------

CANDIDATES = {0.80: 1000, 0.90: 5000, 0.95: 10_000, 0.99: 20_000}


def balanced_combination(high: int = HIGH, size: int = SIZE) -> list[int]:
    """The smallest low, medium and high numbers, a third each, the rest high."""
    third = size // 3
    bands = (range(1, min(9, high) + 1), range(10, min(19, high) + 1), range(20, high + 1))
    return sorted(n for band, k in zip(bands, (third, third, size - 2 * third), strict=True) for n in list(band)[:k])


def prime_combination(low: int = LOW, high: int = HIGH, size: int = SIZE) -> list[int]:
    """The smallest primes for three fifths, the smallest other numbers for the rest."""
    primes = [n for n in range(low, high + 1) if is_prime(n)]
    if len(primes) < size:
        return []
    first = primes[: math.ceil(0.6 * size)]
    return sorted(first + [n for n in range(low, high + 1) if not is_prime(n)][: size - len(first)])


def spread_combinations(seeds: np.ndarray, low: int = LOW, high: int = HIGH, size: int = SIZE) -> np.ndarray:
    """For each seed the first distinct numbers of a linear congruential sequence modulo 2 ** 64 (fixed multiplier and increment)."""
    state, out, filled = seeds.astype(np.uint64), np.zeros((len(seeds), size), np.int64), np.zeros(len(seeds), np.int64)
    while (open_ := filled < size).any():
        state = state * np.uint64(1664525) + np.uint64(1013904223)
        number = (state % np.uint64(high - low + 1)).astype(np.int64) + low
        fresh = open_ & ~(out == number[:, None]).any(axis=1)
        out[np.flatnonzero(fresh), filled[fresh]] = number[fresh]
        filled += fresh
    return np.sort(out, axis=1)


def _candidates(d: Spark, s: str, low: int, high: int, size: int) -> str:
    """combos (series_id, combo, number): by posterior, by rarity, balanced and rich in primes; ranks at an offset of a fifth of their place."""
    fixed = lambda name, start, count, numbers: f"SELECT series_id, c AS combo, number FROM (SELECT series_id, {d.seq(str(start), str(start + count - 1))} AS c FROM who) q CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({n})' for n in numbers)}) AS t(number)) {name}"
    ranked = lambda order, where: f"SELECT series_id, number, row_number() OVER (PARTITION BY series_id ORDER BY {order}) - 1 AS place FROM dense {where}"
    parts = [f"SELECT i.series_id, c AS combo, number FROM (SELECT series_id, {d.seq(str(start), str(start + 19))} AS c FROM who) i JOIN ({ranked(order, where)}) r ON r.series_id = i.series_id AND place >= {d.idiv(f'(c - {start})', '4')} AND place < {d.idiv(f'(c - {start})', '4')} + {size}" for start, order, where in ((0, "o DESC, number", ""), (20, "o, number", "WHERE o > 0"))]
    parts += [fixed(name, start, count, numbers) for name, start, count, numbers in (("b", 40, 100, balanced_combination(high, size)), ("p", 140, 50, prime_combination(low, high, size))) if numbers]
    return f"{_dense(d, s, low, high)}, combos AS ({' UNION ALL '.join(parts)})"


def _scores(d: Spark, size: int, low: int, high: int) -> str:
    """scored (series_id, combo, score, ...) of combos, against dense."""
    primes = ", ".join(str(n) for n in range(low, high + 1) if is_prime(n))
    ideal = f"({size} / 3e0)"
    return f"""top_o AS (SELECT series_id AS sid, max(o) AS most FROM dense GROUP BY series_id),
parts AS (SELECT c.series_id, combo, sum((0.5 + o) / (0.5 * k + n)) / {size} AS post, sum(o / most) / {size} AS freq, sum(CASE WHEN c.number BETWEEN 1 AND 9 THEN 1 ELSE 0 END) AS lo, sum(CASE WHEN c.number BETWEEN 10 AND 19 THEN 1 ELSE 0 END) AS mid, sum(CASE WHEN c.number BETWEEN 20 AND 28 THEN 1 ELSE 0 END) AS hi,
  sum(CASE WHEN c.number IN ({primes}) THEN 1 ELSE 0 END) AS primes, sum(c.number) AS total, avg(c.number) AS mean, median(c.number) AS med, stddev_pop(c.number) AS sd, max(c.number) - min(c.number) AS span, sum(CASE WHEN c.number % 2 = 0 THEN 1 ELSE 0 END) AS even FROM combos c JOIN dense f ON f.series_id = c.series_id AND f.number = c.number JOIN top_o ON sid = c.series_id GROUP BY c.series_id, combo),
scored AS (SELECT *, 0.35 * (1 - post) + 0.35 * (1 - freq) + 0.15 / (1 + abs(lo - {ideal}) + abs(mid - {ideal}) + abs(hi - {ideal})) + 0.15 * CASE WHEN primes / {size} >= 0.4 AND primes / {size} <= 0.6 THEN 1e0 WHEN primes / {size} < 0.4 THEN primes / {size} / 0.4 ELSE (1 - primes / {size}) / 0.4 END AS score FROM parts)"""


@operator
def draw_candidates(d: Spark, s: str, low: int = LOW, high: int = HIGH, size: int = SIZE) -> str:
    """A row for each candidate of the four rule-made strategies: its score and properties."""
    return f"""WITH {_candidates(d, s, low, high, size)}, {_scores(d, size, low, high)}
SELECT series_id, cast(combo AS int) AS combo, {d.r('score')} AS score, cast(total AS bigint) AS total, {d.r('mean')} AS mean, {d.r('med')} AS median, {d.r('sd')} AS std_dev, cast(span AS int) AS span, cast(even AS int) AS even, cast(primes AS int) AS primes, cast(lo AS int) AS low, cast(mid AS int) AS medium, cast(hi AS int) AS high FROM scored"""


def critical_path(draws: DataFrame, confidence: float = 0.95, low: int = LOW, high: int = HIGH, size: int = SIZE) -> DataFrame:
    """The best candidate of each series among all strategies, as many as the confidence asks for; of equal scores the last.

    Seeded combinations fill what the rule-made strategies leave.
    """
    spark, made = draws.sparkSession, 190
    names = ["combo", "number"]

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            numbers = spread_combinations(part["id"].to_numpy(), low, high, size)
            yield pd.DataFrame({"combo": np.repeat(part["id"].to_numpy() + made, size), "number": numbers.ravel()})

    more = spark.range(CANDIDATES[confidence] - made).mapInPandas(spread, "combo long, number int").select(*names)
    d = SPARK
    text = f"""WITH {_candidates(d, '{f0}', low, high, size).replace('combos AS', 'ruled AS')}, combos AS (SELECT series_id, cast(combo AS bigint) AS combo, number FROM ruled UNION ALL SELECT series_id, combo, number FROM who CROSS JOIN {{f1}}), {_scores(d, size, low, high)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 12) DESC, combo DESC) AS place, count(*) OVER (PARTITION BY series_id) AS candidates FROM scored),
best AS (SELECT * FROM ranked WHERE place = 1), numbers AS (SELECT series_id, combo, array_join(array_sort(collect_list(cast(number AS int))), ',') AS numbers FROM combos GROUP BY series_id, combo)
SELECT b.series_id, numbers, {d.r('score')} AS score, candidates, cast(total AS bigint) AS total, {d.r('mean')} AS mean, {d.r('med')} AS median, {d.r('sd')} AS std_dev, cast(primes AS int) AS primes FROM best b JOIN numbers n ON n.series_id = b.series_id AND n.combo = b.combo"""
    return spark.sql(doubles(text), f0=draws, f1=more)
