"""Operators on pairs of delay vectors: divergence, correlation integrals, false neighbours, edges by distance.

Pairs are a self-join on the series; what is asked of them is aggregated in the join's stage, never kept as a matrix.
"""

from __future__ import annotations

from driftwood.operators.windows import _delays
from driftwood.plans.dialect import Spark, operator


def _vectors(s: str, m: int, tau: int) -> str:
    return f"vec AS (SELECT * FROM (SELECT series_id, pos, value, count(*) OVER (PARTITION BY series_id) AS len, {_delays(m, tau)} FROM {s}) v WHERE x{m - 1} IS NOT NULL)"


def _distance(m: int) -> str:
    return "sqrt(" + " + ".join(f"(a.x{j} - b.x{j}) * (a.x{j} - b.x{j})" for j in range(m)) + ")"


def _neighbours(d: Spark, s: str, m: int, tau: int) -> str:
    """near (series_id, i, j, dist, len): the nearest vector at a positive distance, max(len / 10, 1) or more places away; ties to the smaller."""
    return f"""{_vectors(s, m, tau)}, far AS (SELECT a.series_id, a.len, a.pos AS i, b.pos AS j, {_distance(m)} AS dist FROM vec a JOIN vec b ON a.series_id = b.series_id AND abs(a.pos - b.pos) >= greatest(1, {d.idiv('a.len', '10')})),
near AS (SELECT series_id, len, i, min(dist) AS dist, min_by(j, round(dist, 12) + j * 1e-15) AS j FROM far WHERE dist > 0 GROUP BY series_id, len, i)"""


@operator
def lyapunov_neighbors(d: Spark, s: str, m: int = 3, tau: int = 1) -> str:
    """A row for each vector that has a neighbour."""
    return f"WITH {_neighbours(d, s, m, tau)} SELECT series_id, i, {d.r('dist')} AS distance FROM near"


def _divergence(d: Spark, s: str, m: int, tau: int) -> str:
    """div (series_id, len, t, y): mean ln distance of neighbours t steps on; 0 where no pair is left."""
    return f"""{_neighbours(d, s, m, tau)}, ahead AS (SELECT series_id, len, i, j, {d.seq('0', f'greatest(10, {d.idiv("len", "10")}) - 1')} AS t FROM near),
moved AS (SELECT h.series_id, len_h AS len, t, {_distance(m)} AS dist FROM (SELECT series_id, len AS len_h, i + t AS p, j + t AS q, t FROM ahead) h JOIN vec a ON a.series_id = h.series_id AND a.pos = p JOIN vec b ON b.series_id = h.series_id AND b.pos = q),
steps AS (SELECT DISTINCT series_id, len, t FROM ahead), means AS (SELECT series_id, t, avg(ln(dist)) AS y FROM moved WHERE dist > 0 GROUP BY series_id, t),
div AS (SELECT z.series_id, len, z.t, coalesce(y, 0e0) AS y FROM steps z LEFT JOIN means n ON n.series_id = z.series_id AND n.t = z.t)"""


@operator
def lyapunov_divergence(d: Spark, s: str, m: int = 3, tau: int = 1) -> str:
    """A row for each step."""
    return f"WITH {_divergence(d, s, m, tau).replace('div AS', 'spread AS')} SELECT series_id, cast(t AS int) AS t, {d.r('y')} AS divergence FROM spread"


@operator
def lyapunov_exponent(d: Spark, s: str, m: int = 3, tau: int = 1, fit_points: int = 20, rate: float = 1.0, min_n: int = 100) -> str:
    """The slope of the divergence over its first steps: positive for chaotic series."""
    return f"""WITH {_divergence(d, s, m, tau).replace('div AS', 'spread AS')}, fit AS (SELECT series_id, len, count(*) AS k, regr_slope(y, t / {rate}) AS slope, regr_r2(y, t / {rate}) AS r2 FROM spread WHERE t < {fit_points} GROUP BY series_id, len), md AS (SELECT series_id AS sid, avg(dist) AS dist FROM near GROUP BY series_id)
SELECT series_id, CASE WHEN len < {min_n} THEN 'insufficient_data' ELSE 'ok' END AS status, cast(len AS bigint) AS n, cast(k AS int) AS points, {d.r('slope')} AS lyapunov_exponent, {d.r('r2')} AS r_squared, {d.r('dist')} AS mean_neighbor_distance FROM fit JOIN md ON sid = series_id"""


def _correlation(d: Spark, s: str, m: int, tau: int, theiler: int, radii: int) -> str:
    """curve (series_id, k, r, c): share of pairs closer than each of the log-spaced radii."""
    return f"""{_vectors(s, m, tau)}, dist AS (SELECT a.series_id, {_distance(m)} AS dist FROM vec a JOIN vec b ON a.series_id = b.series_id AND b.pos > a.pos + {theiler}),
reach AS (SELECT series_id, count(*) AS n, min(CASE WHEN dist > 0 THEN dist END) * 0.01 AS lo, greatest(max(dist) * 0.1, min(CASE WHEN dist > 0 THEN dist END) * 0.02) AS hi FROM dist GROUP BY series_id),
placed AS (SELECT x.series_id, cast(greatest(0e0, floor(CASE WHEN dist < lo THEN 0e0 ELSE (ln(dist) - ln(lo)) / (ln(hi) - ln(lo)) * {radii - 1} + 1 + 1e-9 END)) AS int) AS slot FROM dist x JOIN reach e ON e.series_id = x.series_id WHERE dist < hi),
slots AS (SELECT series_id, slot, count(*) AS o FROM placed GROUP BY series_id, slot), grid AS (SELECT series_id, n, lo, hi, {d.seq('0', str(radii - 1))} AS k FROM reach),
curve AS (SELECT g.series_id, g.k, exp(ln(lo) + g.k * (ln(hi) - ln(lo)) / {radii - 1}) AS r, sum(CASE WHEN slot <= g.k THEN o ELSE 0 END) / n AS c FROM grid g LEFT JOIN slots z ON z.series_id = g.series_id GROUP BY g.series_id, g.k, n, lo, hi)"""


@operator
def correlation_curve(d: Spark, s: str, m: int = 5, tau: int = 1, theiler: int = 0, radii: int = 30) -> str:
    """A row for each radius whose share is neither 0 nor 1."""
    return f"WITH {_correlation(d, s, m, tau, theiler, radii)} SELECT series_id, cast(k AS int) AS k, {d.r('r')} AS radius, {d.r('c', 9)} AS correlation FROM curve WHERE c > 0 AND c < 1"


@operator
def correlation_dimension(d: Spark, s: str, m: int = 5, tau: int = 1, theiler: int = 0, radii: int = 30, fit_points: int = 10, least_r2: float = 0.95) -> str:
    """The slope of the best window of at least fit_points radii, if it fits well; else of the whole curve."""
    return f"""WITH {_correlation(d, s, m, tau, theiler, radii)}, logs AS (SELECT series_id, k, ln(r) AS x, ln(c) AS y FROM curve WHERE c > 0 AND c < 1),
spans AS (SELECT a.series_id, a.k AS i, b.k AS j FROM logs a JOIN logs b ON b.series_id = a.series_id AND b.k >= a.k + {fit_points - 1}),
fits AS (SELECT p.series_id, i, j, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, count(*) AS n FROM spans p JOIN logs l ON l.series_id = p.series_id AND l.k BETWEEN i AND j GROUP BY p.series_id, i, j),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(r2, 9) DESC, i, j) AS place FROM fits WHERE n = j - i + 1 AND r2 > {least_r2}),
entire AS (SELECT series_id, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, count(*) AS n FROM logs GROUP BY series_id)
SELECT w.series_id, {d.r('coalesce(k.slope, w.slope)', 4)} AS correlation_dimension, {d.r('coalesce(k.r2, w.r2)', 4)} AS r_squared, cast(w.n AS int) AS points FROM entire w LEFT JOIN ranked k ON k.series_id = w.series_id AND place = 1"""


@operator
def correlation_dimensions(d: Spark, s: str, least: int = 2, most: int = 7, **config) -> str:
    """A row for each embedding dimension."""
    return " UNION ALL ".join(f"SELECT {m} AS m, q{m}.* FROM ({correlation_dimension.sql(d, s, m=m, **config)}) q{m}" for m in range(least, most + 1))


@operator
def fnn_fraction(d: Spark, s: str, max_dim: int = 5, tau: int = 1, tolerance: float = 15.0) -> str:
    """A row for each embedding dimension: the share of nearest neighbours that part when the series goes on by tau."""
    parts = []
    for m in range(1, max_dim + 1):
        xs = ", ".join(f"lead(value, {j * tau}) OVER (PARTITION BY series_id ORDER BY pos) AS x{j}" for j in range(m))
        vec = f"SELECT series_id, pos, {xs}, lead(value, {tau}) OVER (PARTITION BY series_id ORDER BY pos) AS nxt, count(*) OVER (PARTITION BY series_id) AS len, stddev_pop(value) OVER (PARTITION BY series_id) AS sd FROM {s}"
        parts.append(f"v{m} AS (SELECT * FROM ({vec}) v WHERE pos < len - {(m - 1) * tau} - {tau}), p{m} AS (SELECT a.series_id, a.pos, a.sd, a.nxt, {_distance(m)} AS dist, b.pos AS j, b.nxt AS other FROM v{m} a JOIN v{m} b ON a.series_id = b.series_id AND a.pos <> b.pos),"
                     f" n{m} AS (SELECT series_id, pos, sd, nxt, min(dist) AS dist, min_by(other, round(dist, 12) + j * 1e-15) AS other FROM p{m} WHERE dist > 0 GROUP BY series_id, pos, sd, nxt),"
                     f" f{m} AS (SELECT series_id, {m} AS m, avg(CASE WHEN abs(nxt - other) / dist > {tolerance} OR sqrt(dist * dist + (nxt - other) * (nxt - other)) / sd > {tolerance} THEN 1e0 ELSE 0e0 END) AS fnn FROM n{m} WHERE dist >= 1e-10 AND sd >= 1e-10 GROUP BY series_id)")  # fmt: skip
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(f'SELECT series_id, cast(m AS int) AS m, {d.r("fnn")} AS fnn FROM f{m}' for m in range(1, max_dim + 1))}"


def _planar(d: Spark, s: str, cap: int | None, scaled: bool) -> str:
    """pts (series_id, i, x, y): two-dimensional delay vectors, tau = max(n / 10, 1)."""
    tau = f"greatest(1, {d.idiv('n', '10')})" if cap is None else f"least({cap}, greatest(1, {d.idiv('n', '10')}))"
    raw = f"SELECT a.series_id, a.pos AS i, a.value AS x, b.value AS y FROM (SELECT series_id, pos, value, count(*) OVER (PARTITION BY series_id) AS n FROM {s}) a JOIN {s} b ON b.series_id = a.series_id AND b.pos = a.pos + {tau}"
    if not scaled:
        return f"pts AS ({raw})"
    unit = lambda c: f"CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-10 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE {c} END"
    return f"raw AS ({raw}), pts AS (SELECT series_id, i, {unit('x')} AS x, {unit('y')} AS y FROM raw WINDOW w AS (PARTITION BY series_id))"


_FLAT = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@operator
def planar_edges(d: Spark, s: str, scaled: bool = False, cap: int | None = None) -> str:
    """All pairs of planar delay vectors: series_id, i, j, dist. The input of the union-find operators."""
    return f"WITH {_planar(d, s, cap, scaled)} SELECT a.series_id, cast(a.i AS int) AS i, cast(b.i AS int) AS j, {_FLAT} AS dist FROM pts a JOIN pts b ON a.series_id = b.series_id AND a.i < b.i"


@operator
def filtration_edges(d: Spark, s: str, steps: int = 50) -> str:
    """A row for each filtration step: its scale (up to the distance at three quarters of the sorted pairs) and how many pairs are within."""
    return f"""WITH {_planar(d, s, None, False)}, dist AS (SELECT a.series_id, {_FLAT} AS dist FROM pts a JOIN pts b ON a.series_id = b.series_id AND a.i < b.i),
ranked AS (SELECT series_id, dist, row_number() OVER (PARTITION BY series_id ORDER BY dist) - 1 AS place, count(*) OVER (PARTITION BY series_id) AS n FROM dist),
top AS (SELECT series_id, max(dist) AS most FROM ranked WHERE place <= {d.idiv('3 * n', '4')} GROUP BY series_id), grid AS (SELECT series_id, most, {d.seq('0', str(steps - 1))} AS step FROM top)
SELECT g.series_id, cast(step AS int) AS step, {d.r(f'step / {steps - 1}e0 * most')} AS scale, cast(sum(CASE WHEN dist <= step / {steps - 1}e0 * most * (1 + 1e-12) THEN 1 ELSE 0 END) AS bigint) AS edges FROM grid g JOIN dist x ON x.series_id = g.series_id GROUP BY g.series_id, step, most"""


@operator
def vietoris_rips(d: Spark, s: str, steps: int = 30) -> str:
    """Counts over a filtration in which every step adds its edges and triangles anew: an edge counts once for each step that holds it.

    A triangle is in from the step of its longest edge; no complex is ever built.
    """
    first = f"ceil(dist / (0.75e0 * most) * {steps} - 1e-9)"
    return f"""WITH {_planar(d, s, 5, False)}, pairs AS (SELECT a.series_id, a.i AS i, b.i AS j, {_FLAT} AS dist FROM pts a JOIN pts b ON a.series_id = b.series_id AND a.i < b.i),
tops AS (SELECT series_id AS sid, max(dist) AS most FROM pairs GROUP BY series_id), edges AS (SELECT series_id, i, j, greatest(1, cast({first} AS int)) AS step FROM pairs JOIN tops ON sid = series_id WHERE most > 0 AND dist <= 0.75e0 * most),
tri AS (SELECT a.series_id, greatest(a.step, greatest(b.step, c.step)) AS step FROM edges a JOIN edges b ON b.series_id = a.series_id AND b.i = a.j JOIN edges c ON c.series_id = a.series_id AND c.i = a.i AND c.j = b.j),
v AS (SELECT series_id, count(*) AS v FROM pts GROUP BY series_id), e AS (SELECT series_id, sum({steps} - step + 1) AS e, sum(({steps} - step + 1) * ({steps} + step)) / 2 AS be FROM edges GROUP BY series_id),
t AS (SELECT series_id, sum({steps} - step + 1) AS t, sum(({steps} - step + 1) * ({steps} + step)) / 2 AS bt FROM tri GROUP BY series_id), sums AS (SELECT v.series_id, v, coalesce(e, 0) AS e, coalesce(t, 0) AS t, coalesce(be, 0) + coalesce(bt, 0) AS born FROM v LEFT JOIN e ON e.series_id = v.series_id LEFT JOIN t ON t.series_id = v.series_id)
SELECT series_id, cast(v AS bigint) AS vertices, cast(e AS bigint) AS edges, cast(t AS bigint) AS triangles, cast(v - e + t AS bigint) AS euler_characteristic, cast(v + e + t AS bigint) AS total_simplices, cast(CASE WHEN t > 0 THEN 2 WHEN e > 0 THEN 1 ELSE 0 END AS int) AS max_dimension,
  {d.r('CASE WHEN v > 1 THEN least(1e0, e / (v * (v - 1) / 2e0)) ELSE 0 END')} AS edge_density, {d.r('born / (v + e + t)')} AS avg_birth_step FROM sums"""
