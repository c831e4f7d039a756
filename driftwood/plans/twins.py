"""DuckDB texts for operators that run as grouped functions, where a relational form exists for small series."""

from __future__ import annotations

_R = "(round({0}, 6) + 0e0)"


def _r(x: str) -> str:
    return _R.format(x)


_HANN = "(0.5 - 0.5 * cos(2 * pi() * pos / (n - 1)))"


def fft_spectrum() -> str:
    """A discrete Fourier transform as a join of values and frequencies."""
    return f"""s AS (SELECT series_id, pos, value, count(*) OVER (PARTITION BY series_id) AS n FROM src), k AS (SELECT DISTINCT series_id AS sid, unnest(range(0, n // 2)) AS k FROM s),
z AS (SELECT series_id, n, k, sum(value * {_HANN} * cos(2 * pi() * ((k * pos) % n) / n)) AS re, -sum(value * {_HANN} * sin(2 * pi() * ((k * pos) % n) / n)) AS im FROM s JOIN k ON sid = series_id WHERE n >= 8 GROUP BY series_id, n, k)"""


def fft_power() -> str:
    return f"WITH {fft_spectrum()} SELECT series_id, cast(k AS int) AS k, {_r('k / n')} AS frequency, {_r('re')} AS re, {_r('im')} AS im, {_r('sqrt(re * re + im * im)')} AS magnitude, {_r('(re * re + im * im) / n')} AS power, {_r('atan2(im + 0e0, re)')} AS phase FROM z"


def periodogram() -> str:
    return f"WITH {fft_spectrum()} SELECT series_id, cast(k AS int) AS k, {_r('k / n')} AS frequency, {_r('(re * re + im * im) / n')} AS psd FROM z"


def fft_features() -> str:
    return f"""WITH {fft_spectrum()}, p AS (SELECT series_id, n, k, k / n AS f, (re * re + im * im) / n AS p FROM z), c AS (SELECT *, sum(f * p) OVER (PARTITION BY series_id) / sum(p) OVER (PARTITION BY series_id) AS c FROM p)
SELECT series_id, cast(max(n) AS bigint) AS n, {_r('max_by(f, CASE WHEN k > 0 THEN p ELSE -1 END)')} AS dominant_frequency, {_r('max(CASE WHEN k > 0 THEN p END)')} AS dominant_power, {_r('max(c)')} AS spectral_centroid, {_r('sqrt(sum((f - c) * (f - c) * p) / sum(p))')} AS spectral_bandwidth, {_r('sum(p)')} AS spectral_energy, {_r('sqrt(max(CASE WHEN k = 0 THEN p * n END))')} AS dc_component FROM c GROUP BY series_id"""


_SEGMENTS = """seg AS (SELECT series_id, 256 AS n, unnest(range(0, (len - 256) // 128 + 1)) AS g FROM (SELECT series_id, count(*) AS len FROM src GROUP BY series_id) q WHERE len >= 256),
k AS (SELECT unnest(range(0, 128)) AS k)"""
_IN_SEGMENT = "JOIN seg t ON t.series_id = s.series_id AND s.pos >= 128 * g AND s.pos < 128 * g + 256"


def _welch() -> str:
    return f"""{_SEGMENTS}, w AS (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * i / 255), 2)) AS w FROM range(0, 256) r(i)), x AS (SELECT s.series_id, g, s.pos - 128 * g AS pos, n, value FROM src s {_IN_SEGMENT}),
z AS (SELECT series_id, g, k, sum(value * {_HANN} * cos(2 * pi() * ((k * pos) % 256) / 256)) AS re, sum(value * {_HANN} * sin(2 * pi() * ((k * pos) % 256) / 256)) AS im FROM x CROSS JOIN k GROUP BY series_id, g, k),
p AS (SELECT series_id, k, k / 256 AS f, avg(re * re + im * im) / 256 * (256 / max(w)) AS p FROM z CROSS JOIN w GROUP BY series_id, k)"""


def psd_welch() -> str:
    return f"WITH {_welch()} SELECT series_id, cast(k AS int) AS k, {_r('f')} AS frequency, {_r('p')} AS psd FROM p"


#: The bands end at 0.3, 0.6 and 1 of half the sampling rate.
_BANDS = {"low_band": (0, 0.3), "mid_band": (0.3, 0.6), "high_band": (0.6, 1)}


def _in_bands(of: str) -> str:
    return ", ".join(f"{_r(of.format(f'f >= {a} * 0.5 AND f <= {b} * 0.5'))} AS {name}" for name, (a, b) in _BANDS.items())


def psd_bands() -> str:
    return f"WITH {_welch()} SELECT series_id, {_r('max_by(f, CASE WHEN k > 0 THEN p ELSE -1 END)')} AS peak_frequency, {_r('max(CASE WHEN k > 0 THEN p END)')} AS peak_power, {_r('sum(p) / 256')} AS total_power, {_in_bands('sum(CASE WHEN {} THEN p ELSE 0 END) / 256')} FROM p GROUP BY series_id"


def _coherence() -> str:
    part = lambda v, f: f"sum({v} * {_HANN} * {f}(2 * pi() * ((k * pos) % 256) / 256))"
    return f"""{_SEGMENTS}, v AS (SELECT s.series_id, g, s.pos - 128 * g AS pos, n, x, y FROM src s {_IN_SEGMENT}),
z AS (SELECT series_id, g, k, {part('x', 'cos')} AS xr, -{part('x', 'sin')} AS xi, {part('y', 'cos')} AS yr, -{part('y', 'sin')} AS yi FROM v CROSS JOIN k GROUP BY series_id, g, k),
c AS (SELECT series_id, k, avg(xr * xr + xi * xi) * avg(yr * yr + yi * yi) AS both_, power(avg(xr * yr + xi * yi), 2) + power(avg(xi * yr - xr * yi), 2) AS shared FROM z GROUP BY series_id, k),
p AS (SELECT series_id, k, k / 256 AS f, CASE WHEN both_ > 0 THEN least(1, shared / both_) ELSE 0 END AS p FROM c)"""


def coherence() -> str:
    return f"WITH {_coherence()} SELECT series_id, cast(k AS int) AS k, {_r('f')} AS frequency, {_r('p')} AS coherence FROM p"


def coherence_summary() -> str:
    return f"WITH {_coherence()} SELECT series_id, {_r('avg(p)')} AS mean_coherence, {_r('max(CASE WHEN k > 0 THEN p END)')} AS peak_coherence, {_r('max_by(f, CASE WHEN k > 0 THEN p ELSE -1 END)')} AS peak_frequency, {_in_bands('avg(CASE WHEN {} THEN p END)')} FROM p GROUP BY series_id"


def _halves() -> str:
    """The off-diagonal of the two-part density matrix; its eigenvalues are (1 + c) / 2 and (1 - c) / 2."""
    return """h AS (SELECT series_id, pos, value, n, CASE WHEN pos < n // 2 THEN 0 ELSE 1 END AS half FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM src) q),
u AS (SELECT series_id, n, half, pos - half * (n // 2) AS i, (value - avg(value) OVER (PARTITION BY series_id, half)) / stddev_pop(value) OVER (PARTITION BY series_id, half) AS u FROM h),
c AS (SELECT a.series_id, a.n, avg(a.u * b.u) AS signed_c, abs(avg(a.u * b.u)) AS c FROM u a JOIN u b ON b.series_id = a.series_id AND b.half = 1 AND a.half = 0 AND b.i = a.i GROUP BY a.series_id, a.n)"""


def density_matrix() -> str:
    return f"WITH {_halves()} SELECT series_id, cast(n AS bigint) AS n, {_r('(1 + c * c) / 2')} AS purity, {_r('2 / (1 + c * c)')} AS participation_ratio, cast(CASE WHEN (1 - c) / 2 > 1e-10 THEN 2 ELSE 1 END AS int) AS effective_dimension, {_r('(1 + c) / 2')} AS eigenvalue_1, {_r('(1 - c) / 2')} AS eigenvalue_2 FROM c"


def density_matrix_entries() -> str:
    return f"WITH {_halves()}, places AS (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) SELECT series_id, cast(i AS int) AS i, cast(j AS int) AS j, {_r('CASE WHEN i = j THEN 0.5 ELSE signed_c / 2 END')} AS value FROM c CROSS JOIN places"


def density_checks() -> str:
    return f"WITH {_halves()} SELECT series_id, 0e0 AS hermitian_error, 1e0 AS trace, true AS is_valid FROM c"


def _nats(x: str) -> str:
    return f"(CASE WHEN {x} > 1e-12 THEN -{x} * log2({x}) ELSE 0 END)"


def von_neumann_entropy() -> str:
    s = _nats("((1 + c) / 2)") + " + " + _nats("((1 - c) / 2)")
    return f"""WITH {_halves()}, lim AS (SELECT series_id, count(*) AS n, ceil(sqrt(count(*))) AS k, min(value) AS low, max(value) AS high FROM src GROUP BY series_id),
bins AS (SELECT s.series_id, least(k - 1, floor((value - low) / ((high - low) / k))) AS bin, count(*) / max(n) AS share FROM src s JOIN lim USING (series_id) WHERE high - low >= 1e-10 GROUP BY s.series_id, 2),
shannon AS (SELECT series_id, sum({_nats('share')}) AS h FROM bins GROUP BY series_id)
SELECT c.series_id, cast(n AS bigint) AS n, {_r(s)} AS von_neumann_entropy, {_r('coalesce(h, 0)')} AS shannon_entropy, 1e0 AS max_entropy, {_r(s)} AS normalized_entropy, {_r(f'power(2, -({s}))')} AS purity_from_entropy FROM c LEFT JOIN shannon USING (series_id)"""


def _divided() -> str:
    """s: of each series and cut (0: none) the entropy of the values before and behind it, each part halved again."""
    return f"""sizes AS (SELECT series_id, count(*) AS n FROM src GROUP BY series_id HAVING count(*) >= 2), cuts AS (SELECT series_id, n, unnest(range(1, n)) AS t FROM sizes),
segs AS (SELECT series_id, n, 0 AS t, 0 AS kind, 0 AS lo, n AS len FROM sizes UNION ALL SELECT series_id, n, t, 1, 0, t FROM cuts UNION ALL SELECT series_id, n, t, 2, t, n - t FROM cuts),
h AS (SELECT g.series_id, n, t, kind, len, CASE WHEN pos - lo < len // 2 THEN 0 ELSE 1 END AS half, pos - lo - CASE WHEN pos - lo < len // 2 THEN 0 ELSE len // 2 END AS i, value FROM segs g JOIN src x ON x.series_id = g.series_id AND pos >= lo AND pos < lo + len),
u AS (SELECT *, (value - avg(value) OVER w) / (CASE WHEN stddev_pop(value) OVER w > 1e-10 THEN stddev_pop(value) OVER w ELSE 1 END) AS u FROM h WINDOW w AS (PARTITION BY series_id, t, kind, half)),
d AS (SELECT series_id, n, t, kind, len, avg(CASE WHEN half = 0 THEN u * u END) AS d0, avg(CASE WHEN half = 1 THEN u * u END) AS d1 FROM u GROUP BY series_id, n, t, kind, len),
x AS (SELECT a.series_id, a.t, a.kind, avg(a.u * b.u) AS c FROM u a JOIN u b ON b.series_id = a.series_id AND b.t = a.t AND b.kind = a.kind AND a.half = 0 AND b.half = 1 AND a.i = b.i GROUP BY a.series_id, a.t, a.kind),
l AS (SELECT d.*, (d0 + d1) / 2 + sqrt(power((d0 - d1) / 2, 2) + c * c) AS l1, (d0 + d1) / 2 - sqrt(power((d0 - d1) / 2, 2) + c * c) AS l2 FROM d LEFT JOIN x USING (series_id, t, kind)),
q AS (SELECT *, CASE WHEN l1 < 1e-10 THEN 0 ELSE l1 END AS p1, CASE WHEN l2 < 1e-10 THEN 0 ELSE l2 END AS p2 FROM l),
s AS (SELECT series_id, n, t, kind, CASE WHEN len = 1 THEN 0 WHEN p1 + p2 < 1e-10 THEN 1 ELSE {_nats('(p1 / (p1 + p2))')} + {_nats('(p2 / (p1 + p2))')} END AS s FROM q),
e AS (SELECT s.series_id, s.n, s.t, w.s AS whole, sum(s.s) AS parts, sum(CASE WHEN s.kind = 1 THEN s.s ELSE 0 END) AS first, sum(CASE WHEN s.kind = 2 THEN s.s ELSE 0 END) AS rest FROM s JOIN s w ON w.series_id = s.series_id AND w.t = 0 WHERE s.t > 0 GROUP BY s.series_id, s.n, s.t, w.s)"""


def integrated_information() -> str:
    return f"""WITH {_divided()}, best AS (SELECT series_id AS sid, min(whole - parts) AS phi FROM e GROUP BY series_id), f AS (SELECT series_id, n, whole, phi, min(t) AS cut FROM e JOIN best ON sid = series_id WHERE whole - parts <= phi + 1e-12 GROUP BY series_id, n, whole, phi)
SELECT series_id, cast(n AS bigint) AS n, {_r('phi')} AS phi, {_r('whole')} AS total_entropy, {_r('CASE WHEN whole > 1e-10 THEN phi / whole END')} AS integration_ratio, {_r('sqrt(abs(phi) * whole)')} AS complexity, cast(cut AS int) AS mip_cut, phi > 1e-10 AS is_integrated, phi <= 1e-10 AS is_reducible FROM f"""


def effective_information() -> str:
    return f"WITH {_divided()} SELECT series_id, cast(t AS int) AS cut, {_r('whole')} AS total_entropy, {_r('parts')} AS parts_entropy, {_r('whole - parts')} AS effective_information FROM e"


def entanglement() -> str:
    return f"WITH {_divided()} SELECT series_id, cast(t AS int) AS size, {_r('whole')} AS entropy, {_r('first')} AS entropy_first, {_r('rest')} AS entropy_rest, {_r('first + rest - whole')} AS mutual_information, {_r('whole - rest')} AS conditional_entropy, abs(whole - first - rest) < 1e-6 AS is_separable FROM e WHERE t = n // 2"


def dfa_polynomial(order: int) -> str:
    """Residuals against the discrete orthogonal polynomials of a box's length, whose squared norms are known."""
    z, norms = "(i - (box - 1) / 2e0)", ["box", "box * (box * box - 1e0) / 12", "box * (box * box - 1e0) * (box * box - 4) / 180", "box * (box * box - 1e0) * (box * box - 4) * (box * box - 9) / 2800"]
    p = ["1", z, f"({z} * {z} - (box * box - 1e0) / 12)", f"({z} * {z} * {z} - {z} * (3e0 * box * box - 7) / 20)"]
    parts = " ".join(f"- power(sum((y - c) * {p[k]}), 2) / max({norms[k]})" for k in range(order + 1))
    return f"""WITH profile AS (SELECT series_id, pos, n, sum(value - mu) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS mu, count(*) OVER (PARTITION BY series_id) AS n FROM src) s WHERE n >= 100),
sizes AS (SELECT DISTINCT series_id, n, cast(floor(exp(ln(4) + i * (ln(n // 4) - ln(4)) / 19) + 0.5) AS int) AS box FROM (SELECT DISTINCT series_id, n FROM profile) q, range(0, 20) r(i)),
boxes AS (SELECT * FROM sizes WHERE box > {order + 1} AND box <= n // 4),
members AS (SELECT series_id, box, pos // box AS part, pos % box AS i, y FROM profile JOIN boxes USING (series_id, n) WHERE pos // box < n // box
  UNION ALL SELECT series_id, box, -1, pos - (n - box), y FROM profile JOIN boxes USING (series_id, n) WHERE pos >= n - box AND n % box >= box // 2),
centred AS (SELECT *, avg(y) OVER (PARTITION BY series_id, box, part) AS c FROM members),
rest AS (SELECT series_id, box, greatest(0, sum((y - c) * (y - c)) {parts}) AS ssr FROM centred GROUP BY series_id, box, part),
f AS (SELECT series_id, box, ln(sqrt(avg(ssr)) + 1e-300) AS f, ln(sqrt(avg(ssr) / box) + 1e-300) AS g, row_number() OVER (PARTITION BY series_id ORDER BY box) AS rank FROM rest GROUP BY series_id, box)
SELECT series_id, cast(count(*) AS int) AS boxes, {_r('regr_slope(f, rank)')} AS hurst_exponent, {_r('regr_r2(f, rank)')} AS r_squared, {_r('regr_slope(g, ln(box))')} AS hurst_std FROM f GROUP BY series_id"""


def _search(edges: str) -> str:
    """steps (series_id, n, source, k, front): the nodes that a search from each node first meets after k steps; seen holds all so far."""
    return f"""pairs AS ({edges}), links AS (SELECT series_id, e.src AS i, e.dst AS j FROM pairs e UNION ALL SELECT series_id, e.dst, e.src FROM pairs e),
around AS (SELECT s.series_id, s.pos, list(j) FILTER (j IS NOT NULL) AS near FROM src s LEFT JOIN links l ON l.series_id = s.series_id AND l.i = s.pos GROUP BY s.series_id, s.pos),
graph AS (SELECT series_id, count(*) AS n, list(coalesce(near, []) ORDER BY pos) AS near FROM around GROUP BY series_id HAVING count(*) >= 5),
steps AS (SELECT series_id, n, pos AS source, 0 AS k, [pos] AS front, [pos] AS seen FROM src JOIN graph USING (series_id)
  UNION ALL SELECT series_id, n, source, k + 1, new, list_concat(seen, new) FROM (SELECT s.*, list_filter(list_distinct(flatten(list_transform(front, lambda v: near[v + 1]))), lambda v: NOT list_contains(seen, v)) AS new FROM steps s JOIN graph g USING (series_id)) t WHERE len(new) > 0)"""


def graph_paths(edges: str) -> str:
    return f"""WITH RECURSIVE {_search(edges)}, whole AS (SELECT series_id, source, max_by(list_min(seen), k) AS least FROM steps GROUP BY series_id, source),
parts AS (SELECT series_id, count(*) AS parts FROM whole WHERE least = source GROUP BY series_id),
s AS (SELECT series_id, n, max(k) AS k, sum(k * len(front)) / nullif(sum(CASE WHEN k > 0 THEN len(front) END), 0) AS mean FROM steps GROUP BY series_id, n)
SELECT series_id, cast(n AS bigint) AS nodes, CASE WHEN n < 1000 THEN cast(k AS int) END AS diameter, {_r('coalesce(mean, 0)')} AS average_path_length, cast(parts AS int) AS components FROM s JOIN parts USING (series_id)"""


_SPREAD = f"avg(c) AS a, var_pop(c) AS v, (max(c) * count(*) - sum(c)) / (count(*) - 1) AS z FROM c GROUP BY series_id) SELECT series_id, '{{0}}' AS measure, {_r('a')} AS average, {_r('v')} AS variance, {_r('z')} AS centralization FROM s"


def closeness(edges: str) -> str:
    return f"""WITH RECURSIVE {_search(edges)}, c AS (SELECT series_id, source, coalesce(sum(CASE WHEN k > 0 THEN len(front) END) / sum(CASE WHEN k > 0 THEN k * len(front) END), 0) AS c FROM steps GROUP BY series_id, source),
s AS (SELECT series_id, {_SPREAD.format('closeness')}"""


def betweenness(edges: str) -> str:
    """By its definition: over all ordered pairs, the share of shortest ways that pass a node."""
    return f"""WITH RECURSIVE {_search(edges)}, far AS (SELECT series_id, n, source, unnest(front) AS node, k FROM steps),
ways AS (SELECT series_id, source, node, 0 AS k, 1e0 AS ways FROM far WHERE k = 0
  UNION ALL SELECT w.series_id, w.source, f.node, f.k, sum(w.ways) FROM ways w JOIN links l ON l.series_id = w.series_id AND l.i = w.node JOIN far f ON f.series_id = w.series_id AND f.source = w.source AND f.node = l.j AND f.k = w.k + 1 GROUP BY w.series_id, w.source, f.node, f.k),
through AS (SELECT a.series_id, a.node, sum(a.ways * b.ways / t.ways) AS share FROM ways a JOIN ways b ON b.series_id = a.series_id AND b.source = a.node AND a.k > 0 AND b.k > 0 JOIN ways t ON t.series_id = a.series_id AND t.source = a.source AND t.node = b.node AND t.k = a.k + b.k GROUP BY a.series_id, a.node),
c AS (SELECT f.series_id, f.node, coalesce(share, 0) / ((n - 1) * (n - 2) / 2) AS c FROM far f LEFT JOIN through t ON t.series_id = f.series_id AND t.node = f.node WHERE f.k = 0),
s AS (SELECT series_id, {_SPREAD.format('betweenness')}"""


def _betti(scales: int = 20) -> str:
    """curve: of each scale the components, found by a search that begins anew in the first node left, and the edges."""
    scaled = lambda c: f"CASE WHEN max({c}) OVER w - min({c}) OVER w > 1e-10 THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE {c} END"
    return f"""len AS (SELECT series_id, count(*) AS len, greatest(1, count(*) // 10) AS tau FROM src GROUP BY series_id HAVING count(*) >= 30),
points AS (SELECT a.series_id, a.pos, len - tau AS n, a.value AS x, b.value AS y FROM src a JOIN len l ON l.series_id = a.series_id JOIN src b ON b.series_id = a.series_id AND b.pos = a.pos + tau),
p AS (SELECT series_id, pos, n, {scaled('x')} AS x, {scaled('y')} AS y FROM points WINDOW w AS (PARTITION BY series_id)),
d AS (SELECT a.series_id, a.n, a.pos AS i, b.pos AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON b.series_id = a.series_id AND a.pos <> b.pos),
e AS (SELECT series_id, n, k, (k + 1) / {scales} * 0.75e0 * max(d) AS eps FROM d, range(0, {scales}) r(k) GROUP BY series_id, n, k),
around AS (SELECT e.series_id, e.n, k, eps, i, list(j) FILTER (d <= eps) AS near, count(*) FILTER (d <= eps) AS many FROM e JOIN d ON d.series_id = e.series_id GROUP BY e.series_id, e.n, k, eps, i),
graph AS (SELECT series_id, n, k, eps, sum(many) / 2 AS edges, list(coalesce(near, []) ORDER BY i) AS near FROM around GROUP BY series_id, n, k, eps),
search AS (SELECT series_id, k, 1 AS b0, [0] AS front, range(1, n) AS rest FROM graph
  UNION ALL SELECT series_id, k, CASE WHEN len(new) = 0 THEN b0 + 1 ELSE b0 END, CASE WHEN len(new) = 0 THEN [rest[1]] ELSE new END, CASE WHEN len(new) = 0 THEN rest[2:] ELSE list_filter(rest, lambda v: NOT list_contains(new, v)) END
    FROM (SELECT s.*, list_filter(list_distinct(flatten(list_transform(front, lambda v: near[v + 1]))), lambda v: list_contains(rest, v)) AS new FROM search s JOIN graph g ON g.series_id = s.series_id AND g.k = s.k WHERE len(rest) > 0) t),
parts AS (SELECT series_id, k, max(b0) AS b0 FROM search GROUP BY series_id, k),
curve AS (SELECT g.series_id, g.k, eps, b0, CASE WHEN edges >= n THEN edges - n + b0 ELSE 0 END AS b1 FROM graph g JOIN parts t ON t.series_id = g.series_id AND t.k = g.k)"""


def betti_curve() -> str:
    return f"WITH RECURSIVE {_betti()} SELECT series_id, cast(k AS int) AS step, {_r('eps')} AS scale, cast(b0 AS int) AS b0, cast(b1 AS int) AS b1, cast(0 AS int) AS b2, cast(b0 - b1 AS int) AS euler, cast(b0 + b1 AS int) AS total_features FROM curve"


def betti_summary() -> str:
    return f"""WITH RECURSIVE {_betti()}, top AS (SELECT series_id, k AS step, eps, b0, b1 FROM curve QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY b1 DESC, k) = 1),
means AS (SELECT series_id, avg(b0) AS a0, avg(b1) AS a1, count(*) FILTER (b0 = 1 AND b1 = 0) AS trivial FROM curve GROUP BY series_id)
SELECT t.series_id, cast(step AS int) AS optimal_step, {_r('eps')} AS optimal_scale, cast(b0 AS int) AS b0, cast(b1 AS int) AS b1, cast(b0 - b1 AS int) AS euler, {_r('cast(b1 AS double)')} AS complexity, {_r('a0')} AS avg_b0, {_r('a1')} AS avg_b1, cast(trivial AS int) AS trivial_scales FROM top t JOIN means m ON m.series_id = t.series_id"""
