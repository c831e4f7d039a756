"""Counts, histograms and tests on them: one row a series unless said otherwise.

Dense domains (all bins, all residues) are joined from the left, so cells that nothing falls in count as zeros.
status tells why a series has no figures; its metrics are then null.
"""

from __future__ import annotations

from driftwood.plans.dialect import Spark, operator, two_sided_normal


@operator
def series_statistics(d: Spark, s: str) -> str:
    return f"""SELECT series_id, cast(count(*) AS bigint) AS n, {d.r('avg(value)')} AS mean, {d.r('median(value)')} AS median, {d.r('stddev_pop(value)')} AS std_dev,
  {d.r('min(value)')} AS min, {d.r('max(value)')} AS max FROM {s} GROUP BY series_id"""


def _bins(d: Spark, s: str, bins: str) -> str:
    """Common tables: extent (n, low, high, k) and counts (series_id, bin, o) over all bins; the maximum is in the last."""
    return f"""extent AS (SELECT series_id, count(*) AS n, min(value) AS low, max(value) AS high, cast({bins} AS int) AS k FROM {s} GROUP BY series_id),
cells AS (SELECT series_id, n, low, high, k, {d.seq('0', 'k - 1')} AS bin FROM extent),
placed AS (SELECT x.series_id, CASE WHEN high = low THEN 0 ELSE cast(least(k - 1, floor((value - low) / ((high - low) / k))) AS int) END AS bin FROM {s} x JOIN extent e ON x.series_id = e.series_id),
counted AS (SELECT series_id, bin, count(*) AS o FROM placed GROUP BY series_id, bin),
counts AS (SELECT c.series_id, n, k, low, high, c.bin, coalesce(o, 0) AS o FROM cells c LEFT JOIN counted t ON t.series_id = c.series_id AND t.bin = c.bin)"""


STURGES = "ceil(1 + log2(count(*)))"


@operator
def chi_squared_bins(d: Spark, s: str, bins: int | None = None) -> str:
    """A row for each bin: observed and expected counts under uniformity."""
    return f"WITH {_bins(d, s, bins or STURGES)} SELECT series_id, cast(bin AS int) AS bin, cast(o AS bigint) AS observed, {d.r('n / k')} AS expected FROM counts"


@operator
def chi_squared_test(d: Spark, s: str, bins: int | None = None, alpha: float = 0.05, min_n: int = 30) -> str:
    p = d.chi2_sf("chi", "k - 1")
    return f"""WITH {_bins(d, s, bins or STURGES)},
stat AS (SELECT series_id, n, k, sum((o - n / k) * (o - n / k) / (n / k)) AS chi FROM counts GROUP BY series_id, n, k),
told AS (SELECT *, CASE WHEN n < {min_n} THEN 'insufficient_data' WHEN n / k < 5 THEN 'validation' ELSE 'ok' END AS status FROM stat)
SELECT series_id, status, cast(n AS bigint) AS n, cast(k AS int) AS bins, cast(k - 1 AS int) AS dof, {d.r("CASE WHEN status = 'ok' THEN chi END")} AS chi_squared, {d.r(f"CASE WHEN status = 'ok' THEN {p} END")} AS p_value,
  CASE WHEN status = 'ok' THEN {p} > {alpha} END AS is_uniform FROM told"""


@operator
def partition_balance(d: Spark, s: str, partitions: int = 10, min_each: int = 5) -> str:
    """Balance of equal-width partitions: chi-squared, spread of counts, entropy and variance."""
    m = partitions
    return f"""WITH extent AS (SELECT series_id, count(*) AS n, min(value) AS low, max(value) + ((max(value) - min(value)) * 1e-10 + 1e-10) AS high FROM {s} GROUP BY series_id),
cells AS (SELECT series_id, n, {d.seq('0', str(m - 1))} AS bin FROM extent),
placed AS (SELECT x.series_id, cast(least({m - 1}, floor((value - low) / ((high - low) / {m}))) AS int) AS bin FROM {s} x JOIN extent e ON x.series_id = e.series_id),
counted AS (SELECT series_id, bin, count(*) AS o FROM placed GROUP BY series_id, bin),
counts AS (SELECT c.series_id, n, coalesce(o, 0) AS o FROM cells c LEFT JOIN counted t ON t.series_id = c.series_id AND t.bin = c.bin),
stat AS (SELECT series_id, n, sum((o - n / {m}) * (o - n / {m}) / (n / {m})) AS chi, max(o) AS most, min(o) AS least_o, avg((o - n / {m}) * (o - n / {m})) AS var,
  -sum(CASE WHEN o > 0 THEN o / n * ln(o / n) ELSE 0 END) AS h FROM counts GROUP BY series_id, n)
SELECT series_id, CASE WHEN n < {m * min_each} THEN 'insufficient_data' WHEN least_o < {min_each} THEN 'validation' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r('chi')} AS chi_squared, {d.r(d.chi2_sf('chi', str(m - 1)))} AS p_value,
  {d.r('1 - (most - least_o) / n')} AS balance_coefficient, {d.r('h')} AS entropy, {d.r(f'h / ln({m})')} AS normalized_entropy, {d.r('var')} AS partition_variance, cast(most AS bigint) AS max_count, cast(least_o AS bigint) AS min_count FROM stat"""


_EVEN = "CASE WHEN abs(round(value)) % 2 < 0.5 THEN 1 ELSE 0 END"


@operator
def parity_test(d: Spark, s: str, min_n: int = 50, tolerance: float = 1e-6) -> str:
    chi = "(2 * (even - n / 2) * (even - n / 2) / (n / 2))"
    return f"""WITH c AS (SELECT series_id, count(*) AS n, sum({_EVEN}) AS even, max(abs(value - round(value))) AS off FROM {s} GROUP BY series_id)
SELECT series_id, CASE WHEN n < {min_n} THEN 'insufficient_data' ELSE 'ok' END AS status, cast(n AS bigint) AS n, cast(even AS bigint) AS n_even, cast(n - even AS bigint) AS n_odd, off < {tolerance} AS is_integer,
  {d.r('least(even, n - even) / greatest(1, greatest(even, n - even))')} AS balance_ratio, {d.r(chi)} AS chi_squared, {d.r(d.chi2_sf(chi, '1'))} AS p_value FROM c"""


@operator
def digit_parity(d: Spark, s: str, positions: int = 5) -> str:
    """A row for each decimal position, from the units."""
    digit = f"{d.idiv('cast(abs(round(value)) AS bigint)', 'cast(power(10, position) AS bigint)')} % 10"
    chi = "(2 * (even - n / 2) * (even - n / 2) / (n / 2))"
    return f"""WITH e AS (SELECT series_id, value, {d.seq('0', str(positions - 1))} AS position FROM {s}),
c AS (SELECT series_id, position, count(*) AS n, sum(CASE WHEN ({digit}) % 2 = 0 THEN 1 ELSE 0 END) AS even FROM e GROUP BY series_id, position)
SELECT series_id, cast(position AS int) AS position, cast(even AS bigint) AS n_even, cast(n - even AS bigint) AS n_odd, {d.r(chi)} AS chi_squared, {d.r(d.chi2_sf(chi, '1'))} AS p_value FROM c"""


def _runs(d: Spark, flags: str) -> str:
    """Wald-Wolfowitz over (series_id, pos, up): null figures where one class is empty."""
    return f"""turns AS (SELECT series_id, up, CASE WHEN up = lag(up) OVER (PARTITION BY series_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM {flags}),
sums AS (SELECT series_id, cast(sum(up) AS double) AS a, cast(sum(1 - up) AS double) AS b, sum(turn) AS runs FROM turns GROUP BY series_id),
wald AS (SELECT series_id, runs, a, b, CASE WHEN a > 0 AND b > 0 THEN 2 * a * b / (a + b) + 1 END AS mu, CASE WHEN a > 0 AND b > 0 AND a + b > 1 THEN 2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1)) END AS var FROM sums),
scored AS (SELECT series_id, runs, CASE WHEN var > 0 THEN (runs - mu) / sqrt(var) END AS z FROM wald)"""


@operator
def parity_runs(d: Spark, s: str) -> str:
    return f"""WITH flags AS (SELECT series_id, pos, {_EVEN} AS up FROM {s}), {_runs(d, 'flags')}
SELECT series_id, cast(runs AS bigint) AS runs, {d.r('z')} AS z, {d.r(two_sided_normal(d, 'z'))} AS p_value FROM scored"""


def mod_power(a: str, exponent: int, p: int) -> str:
    """a ** exponent mod p by squaring, for small p: products stay within 64 bits."""
    out, base = "1", a
    while exponent:
        if exponent & 1:
            out = f"(({out}) * ({base}) % {p})"
        exponent >>= 1
        if exponent:
            base = f"(({base}) * ({base}) % {p})"
    return out


def is_prime(n: int) -> bool:
    return n >= 2 and all(n % k for k in range(2, int(n**0.5) + 1))


def divisors(n: int) -> list[int]:
    return [k for k in range(1, n + 1) if n % k == 0]


def _order(a: int, p: int) -> int | None:
    return next((k for k in divisors(p - 1) if pow(a, k, p) == 1), None) if a % p else None


def _residue_table(p: int) -> str:
    """A row for each residue mod p: its multiplicative order (null for 0) and Legendre symbol. p rows."""
    if not is_prime(p) or p > 10_000:
        raise ValueError(f"the modulus must be a prime up to 10000, not {p}")
    rows = ", ".join(f"({r}, {_order(r, p) or 'NULL'}, {0 if r == 0 else 1 if pow(r, (p - 1) // 2, p) == 1 else -1})" for r in range(p))
    return f"SELECT * FROM (VALUES {rows}) AS t(r, ord, sym)"


def critical_value(df: float, alpha: float) -> float:
    """Wilson and Hilferty's value; the reference results take the two-sided normal quantile (fixed values)."""
    z = next((q for a, q in ((0.001, 3.291), (0.01, 2.576), (0.05, 1.960), (0.10, 1.645)) if alpha <= a), 1.282)
    h = 2 / (9 * df)
    return df * (1 - h + z * h**0.5) ** 3


def _residues(d: Spark, s: str, p: int) -> str:
    return f"residues AS (SELECT series_id, pos, cast(floor(abs(value)) AS bigint) % {p} AS r FROM {s})"


@operator
def finite_field(d: Spark, s: str, p: int = 97, alpha: float = 0.05) -> str:
    """Distribution of |value| mod p, its zeros, and how many residues generate the field."""
    crit = critical_value(p - 1, alpha)
    return f"""WITH {_residues(d, s, p)}, field AS ({_residue_table(p)}),
n_of AS (SELECT series_id, count(*) AS n FROM residues GROUP BY series_id),
counted AS (SELECT series_id, r, count(*) AS o FROM residues GROUP BY series_id, r),
dense AS (SELECT n_of.series_id, n, f.r, ord, coalesce(o, 0) AS o FROM n_of CROSS JOIN field f LEFT JOIN counted c ON c.series_id = n_of.series_id AND c.r = f.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY o DESC, r) AS place FROM dense),
stat AS (SELECT series_id, n, sum((o - n / {p}) * (o - n / {p}) / (n / {p})) AS chi, sum(CASE WHEN ord = {p - 1} THEN o ELSE 0 END) AS roots, sum(CASE WHEN r = 0 THEN o ELSE 0 END) AS zeros,
  sum(CASE WHEN o > 0 THEN 1 ELSE 0 END) AS seen, max(CASE WHEN place = 1 THEN r END) AS common, max(o) AS most FROM ranked GROUP BY series_id, n)
SELECT series_id, CASE WHEN n < {max(5 * p, 100)} THEN 'insufficient_data' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r('chi')} AS chi_squared, {d.r(str(crit))} AS critical_value, chi <= {crit!r} AS is_uniform,
  cast(seen AS bigint) AS unique_residues, cast(zeros AS bigint) AS zero_count, cast(roots AS bigint) AS primitive_roots, cast(common AS bigint) AS most_common, cast(most AS bigint) AS most_common_count FROM stat"""


@operator
def finite_field_orders(d: Spark, s: str, p: int = 97) -> str:
    """A row for each multiplicative order that occurs."""
    return f"WITH {_residues(d, s, p)}, field AS ({_residue_table(p)}) SELECT series_id, cast(ord AS int) AS ord, cast(count(*) AS bigint) AS n FROM residues x JOIN field f ON x.r = f.r WHERE ord IS NOT NULL GROUP BY series_id, ord"


def _symbols(d: Spark, s: str, p: int) -> str:
    return f"{_residues(d, s, p)}, field AS ({_residue_table(p)}), symbols AS (SELECT series_id, pos, sym FROM residues x JOIN field f ON x.r = f.r)"


@operator
def quadratic_residues(d: Spark, s: str, p: int = 97) -> str:
    chi = "CASE WHEN q + m > 0 THEN (q - m) * (q - m) / (q + m) ELSE 0 END"
    return f"""WITH {_symbols(d, s, p)}, c AS (SELECT series_id, count(*) AS n, cast(sum(CASE WHEN sym = 1 THEN 1 ELSE 0 END) AS double) AS q, cast(sum(CASE WHEN sym = -1 THEN 1 ELSE 0 END) AS double) AS m FROM symbols GROUP BY series_id)
SELECT series_id, CASE WHEN n < 100 THEN 'insufficient_data' ELSE 'ok' END AS status, cast(q AS bigint) AS residues, cast(m AS bigint) AS nonresidues, cast(n - q - m AS bigint) AS zeros, {d.r('100 * q / n')} AS residue_percent, {d.r(chi)} AS chi_squared, ({chi}) <= 3.841 AS is_balanced FROM c"""


@operator
def qr_patterns(d: Spark, s: str, p: int = 97) -> str:
    """A row for each pair of neighbouring symbols that occurs; pairs with a zero are left out."""
    name = lambda c: f"CASE WHEN {c} = 1 THEN 'QR' ELSE 'NQR' END"
    return f"""WITH {_symbols(d, s, p)}, n AS (SELECT series_id, sym, lead(sym) OVER (PARTITION BY series_id ORDER BY pos) AS after FROM symbols)
SELECT series_id, concat({name('sym')}, '-', {name('after')}) AS pattern, cast(count(*) AS bigint) AS n FROM n WHERE sym <> 0 AND after <> 0 GROUP BY 1, 2"""


@operator
def qr_run_lengths(d: Spark, s: str, p: int = 97) -> str:
    """Mean, longest and number of runs of each symbol; zeros break runs."""
    return f"""WITH {_symbols(d, s, p)}, turns AS (SELECT series_id, pos, sym, CASE WHEN sym = lag(sym) OVER (PARTITION BY series_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM symbols),
islands AS (SELECT series_id, sym, sum(turn) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM turns),
runs AS (SELECT series_id, sym, run, count(*) AS len FROM islands WHERE sym <> 0 GROUP BY series_id, sym, run)
SELECT series_id, cast(sym AS int) AS sym, cast(count(*) AS bigint) AS runs, {d.r('avg(len)')} AS mean_length, cast(max(len) AS bigint) AS longest FROM runs GROUP BY series_id, sym"""


def _log(base: str) -> str:
    return {"2": "log2", "e": "ln", "10": "log10"}[base]


@operator
def shannon_entropy(d: Spark, s: str, discrete: bool = False, bins: int | None = None, base: str = "2") -> str:
    """Entropy over equal-width bins, or over rounded values where these are categories."""
    log = _log(base)
    cells = f"WITH raw AS (SELECT series_id, round(value) AS c FROM {s}), counts AS (SELECT series_id, c, count(*) AS o, sum(count(*)) OVER (PARTITION BY series_id) AS n, count(*) OVER (PARTITION BY series_id) AS k FROM raw GROUP BY series_id, c)" if discrete else f"WITH {_bins(d, s, bins or STURGES)}"
    return f"""{cells}, h AS (SELECT series_id, n, k, -sum(CASE WHEN o > 0 THEN o / n * {log}(o / n) ELSE 0 END) AS h, sum(o * o / n / n) AS gini FROM counts GROUP BY series_id, n, k),
m AS (SELECT *, CASE WHEN k > 1 THEN {log}(k) ELSE 0e0 END AS most FROM h)
SELECT series_id, CASE WHEN n < 10 THEN 'insufficient_data' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r('h')} AS entropy, {d.r('most')} AS max_entropy, {d.r('CASE WHEN most > 0 THEN h / most ELSE 0 END')} AS normalized_entropy,
  {d.r('most - h')} AS redundancy, {d.r('1 - gini')} AS diversity, {d.r('gini')} AS gini_simpson_index FROM m"""


@operator
def mutual_information(d: Spark, s: str, bins: int | None = None, base: str = "2") -> str:
    """Of paired values (series_id, pos, x, y): all three entropies from one pass with grouping sets."""
    log = _log(base)
    k = str(bins) if bins else "cast(greatest(2, ceil(1 + 0.8 * log2(n))) AS int)"
    cell = lambda c: f"CASE WHEN {c}1 = {c}0 THEN 0 ELSE cast(least({k} - 1, floor(({c} - {c}0) / (({c}1 - {c}0) / {k}))) AS int) END"
    return f"""WITH extent AS (SELECT series_id AS sid, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {s} GROUP BY series_id),
placed AS (SELECT sid AS series_id, n, {cell('x')} AS bx, {cell('y')} AS by_ FROM {s} p JOIN extent e ON e.sid = p.series_id),
sets AS (SELECT series_id, n, bx, by_, count(*) AS o, grouping(bx) AS gx, grouping(by_) AS gy FROM placed GROUP BY GROUPING SETS ((series_id, n, bx), (series_id, n, by_), (series_id, n, bx, by_))),
h AS (SELECT series_id, n, sum(CASE WHEN gx = 0 AND gy = 1 THEN -o / n * {log}(o / n) ELSE 0 END) AS hx, sum(CASE WHEN gx = 1 AND gy = 0 THEN -o / n * {log}(o / n) ELSE 0 END) AS hy, sum(CASE WHEN gx = 0 AND gy = 0 THEN -o / n * {log}(o / n) ELSE 0 END) AS hxy FROM sets GROUP BY series_id, n),
i AS (SELECT *, greatest(0e0, hx + hy - hxy) AS mi FROM h)
SELECT series_id, CASE WHEN n < 30 THEN 'insufficient_data' ELSE 'ok' END AS status, cast(n AS bigint) AS n, {d.r('mi')} AS mutual_information, {d.r('hx')} AS entropy_x, {d.r('hy')} AS entropy_y, {d.r('hxy')} AS joint_entropy, {d.r('hxy - hy')} AS conditional_x_given_y, {d.r('hxy - hx')} AS conditional_y_given_x,
  {d.r('CASE WHEN least(hx, hy) > 0 THEN mi / least(hx, hy) ELSE 0 END')} AS nmi_min, {d.r('CASE WHEN greatest(hx, hy) > 0 THEN mi / greatest(hx, hy) ELSE 0 END')} AS nmi_max, {d.r('CASE WHEN hx + hy > 0 THEN 2 * mi / (hx + hy) ELSE 0 END')} AS nmi_arithmetic, {d.r('CASE WHEN hx * hy > 0 THEN mi / sqrt(hx * hy) ELSE 0 END')} AS nmi_geometric,
  {d.r('CASE WHEN hxy > 0 THEN mi / hxy ELSE 0 END')} AS information_quality_ratio, {d.r('hx + hy - 2 * mi')} AS variation_of_information FROM i"""


@operator
def dirichlet_posterior(d: Spark, s: str, prior: float = 1.0) -> str:
    """A row for each category (rounded value): posterior mean and variance under a symmetric prior."""
    return f"""WITH raw AS (SELECT series_id, round(value) AS category FROM {s}), c AS (SELECT series_id, category, count(*) AS o, sum(count(*)) OVER (PARTITION BY series_id) AS n, count(*) OVER (PARTITION BY series_id) AS k FROM raw GROUP BY series_id, category),
p AS (SELECT *, ({prior} + o) / ({prior} * k + n) AS mean, {prior} * k + n AS total FROM c)
SELECT series_id, cast(category AS bigint) AS category, cast(o AS bigint) AS observed, {d.r('mean')} AS mean, {d.r('mean * (1 - mean) / (total + 1)', 9)} AS variance, {d.r('total')} AS concentration FROM p"""


@operator
def dirichlet_log_evidence(d: Spark, s: str, prior: float = 1.0) -> str:
    """ln of the probability of the counts, for a prior that is a multiple of a half."""
    twice = round(2 * prior)
    lg = lambda x: d.log_gamma_half(f"cast({x} AS int)")
    return f"""WITH raw AS (SELECT series_id, round(value) AS category FROM {s}), c AS (SELECT series_id, category, count(*) AS o FROM raw GROUP BY series_id, category),
t AS (SELECT series_id, sum(o) AS n, count(*) AS k, sum({lg(f'2 * o + {twice}')}) AS up, sum({lg('2 * o + 2')}) AS down FROM c GROUP BY series_id)
SELECT series_id, cast(k AS bigint) AS categories, {d.r(f"up - {lg(f'2 * n + {twice} * k')} - k * {lg(str(twice))} + {lg(f'{twice} * k')} + {lg('2 * n + 2')} - down", 5)} AS log_evidence FROM t"""
