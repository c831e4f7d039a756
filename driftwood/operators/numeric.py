"""Operators that no relational form expresses: transforms, eigenvalues, searches on graphs, union-find, samplers.

Each is a plain function of one series' values (in order of position) and gives rows; `per_series` runs it as a grouped
Arrow function, so series are spread over the cluster and only one is in a task's memory at a time.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftwood.operators.windows import box_sizes


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half away from zero, as SQL rounds, and without a negative zero."""
    x = np.asarray(x, float)
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits + 0.0


def per_series(schema: str, columns: tuple[str, ...] = ("value",)) -> Callable:
    """schema: of what the function gives, without series_id. A series that it refuses (None) has no rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def wrap(f: Callable) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def apply(series: DataFrame, **config) -> DataFrame:
            def group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
                part = part.sort_values("pos")
                rows = f(*(part[c].to_numpy(np.float64) for c in columns), **config)
                rows = [] if rows is None else [rows] if isinstance(rows, dict) else rows
                out = pd.DataFrame(rows, columns=names)
                for c in out.columns[out.dtypes == "float64"]:
                    out[c] = rounded(out[c].to_numpy())
                out.insert(0, "series_id", key[0])
                return out

            # a number of its own keeps adaptive execution from joining small partitions: series are few bytes and much work
            parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return series.select("series_id", "pos", *columns).repartition(parts, "series_id").groupBy("series_id").applyInPandas(group, f"series_id string, {schema}")

        apply.rows = f
        return apply

    return wrap


# --- spectra --------------------------------------------------------------------------------------------------------


def window(name: str, n: int) -> np.ndarray:
    """Symmetric windows, from their cosine coefficients."""
    terms = {"rectangular": (1.0,), "hann": (0.5, -0.5), "hamming": (0.54, -0.46), "blackman": (0.42, -0.5, 0.08)}[name]
    at = 2 * np.pi * np.arange(n) / max(1, n - 1)
    return sum((c * np.cos(k * at) for k, c in enumerate(terms)), np.zeros(n))


def _spectrum(x: np.ndarray, name: str, pad: int) -> np.ndarray:
    return np.fft.fft(x * window(name, len(x)), len(x) * pad)


@per_series("k int, frequency double, re double, im double, magnitude double, power double, phase double")
def fft_spectrum(x: np.ndarray, rate: float = 1.0, name: str = "hann", pad: int = 1) -> Iterator[dict]:
    """A row for each frequency below half the sampling rate."""
    if len(x) < 8:
        return None
    z = _spectrum(x, name, pad)
    return [{"k": k, "frequency": k * rate / len(z), "re": z[k].real, "im": z[k].imag, "magnitude": abs(z[k]), "power": abs(z[k]) ** 2 / len(z), "phase": math.atan2(z[k].imag, z[k].real)} for k in range(len(z) // 2)]


def _last_peak(p: np.ndarray) -> int:
    """The place of the largest of bins 1 on; of equal ones the last."""
    return len(p) - 1 - int(np.argmax(p[:0:-1])) if len(p) > 1 else 0


@per_series("n long, dominant_frequency double, dominant_power double, spectral_centroid double, spectral_bandwidth double, spectral_energy double, dc_component double")
def fft_features(x: np.ndarray, rate: float = 1.0, name: str = "hann", pad: int = 1) -> dict:
    if len(x) < 8:
        return None
    z = _spectrum(x, name, pad)
    p = (np.abs(z) ** 2 / len(z))[: len(z) // 2]
    f = np.arange(len(p)) * rate / len(z)
    k, total = _last_peak(p), p.sum()
    centre = float((f * p).sum() / total) if total > 0 else 0.0
    return {"n": len(x), "dominant_frequency": f[k], "dominant_power": p[k], "spectral_centroid": centre, "spectral_bandwidth": math.sqrt(((f - centre) ** 2 * p).sum() / total) if total > 0 else 0.0, "spectral_energy": total, "dc_component": abs(z[0])}


def welch(x: np.ndarray, rate: float, length: int, overlap: int, name: str) -> np.ndarray | None:
    """Mean periodogram of hopping segments, corrected for the window's power; two-sided, not doubled, not detrended."""
    if len(x) < length:
        return None
    w = window(name, length)
    segments = np.lib.stride_tricks.sliding_window_view(x, length)[:: length - overlap]
    return (np.abs(np.fft.fft(segments * w, axis=1)) ** 2).mean(axis=0) / (length * rate) * (length / (w * w).sum())


@per_series("k int, frequency double, psd double")
def psd_welch(x: np.ndarray, rate: float = 1.0, length: int = 256, overlap: int = 128, name: str = "hann") -> list[dict] | None:
    p = welch(x, rate, length, overlap, name)
    return None if p is None else [{"k": k, "frequency": k * rate / length, "psd": p[k]} for k in range(length // 2)]


@per_series("k int, frequency double, psd double")
def periodogram(x: np.ndarray, rate: float = 1.0, name: str = "hann") -> list[dict] | None:
    if len(x) < 8:
        return None
    p = np.abs(np.fft.fft(x * window(name, len(x)))) ** 2 / (len(x) * rate)
    return [{"k": k, "frequency": k * rate / len(x), "psd": p[k]} for k in range(len(x) // 2)]


@per_series("peak_frequency double, peak_power double, total_power double, low_band double, mid_band double, high_band double")
def psd_bands(x: np.ndarray, rate: float = 1.0, length: int = 256, overlap: int = 128, name: str = "hann") -> dict | None:
    """Bands end at 0.3, 0.6 and 1 of half the sampling rate, both ends included."""
    p = welch(x, rate, length, overlap, name)
    if p is None:
        return None
    p, df = p[: length // 2], rate / length
    f, half, k = np.arange(len(p)) * df, rate / 2, _last_peak(p)
    band = lambda a, b: p[(f >= a * half) & (f <= b * half)].sum() * df
    return {"peak_frequency": f[k], "peak_power": p[k], "total_power": p.sum() * df, "low_band": band(0, 0.3), "mid_band": band(0.3, 0.6), "high_band": band(0.6, 1)}


def _coherence(x: np.ndarray, y: np.ndarray, length: int, overlap: int, name: str) -> np.ndarray | None:
    if len(x) < length:
        return None
    w = window(name, length)
    a, b = (np.fft.fft(np.lib.stride_tricks.sliding_window_view(v, length)[:: length - overlap] * w, axis=1) for v in (x, y))
    both, cross = (np.abs(a) ** 2).mean(axis=0) * (np.abs(b) ** 2).mean(axis=0), np.abs((a * b.conj()).mean(axis=0)) ** 2
    return np.where(both > 0, np.minimum(1, cross / np.where(both > 0, both, 1)), 0.0)


@per_series("k int, frequency double, coherence double", ("x", "y"))
def coherence(x: np.ndarray, y: np.ndarray, rate: float = 1.0, length: int = 256, overlap: int = 128, name: str = "hann") -> list[dict] | None:
    """A row for each frequency: squared coherence of paired values. One segment gives 1."""
    c = _coherence(x, y, length, overlap, name)
    return None if c is None else [{"k": k, "frequency": k * rate / length, "coherence": c[k]} for k in range(length // 2)]


@per_series("mean_coherence double, peak_coherence double, peak_frequency double, low_band double, mid_band double, high_band double", ("x", "y"))
def coherence_summary(x: np.ndarray, y: np.ndarray, rate: float = 1.0, length: int = 256, overlap: int = 128, name: str = "hann") -> dict | None:
    c = _coherence(x, y, length, overlap, name)
    if c is None:
        return None
    c = c[: length // 2]
    f, half, k = np.arange(len(c)) * rate / length, rate / 2, _last_peak(c)
    band = lambda a, b: float(np.mean(c[(f >= a * half) & (f <= b * half)]))
    return {"mean_coherence": c.mean(), "peak_coherence": c[k], "peak_frequency": f[k], "low_band": band(0, 0.3), "mid_band": band(0.3, 0.6), "high_band": band(0.6, 1)}


# --- matrices -------------------------------------------------------------------------------------------------------


def density(x: np.ndarray, dim: int = 2, stride: int | None = None, least: float = 1e-10) -> np.ndarray | None:
    """The density matrix of a series: correlations of its dim parts, or with a stride the mean projector on delay vectors."""
    if len(x) < (dim if stride is None else dim * stride):
        return None
    if stride is None:
        size = len(x) // dim
        parts = [x[i * size : (i + 1) * size if i < dim - 1 else len(x)] for i in range(dim)]
        parts = [(p - p.mean()) / (p.std() if p.std() > 1e-10 else 1.0) for p in parts]
        rho = np.array([[np.mean(a[: min(len(a), len(b))] * b[: min(len(a), len(b))]) for b in parts] for a in parts])
        values, vectors = np.linalg.eigh((rho + rho.T) / 2)
        rho = (vectors * np.where(values < least, 0.0, values)) @ vectors.T
    else:
        rows = np.stack([x[j * stride : len(x) - (dim * stride) + 1 + j * stride] for j in range(dim)], axis=1)
        norm = (rows * rows).sum(axis=1, keepdims=True)
        rho = np.divide(rows, np.sqrt(norm), out=np.zeros_like(rows), where=np.sqrt(norm) > 1e-10)
        rho = rho.T @ rho / len(rows)
    trace = np.trace(rho)
    return np.eye(dim) / dim if trace < 1e-10 else rho / trace


def eigenvalues(rho: np.ndarray) -> np.ndarray:
    return np.sort(np.maximum(0.0, np.linalg.eigvalsh(rho)))[::-1]


def entropy_of(values: np.ndarray, base: float = 2.0) -> float:
    kept = values[values > 1e-12]
    return float(-(kept * np.log(kept)).sum() / math.log(base)) + 0.0


@per_series("n long, purity double, participation_ratio double, effective_dimension int, eigenvalues array<double>")
def density_matrix(x: np.ndarray, dim: int = 2, stride: int | None = None) -> dict | None:
    rho = density(x, dim, stride)
    if rho is None:
        return None
    values = eigenvalues(rho)
    purity = float((values**2).sum())
    return {"n": len(x), "purity": purity, "participation_ratio": 1 / purity, "effective_dimension": int((values > 1e-10).sum()), "eigenvalues": rounded(values).tolist()}


@per_series("i int, j int, value double")
def density_matrix_entries(x: np.ndarray, dim: int = 2, stride: int | None = None) -> list[dict] | None:
    """A row for each entry of the density matrix."""
    rho = density(x, dim, stride)
    return None if rho is None else [{"i": i, "j": j, "value": rho[i, j]} for i in range(dim) for j in range(dim)]


@per_series("hermitian_error double, trace double, is_valid boolean")
def density_checks(x: np.ndarray, dim: int = 2, stride: int | None = None) -> dict | None:
    """Whether the density matrix is symmetric (mean error up to 1e-6) and of trace 1 (up to 1e-4)."""
    rho = density(x, dim, stride)
    if rho is None:
        return None
    error, trace = float(np.abs(rho - rho.T).mean()), float(np.trace(rho))
    return {"hermitian_error": error, "trace": trace, "is_valid": error <= 1e-6 and abs(trace - 1) <= 1e-4}


def _binned_entropy(x: np.ndarray, base: float) -> float:
    k, low, high = math.ceil(math.sqrt(len(x))), x.min(), x.max()
    if high - low < 1e-10:
        return 0.0
    return entropy_of(np.bincount(np.minimum(k - 1, np.floor((x - low) / ((high - low) / k)).astype(int))) / len(x), base)


@per_series("n long, von_neumann_entropy double, shannon_entropy double, max_entropy double, normalized_entropy double, purity_from_entropy double")
def von_neumann_entropy(x: np.ndarray, dim: int = 2, base: float = 2.0) -> dict | None:
    rho = density(x, dim)
    if rho is None:
        return None
    s, top = entropy_of(eigenvalues(rho), base), math.log(dim) / math.log(base)
    return {"n": len(x), "von_neumann_entropy": s, "shannon_entropy": _binned_entropy(x, base), "max_entropy": top, "normalized_entropy": s / top if top > 0 else None, "purity_from_entropy": 2**-s if base == 2 else None}


def partitions(n: int, strategy: str = "bipartition") -> list[list[int]]:
    """Cut places of divisions into contiguous parts."""
    two = [[c] for c in range(1, n)]
    if strategy == "bipartition" or strategy == "all" and n > 10:
        return two
    if strategy in ("sequential", "all"):
        return two + [[a, b] for a in range(1, n - 1) for b in range(a + 1, n)]
    return [[n * i // k for i in range(1, k)] for k in (2, 3, 4) if n >= k]


def part_entropy(x: np.ndarray, dim: int = 2) -> float:
    """The entropy of a part, of as many dimensions as it has values at most; for two in closed form."""
    if dim != 2 or len(x) < 2:
        return entropy_of(eigenvalues(density(x, min(len(x), dim))))
    m = len(x) // 2
    a, b = x[:m] - x[:m].sum() / m, x[m:] - x[m:].sum() / (len(x) - m)
    u, v = math.sqrt(a @ a / m), math.sqrt(b @ b / (len(x) - m))
    if u <= 1e-10 or v <= 1e-10:
        return entropy_of(eigenvalues(density(x, 2)))
    c = float(a @ b[:m]) / (m * u * v)
    values = [t if (t := 1 + k * c) >= 1e-10 else 0.0 for k in (1, -1)]
    return -sum(t / sum(values) * math.log2(t / sum(values)) for t in values if t / sum(values) > 1e-12) + 0.0


def divisions(x: np.ndarray, dim: int, strategy: str) -> Iterator[tuple[list[int], float, float]]:
    """Of each division its cuts, the entropy of the whole, and those of the parts together."""
    total = part_entropy(x, dim)
    for cuts in partitions(len(x), strategy):
        ends = [0, *cuts, len(x)]
        yield cuts, total, sum(part_entropy(x[a:b], dim) for a, b in itertools.pairwise(ends))


@per_series("n long, phi double, total_entropy double, integration_ratio double, complexity double, mip array<int>, is_integrated boolean, is_reducible boolean")
def integrated_information(x: np.ndarray, dim: int = 2, strategy: str = "bipartition", least: float = 1e-10) -> dict | None:
    """The least of entropy of the whole less entropies of the parts, over divisions; can be negative. The first division wins ties."""
    if len(x) < max(2, dim):
        return None
    total, best, mip = 0.0, math.inf, []
    for cuts, total, parts in divisions(x, dim, strategy):
        if total - parts < best - 1e-12:
            best, mip = total - parts, cuts
    return {"n": len(x), "phi": best, "total_entropy": total, "integration_ratio": best / total if total > 1e-10 else None, "complexity": math.sqrt(abs(best) * total), "mip": mip, "is_integrated": best > least, "is_reducible": best <= least}


@per_series("cut int, total_entropy double, parts_entropy double, effective_information double")
def effective_information(x: np.ndarray, dim: int = 2) -> list[dict] | None:
    """A row for each division in two: the entropy of the whole, that of both parts, and the difference."""
    if len(x) < max(2, dim):
        return None
    return [{"cut": cuts[0], "total_entropy": total, "parts_entropy": parts, "effective_information": total - parts} for cuts, total, parts in divisions(x, dim, "bipartition")]


@per_series("size int, entropy double, entropy_first double, entropy_rest double, mutual_information double, conditional_entropy double, is_separable boolean")
def entanglement(x: np.ndarray, sizes: tuple[int, ...] | None = None, dim: int = 2, tolerance: float = 1e-6) -> list[dict] | None:
    """For subsystems of the first `size` values (half of them, if none is given) and the rest: entropies S(A) and S(B),
    S(A) + S(B) - S(AB), S(AB) - S(B), and whether S(AB) is S(A) + S(B)."""
    sizes = sizes or (len(x) // 2,)
    if len(x) < max(2, dim) or max(sizes) >= len(x) or min(sizes) < 1:
        return None
    whole = part_entropy(x, dim)
    ends = [(k, part_entropy(x[:k], dim), part_entropy(x[k:], dim)) for k in sizes]
    return [{"size": k, "entropy": whole, "entropy_first": a, "entropy_rest": b, "mutual_information": a + b - whole, "conditional_entropy": whole - b, "is_separable": abs(whole - a - b) < tolerance} for k, a, b in ends]


# --- compression ----------------------------------------------------------------------------------------------------


def _said(x: np.ndarray) -> bytes:
    return "".join(f"{v:.6f}," for v in x).encode()


def _deflated(data: bytes) -> int:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return len(c.compress(data) + c.flush())


@per_series("n long, original_size long, compressed_size long, compression_ratio double, space_saving double, bits_per_value double, shannon_entropy double")
def kolmogorov_complexity(x: np.ndarray) -> dict | None:
    """Deflated size of the values written with six decimals; entropy in bits of what is written."""
    if len(x) < 20:
        return None
    data = _said(x)
    small = _deflated(data)
    share = np.array(list(Counter(f"{v:.6f}" for v in x).values())) / len(x)
    return {"n": len(x), "original_size": len(data), "compressed_size": small, "compression_ratio": small / len(data), "space_saving": 1 - small / len(data), "bits_per_value": 8 * small / len(x), "shannon_entropy": entropy_of(share)}


@per_series("ncd double", ("x", "y"))
def compression_distance(x: np.ndarray, y: np.ndarray) -> dict:
    a, b, both = _deflated(_said(x)), _deflated(_said(y)), _deflated(_said(x) + _said(y))
    return {"ncd": min(1.0, max(0.0, (both - min(a, b)) / max(a, b)))}


# --- detrended fluctuation of any order -----------------------------------------------------------------------------


@per_series("boxes int, hurst_exponent double, r_squared double, hurst_std double")
def dfa_polynomial(x: np.ndarray, order: int = 2) -> dict | None:
    """As windows.dfa_hurst, after removing polynomials of the given order from each box."""
    if len(x) < 100:
        return None
    y = np.cumsum(x - x.mean())
    sizes = [s for s in box_sizes(len(x)) if s > order + 1]

    def rest(parts: np.ndarray) -> np.ndarray:
        at = np.vander(np.linspace(-1, 1, parts.shape[1]), order + 1)
        q, _ = np.linalg.qr(at)
        return ((parts - parts @ q @ q.T) ** 2).sum(axis=1)

    logs = []
    for s in sizes:
        k = len(y) // s
        ssr = rest(y[: k * s].reshape(k, s))
        if len(y) % s >= s // 2:
            ssr = np.append(ssr, rest(y[None, len(y) - s :]))
        logs.append((math.log(math.sqrt(ssr.mean()) + 1e-300), math.log(math.sqrt(ssr.mean() / s) + 1e-300)))
    f, g = np.array(logs).T
    rank = np.arange(len(f))
    slope = np.polyfit(rank, f, 1)[0]
    return {"boxes": len(f), "hurst_exponent": slope, "r_squared": float(np.corrcoef(rank, f)[0, 1] ** 2), "hurst_std": np.polyfit(np.log(sizes), g, 1)[0]}


# --- embedding ------------------------------------------------------------------------------------------------------


def best_delay(x: np.ndarray, most: int = 50, bins: int = 16) -> int:
    """The delay at the first strict local minimum of average mutual information, else at its least."""
    most, low, size = min(most, len(x) // 4), x.min(), np.ptp(x)
    cell = np.floor((x - low) / size * (bins - 0.001)).astype(int) if size > 0 else np.zeros(len(x), int)
    curve = []
    for k in range(1, most + 1):
        joint = np.bincount(cell[:-k] * bins + cell[k:], minlength=bins * bins).reshape(bins, bins) / (len(x) - k)
        apart = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
        curve.append(float((joint[joint > 0] * np.log2(joint[joint > 0] / apart[joint > 0])).sum()))
    c = np.round(curve, 9)
    if len(c) < 3:
        return 1
    dips = np.flatnonzero((c[1:-1] < c[:-2]) & (c[1:-1] < c[2:]))
    return int(dips[0]) + 2 if len(dips) else int(c.argmin()) + 1


def false_neighbours(x: np.ndarray, m: int, tau: int, tolerance: float = 15.0, block: int = 512) -> float:
    """The share of nearest neighbours that part when the series goes on by tau; distances a block of rows at a time."""
    n, sd = len(x) - (m - 1) * tau - tau, x.std()
    if n < 2:
        return 1.0
    if sd < 1e-10:
        return 0.0
    points = np.stack([x[j * tau : j * tau + n] for j in range(m)], axis=1)
    wrong = total = 0
    for a in range(0, n, block):
        rows = np.arange(a, min(n, a + block))
        d = np.sqrt(np.maximum(0, ((points[rows][:, None] - points[None]) ** 2).sum(axis=2)))
        d[d <= 0] = np.inf
        d[rows - a, rows] = np.inf
        j = d.argmin(axis=1)
        near = d[rows - a, j]
        ok = np.isfinite(near) & (near >= 1e-10)
        more = np.abs(x[rows + tau] - x[j + tau])[ok]
        wrong += int(((more / near[ok] > tolerance) | (np.sqrt(near[ok] ** 2 + more**2) / sd > tolerance)).sum())
        total += int(ok.sum())
    return wrong / total if total else 1.0


@per_series("n long, tau int, dimension int, vectors long, fnn array<double>, mean_distance double, std_distance double")
def takens(x: np.ndarray, max_dim: int = 10, max_delay: int = 50, least: float = 0.01, first: int = 1000) -> dict | None:
    """Delay from mutual information; dimension where false neighbours fall under `least`, else where they are fewest;
    distances over the first 1000 vectors, as the reference results have it."""
    if len(x) < 100 + (max_dim - 1) * max_delay:
        return None
    tau, found = best_delay(x, max_delay), []
    for m in range(1, max_dim + 1):
        found.append(false_neighbours(x, m, tau))
        if m >= 2 and found[-1] < least:
            break
    m = len(found) if found[-1] < least and len(found) >= 2 else int(np.argmin(found)) + 1
    n = len(x) - (m - 1) * tau
    points = np.stack([x[j * tau : j * tau + n] for j in range(m)], axis=1)[:first]
    d = np.concatenate([np.sqrt(((points[i + 1 :] - points[i]) ** 2).sum(axis=1)) for i in range(len(points) - 1)])
    return {"n": len(x), "tau": tau, "dimension": m, "vectors": n, "fnn": np.round(found, 6).tolist(), "mean_distance": d.mean(), "std_distance": d.std()}


# --- graphs ---------------------------------------------------------------------------------------------------------


def visibility(x: np.ndarray, horizontal: bool = False) -> list[list[int]]:
    """Adjacency of the natural or horizontal visibility graph, by one running maximum for each node."""
    near: list[list[int]] = [[] for _ in x]
    for i in range(len(x) - 1):
        rest = x[i + 1 :]
        high = rest if horizontal else (rest - x[i]) / np.arange(1, len(rest) + 1)
        above = np.concatenate([[-np.inf], np.maximum.accumulate(high)[:-1]])
        for j in (np.flatnonzero(above < np.minimum(rest, x[i]) if horizontal else above < high) + i + 1).tolist():
            near[i].append(j)
            near[j].append(i)
    return near


def band(x: np.ndarray, limit: float, far: int = 10) -> list[list[int]]:
    """Adjacency of neighbours in time and of places less than `far` apart whose values differ by less than the limit."""
    near: list[list[int]] = [[] for _ in x]
    for step in range(1, far):
        for i in np.flatnonzero(np.ones(max(0, len(x) - step), bool) if step == 1 else np.abs(x[:-step] - x[step:]) < limit).tolist():
            near[i].append(i + step)
            near[i + step].append(i)
    return near


def adjacency(x: np.ndarray, kind: str) -> list[list[int]]:
    if kind in ("natural", "horizontal"):
        return visibility(x, kind == "horizontal")
    if kind == "mean":  # summed in order, as SQL sums: differences may equal the limit
        return band(x, 0.5 * (np.abs(x).cumsum()[-1] / len(x)))
    return band(x, 0.5 * x.std())


def hops(near: list[list[int]], source: int) -> np.ndarray:
    """Steps from a node to all others; -1 where there is no way."""
    out = np.full(len(near), -1)
    out[source] = 0
    queue = deque([source])
    while queue:
        i = queue.popleft()
        for j in near[i]:
            if out[j] < 0:
                out[j] = out[i] + 1
                queue.append(j)
    return out


#: Graphs up to this size are searched from all nodes at once by matrix products; larger ones node by node, in linear memory.
DENSE = 2000


def all_hops(near: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacency matrix, steps between all nodes (-1 without a way), and numbers of shortest ways; a product for each step."""
    n = len(near)
    link = np.zeros((n, n))
    for i, around in enumerate(near):
        link[i, around] = 1
    steps, ways = np.full((n, n), -1), np.eye(n)
    np.fill_diagonal(steps, 0)
    front, k = np.eye(n), 0
    while front.any():
        k += 1
        front = (front @ link) * (steps < 0)
        steps[front > 0] = k
        ways += front
    return link, steps, ways


def _paths(near: list[list[int]]) -> tuple[int, float, int]:
    """Diameter, mean distance of nodes with a way between them, components."""
    rows = all_hops(near)[1] if len(near) <= DENSE else (hops(near, i) for i in range(len(near)))
    longest = total = pairs = parts = 0
    seen = np.zeros(len(near), bool)
    for i, d in enumerate(rows):
        parts += not seen[i]
        seen |= d >= 0
        longest, total, pairs = max(longest, int(d.max())), total + int(d[d > 0].sum()), pairs + int((d > 0).sum())
    return longest, total / pairs if pairs else 0.0, parts


@per_series("nodes long, diameter int, average_path_length double, components int")
def graph_paths(x: np.ndarray, kind: str = "natural", most: int = 1000) -> dict | None:
    """The diameter is null from `most` nodes on."""
    if len(x) < 5:
        return None
    diameter, mean, parts = _paths(adjacency(x, kind))
    return {"nodes": len(x), "diameter": diameter if len(x) < most else None, "average_path_length": mean, "components": parts}


def closeness(near: list[list[int]], steps: np.ndarray | None = None) -> np.ndarray:
    """Nodes that can be reached, by the sum of steps to them."""
    rows = steps if steps is not None else all_hops(near)[1] if len(near) <= DENSE else (hops(near, i) for i in range(len(near)))
    return np.array([(d > 0).sum() / d[d > 0].sum() if (d > 0).any() else 0.0 for d in rows])


#: Up to this size betweenness takes over the search of closeness; in larger graphs a sparse search of its own is faster.
SHARED = 100

#: Counts of shortest ways above two to this power are kept as a number and a multiple of it: they outgrow doubles in long series.
LIFT = 512


def _levels(ends: np.ndarray, first: np.ndarray, size: np.ndarray, sources: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Searches from some nodes at once. For each step the (source, node) cells first met, their numbers of shortest ways by count
    and lift, and the edges to cells of the next step, as places in both."""
    n, out = len(size), []
    met, place = np.zeros(len(sources) * n, bool), np.zeros(len(sources) * n, int)
    front, ways, lift = np.arange(len(sources)) * n + sources, np.ones(len(sources)), np.zeros(len(sources), int)
    met[front] = True
    while len(front):
        node = front % n
        many = size[node]
        owner = np.repeat(np.arange(len(front)), many)
        to = ends[np.arange(len(owner)) + (first[node] - many.cumsum() + many)[owner]] + (front - node)[owner]
        new = np.flatnonzero(~met[to])
        owner, to = owner[new], to[new]
        place[to] = np.arange(len(to))
        behind = to[place[to] == np.arange(len(to))]  # each cell once
        met[behind] = True
        place[behind] = np.arange(len(behind))
        to = place[to]
        out.append((front, ways, lift, owner, to))
        got, above = ways[owner], np.zeros(len(behind), int)
        if lift.any():
            np.maximum.at(above, to, lift[owner])
            got = np.ldexp(got, LIFT * np.maximum(lift[owner] - above[to], -4))
        ways = np.bincount(to, got, len(behind))
        high = ways > 2.0**LIFT
        front, ways, lift = behind, np.where(high, ways * 2.0**-LIFT, ways), above + high
    return out


def _passed(near: list[list[int]], edges: int) -> np.ndarray:
    """Shares of shortest ways through each node, gathered from the farthest nodes inwards; so many sources at once that they have
    about that many edges, so memory is linear in the graph."""
    n, size = len(near), np.array([len(a) for a in near])
    ends, first = np.concatenate([*map(np.asarray, near), np.zeros(0)]).astype(int), size.cumsum() - size
    out, width = np.zeros(n), max(1, edges // (n + len(ends) + 1))
    for low in range(0, n, width):
        sources = np.arange(low, min(n, low + width))
        shares = np.zeros(len(sources) * n)
        later = later_lift = np.zeros(0, int)  # of the step behind: 1 and its share, by its ways
        for front, ways, lift, owner, to in reversed(_levels(ends, first, size, sources)[1:]):
            got = later[to]
            if later_lift.any():
                got = np.ldexp(got, LIFT * np.maximum(lift[owner] - later_lift[to], -4))
            share = ways * np.bincount(owner, got, len(front))
            shares[front] = share
            later, later_lift = (1 + share) / ways, lift
        out += shares.reshape(-1, n).sum(axis=0)
    return out


def betweenness(near: list[list[int]], searched: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, edges: int = 1 << 23) -> np.ndarray:
    """Shares of shortest ways through each node over ordered pairs, by (n - 1)(n - 2) / 2: twice the undirected standard, as the
    reference results are. Of a graph searched already, shares are gathered for all sources at once, else for some at a time."""
    n = len(near)
    if searched:
        link, steps, ways = searched
        share = np.zeros((n, n))  # of source and node
        for k in range(int(steps.max()), 0, -1):
            at = steps == k
            share += ways * (steps == k - 1) * (np.where(at, (1 + share) / np.where(at, ways, 1), 0) @ link)
        np.fill_diagonal(share, 0)
        out = share.sum(axis=0)
    else:
        out = _passed(near, edges)
    return out / ((n - 1) * (n - 2) / 2) if n > 2 else out


def eigenvector(near: list[list[int]], rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Power iteration to unit length."""
    n = len(near)
    x = np.full(n, 1 / math.sqrt(n))
    size = np.array([len(a) for a in near])
    ends, owner = np.concatenate([*map(np.asarray, near), np.zeros(0)]).astype(int), np.repeat(np.arange(n), size)
    for _ in range(rounds):
        y = np.bincount(owner, x[ends], n)
        size = np.linalg.norm(y)
        if size < 1e-10:
            break
        y /= size
        moved, x = np.abs(y - x).sum(), y
        if moved < tolerance:
            break
    return x


@per_series("measure string, average double, variance double, centralization double")
def centralities(x: np.ndarray, kind: str = "mean", measures: tuple[str, ...] = ("closeness", "eigenvector", "betweenness")) -> list[dict] | None:
    """A row for each of the measures closeness, betweenness and eigenvector centrality, at any number of nodes."""
    if len(x) < 5:
        return None
    near = adjacency(x, kind)
    searched = all_hops(near) if len(near) <= DENSE and "closeness" in measures else None
    shared = searched if len(near) <= SHARED else None
    of = {"closeness": lambda: closeness(near, searched and searched[1]), "eigenvector": lambda: eigenvector(near), "betweenness": lambda: betweenness(near, shared)}
    found = {k: of[k]() for k in measures}
    return [{"measure": k, "average": c.mean(), "variance": c.var(), "centralization": (c.max() - c).sum() / (len(c) - 1)} for k, c in found.items()]


def spread_labels(near: list[list[int]], rounds: int = 100) -> np.ndarray:
    """Label propagation in node order; of equally frequent labels the smallest."""
    labels = np.arange(len(near))
    for _ in range(rounds):
        changed = False
        for i, around in enumerate(near):
            if around:
                best = min(Counter(labels[around].tolist()).items(), key=lambda kv: (-kv[1], kv[0]))[0]
                changed |= best != labels[i]
                labels[i] = best
        if not changed:
            break
    return labels


def quality(near: list[list[int]], labels: np.ndarray) -> float:
    """Newman's modularity of a division."""
    degree = np.array([len(a) for a in near], float)
    m2 = degree.sum()
    inside = sum(labels[i] == labels[j] for i, a in enumerate(near) for j in a)
    return float(inside / m2 - (np.bincount(labels, degree) ** 2).sum() / m2**2) if m2 else 0.0


@per_series("communities int, largest int, modularity double")
def label_propagation(x: np.ndarray, kind: str = "deviation") -> dict | None:
    if len(x) < 5:
        return None
    near = adjacency(x, kind)
    labels = spread_labels(near)
    return {"communities": len(set(labels.tolist())), "largest": int(np.bincount(labels).max()), "modularity": quality(near, labels)}


@per_series("community int, size int")
def community_sizes(x: np.ndarray, kind: str = "deviation") -> list[dict] | None:
    """A row for each community of label propagation, named by its label."""
    if len(x) < 5:
        return None
    names, sizes = np.unique(spread_labels(adjacency(x, kind)), return_counts=True)
    return [{"community": c, "size": k} for c, k in zip(names.tolist(), sizes.tolist(), strict=True)]


def _clustering(near: list[list[int]]) -> float:
    sets = [set(a) for a in near]
    local = [sum(len(sets[j] & s) for j in s) / (len(s) * (len(s) - 1)) for s in sets if len(s) > 1]
    return float(np.mean(local)) if local else 0.0


@per_series("sigma double")
def small_world(x: np.ndarray, kind: str = "deviation", graphs: int = 10, most: int = 100, seed: int = 0) -> dict | None:
    """Clustering and path length against random graphs of as many nodes and edges (seeded); only under `most` nodes."""
    if not 5 <= len(x) < most:
        return None
    near, rng, n = adjacency(x, kind), np.random.default_rng(seed), len(x)
    pairs = np.array([(i, j) for i in range(n) for j in range(i + 1, n)])
    c, length = [], []
    for _ in range(graphs):
        other: list[list[int]] = [[] for _ in range(n)]
        for i, j in pairs[rng.choice(len(pairs), sum(map(len, near)) // 2, replace=False)].tolist():
            other[i].append(j)
            other[j].append(i)
        c.append(_clustering(other))
        length.append(_paths(other)[1])
    cr, lr, own = np.mean(c), np.mean(length), _paths(near)[1]
    return {"sigma": (_clustering(near) / cr) / (own / lr) if cr > 0 and lr > 0 and own > 0 else None}


# --- topology -------------------------------------------------------------------------------------------------------


def planar(x: np.ndarray, scaled: bool = False) -> np.ndarray:
    tau = max(1, len(x) // 10)
    points = np.stack([x[:-tau], x[tau:]], axis=1)
    if scaled:
        low, size = points.min(axis=0), np.ptp(points, axis=0)
        points = np.where(size > 1e-10, (points - low) / np.where(size > 1e-10, size, 1), points)
    return points


def merge_distances(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pair distances ascending, and those of them at which two components meet (a minimum spanning tree, grown node by node)."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    best, out, left = d[0].copy(), [], np.ones(len(d), bool)
    left[0] = False
    for _ in range(len(d) - 1):
        k = int(np.argmin(np.where(left, best, np.inf)))
        out.append(best[k])
        left[k] = False
        best = np.minimum(best, d[k])
    return np.sort(d[np.triu_indices(len(d), 1)]), np.sort(np.array(out))


def _grid_merges(points: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pair distances ascending; the merging pairs' distances and steps when each step takes its pairs in order of place; the grid."""
    i, j = np.triu_indices(len(points), 1)
    d = np.sqrt(((points[i] - points[j]) ** 2).sum(axis=1))
    pairs = np.sort(d)
    grid = np.linspace(0, 1, steps) * pairs[len(pairs) * 3 // 4]
    first = np.searchsorted(grid, d, side="left")
    root = np.arange(len(points))
    merges, at = [], []
    for k in range(steps):
        new = np.flatnonzero((first == k) & (root[i] != root[j]))
        for e in new.tolist():
            a, b = root[i[e]], root[j[e]]
            if a != b:
                root[root == b] = a
                merges.append(d[e])
                at.append(k)
    return pairs, np.array(merges), np.array(at, int), grid


@per_series("n_points long, h0_features long, h1_features long, max_persistence double, avg_persistence double, significant_features long, max_filtration double")
def persistence(x: np.ndarray, steps: int = 50, threshold: float = 0.1, dim: int = 1) -> dict | None:
    """Births and deaths on a grid of scales. Every step adds its edges anew, so a pair that closes no component counts at each
    step that holds it, born at its distance and dying at one and a half of the step; counted, never listed."""
    if len(x) < 30:
        return None
    points = planar(x)
    pairs, merges, step, grid = _grid_merges(points, steps)
    deaths = grid[step[step < steps]]
    lives = deaths[deaths > 0]
    closing = np.searchsorted(pairs, grid, side="right") - np.bincount(step[step < steps], minlength=steps)
    total, count, most, significant = lives.sum(), len(lives), lives.max(initial=0.0), int((lives > threshold).sum())
    n1 = 0
    if dim >= 1:
        n1 = int(closing.sum())
        sums = np.concatenate([[0.0], np.cumsum(pairs)])
        first = np.zeros(steps)
        np.add.at(first, step[step < steps], merges[step < steps])
        inside = np.searchsorted(pairs, grid, side="right")
        total += (closing * 1.5 * grid - (sums[inside] - first)).sum()
        count += n1
        for e, m in zip(grid, inside, strict=True):
            most = max(most, 1.5 * e - pairs[0] if m else 0.0)
            significant += int(np.searchsorted(pairs, 1.5 * e - threshold, side="left")) if m and 1.5 * e - threshold < e else int(m)
        significant -= int((1.5 * grid[step[step < steps]] - merges[step < steps] > threshold).sum())
    return {"n_points": len(points), "h0_features": len(lives), "h1_features": n1, "max_persistence": most, "avg_persistence": total / count if count else 0.0, "significant_features": significant, "max_filtration": grid[-1]}


@per_series("dimension int, birth double, death double, persistence double, is_significant boolean")
def persistence_pairs(x: np.ndarray, steps: int = 50, dim: int = 0, threshold: float = 0.1, least: float = 0.0) -> Iterator[dict] | None:
    """The features that persistence() counts, a row each: those of dimension 0 with death above 0, and with dim = 1 each pair
    at every step at which it closes no component. Only those that last longer than `least`."""
    if len(x) < 30:
        return None
    points = planar(x)
    pairs, merges, step, grid = _grid_merges(points, steps)
    rows = [(0, 0.0, g) for g in grid[step] if g > 0]
    if dim >= 1:
        for k, e in enumerate(grid):
            inside = Counter(pairs[: np.searchsorted(pairs, e, side="right")].tolist())
            inside.subtract(merges[step == k].tolist())
            rows += [(1, d, 1.5 * e) for d, many in inside.items() for _ in range(many)]
    return [{"dimension": k, "birth": a, "death": b, "persistence": b - a, "is_significant": b - a > threshold} for k, a, b in rows if b - a > least]


@per_series("vertices long, edges long, triangles long, euler_characteristic long, total_simplices long, max_dimension int, edge_density double, avg_birth_step double")
def vietoris_rips(x: np.ndarray, steps: int = 30) -> dict | None:
    """As geometry.vietoris_rips, whose SQL is its twin. An edge's step is that of its length; the triangles within a step are
    counted by a product of its links, so no triple is ever listed."""
    tau = min(5, max(1, len(x) // 10))
    if len(x) <= tau:
        return None
    points = np.stack([x[:-tau], x[tau:]], axis=1)
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    most = d.max(initial=0.0)
    first = np.full((n, n), steps + 1)
    if most > 0:
        near = d <= 0.75 * most
        first[near] = np.maximum(1, np.ceil(d[near] / (0.75 * most) * steps - 1e-9)).astype(int)
    np.fill_diagonal(first, steps + 1)
    e_at = np.bincount(first[np.triu_indices(n, 1)], minlength=steps + 2)[: steps + 1]
    t_in = [0]
    for k in range(1, steps + 1):
        link = (first <= k).astype(np.float64)
        t_in.append(round(float(((link @ link) * link).sum()) / 6))
    t_at = np.diff(t_in, prepend=0)
    held, born = np.arange(steps + 1, 0, -1), np.arange(steps + 1)  # steps that hold what comes at a step; it counts at each
    held[0] = 0
    e, t = int((e_at * held).sum()), int((t_at * held).sum())
    sums = ((e_at + t_at) * held * (steps + born)).sum() / 2
    return {"vertices": n, "edges": e, "triangles": t, "euler_characteristic": n - e + t, "total_simplices": n + e + t, "max_dimension": 2 if t else 1 if e else 0, "edge_density": min(1.0, e / (n * (n - 1) / 2)) if n > 1 else 0.0, "avg_birth_step": sums / (n + e + t)}


@per_series("step int, scale double, b0 int, b1 int, b2 int, euler int, total_features int")
def betti_curve(x: np.ndarray, scales: int = 20) -> list[dict] | None:
    """A row for each scale up to three quarters of the largest distance of the scaled points."""
    if len(x) < 30:
        return None
    points = planar(x, scaled=True)
    pairs, merges = merge_distances(points)
    out = []
    for k in range(scales):
        eps = (k + 1) / scales * 0.75 * pairs[-1]
        b0 = len(points) - int(np.searchsorted(merges, eps, side="right"))
        edges = int(np.searchsorted(pairs, eps, side="right"))
        b1 = edges - len(points) + b0 if edges >= len(points) else 0
        out.append({"step": k, "scale": eps, "b0": b0, "b1": b1, "b2": 0, "euler": b0 - b1, "total_features": b0 + b1})
    return out


@per_series("optimal_step int, optimal_scale double, b0 int, b1 int, euler int, complexity double, avg_b0 double, avg_b1 double, trivial_scales int")
def betti_summary(x: np.ndarray, scales: int = 20) -> dict | None:
    """The scale of greatest complexity (loops and twice the voids; the first of equal ones, and the first of all if there are
    none), means over the scales, and at how many there is one component without a loop."""
    curve = betti_curve.rows(x, scales)
    if curve is None:
        return None
    top = max(curve, key=lambda r: r["b1"] + 2 * r["b2"])
    return {"optimal_step": top["step"], "optimal_scale": top["scale"], "b0": top["b0"], "b1": top["b1"], "euler": top["euler"], "complexity": top["b1"] + 2 * top["b2"], "avg_b0": np.mean([r["b0"] for r in curve]), "avg_b1": np.mean([r["b1"] for r in curve]), "trivial_scales": sum(r["b0"] == 1 and r["total_features"] == 1 for r in curve)}


# --- samplers -------------------------------------------------------------------------------------------------------


@per_series("category long, mean double, low double, high double")
def dirichlet_credible(x: np.ndarray, prior: float = 1.0, samples: int = 10_000, confidence: float = 0.95, seed: int = 0) -> list[dict] | None:
    """A row for each category: posterior mean and the empirical interval of seeded draws."""
    if len(x) < 10:
        return None
    names, counts = np.unique(np.round(x), return_counts=True)
    draws = np.sort(np.random.default_rng(seed).dirichlet(prior + counts, samples), axis=0)
    a = (1 - confidence) / 2
    low, high = draws[int(a * samples)], draws[min(samples - 1, int((1 - a) * samples))]
    return [{"category": int(c), "mean": (prior + o) / (prior * len(names) + len(x)), "low": lo, "high": hi} for c, o, lo, hi in zip(names, counts, low, high, strict=True)]


def metropolis(log_density: Callable[[np.ndarray], float], dim: int, iterations: int = 10_000, burn_in: int = 1000, thin: int = 1, step: float = 0.1, independent: bool = False, seed: int = 0) -> tuple[np.ndarray, float]:
    """Samples and acceptance rate of one chain from the origin. Independent proposals have no correction, as in the reference results."""
    rng = np.random.default_rng(seed)
    at, here = np.zeros(dim), log_density(np.zeros(dim))
    jumps, chances = rng.normal(size=(iterations, dim)) * step, np.log(rng.random(iterations))
    out, accepted = [], 0
    for t in range(iterations):
        to = jumps[t] if independent else at + jumps[t]
        there = log_density(to)
        if chances[t] < there - here:
            at, here, accepted = to, there, accepted + 1
        if t >= burn_in and (t - burn_in) % thin == 0:
            out.append(at)
    return np.array(out), accepted / iterations


def effective_size(x: np.ndarray) -> float:
    c = x - x.mean()
    var = (c * c).sum()
    return len(x) / (1 + 2 * abs((c[:-1] * c[1:]).sum() / var)) if var > 0 else len(x) / 100


@per_series("mean double, std_dev double, acceptance_rate double, effective_sample_size double")
def metropolis_hastings(x: np.ndarray, iterations: int = 10_000, burn_in: int = 1000, seed: int = 0) -> dict:
    """The posterior of a normal mean with a flat prior and the series' own variance; one chain for each series."""
    mu, sd = x.mean(), math.sqrt(x.var() / len(x))
    # as metropolis() with log density -t t / 2, in plain numbers
    rng = np.random.default_rng(seed)
    jumps, chances = (2.4 * rng.normal(size=iterations)).tolist(), np.log(rng.random(iterations)).tolist()
    at, accepted, chain = 0.0, 0, []
    for jump, chance in zip(jumps, chances, strict=True):
        to = at + jump
        if chance < (at * at - to * to) / 2:
            at, accepted = to, accepted + 1
        chain.append(at)
    c = np.array(chain[burn_in:]) * sd + mu
    return {"mean": c.mean(), "std_dev": c.std(ddof=1), "acceptance_rate": accepted / iterations, "effective_sample_size": effective_size(c)}
