"""Operators on small series with known values."""

import math
import time

import numpy as np
import pytest

from driftwood.functions.analyzers import ANALYZERS, Analyzer, InvalidParameter, analyze_batch
from driftwood.operators import distributions as dist, draws, geometry as geo, networks as net, numeric as num, order_statistics as order, windows as win
from driftwood.plans import catalog
from driftwood.plans.dialect import DUCK, joined
from driftwood.sources.files import from_values


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_distributions(spark):
    ramp = from_values(spark, list(range(100)))
    r = one(dist.chi_squared_test(ramp))
    assert r.bins == 8 and r.p_value > 0.9 and r.status == "ok"
    assert one(dist.series_statistics(from_values(spark, [1, 2, 3, 4]))).asDict() == {"series_id": "series", "n": 4, "mean": 2.5, "median": 2.5, "std_dev": round(math.sqrt(1.25), 6), "min": 1.0, "max": 4.0}
    assert one(dist.shannon_entropy(from_values(spark, [i % 10 for i in range(100)]), discrete=True)).entropy == pytest.approx(math.log2(10), abs=1e-6)
    post = {r.category: r.mean for r in dist.dirichlet_posterior(from_values(spark, [0] * 5 + [1] * 3 + [2] * 2)).collect()}
    assert post == pytest.approx({0: 6 / 13, 1: 4 / 13, 2: 3 / 13}, abs=1e-6)
    got = {r.r: r.n for r in spark.sql("SELECT 1 AS r, 4 AS n").collect()}
    assert got == {1: 4}
    r = one(dist.finite_field(from_values(spark, [1, 8, 15, 22, -3, 7]), p=7))
    assert (r.unique_residues, r.zero_count, r.most_common, r.most_common_count) == (3, 1, 1, 4)
    q = one(dist.quadratic_residues(from_values(spark, [1, 2, 4, 0, 7, 14, 3]), p=7))
    assert (q.residues, q.nonresidues, q.zeros) == (3, 1, 3)
    with pytest.raises(ValueError):
        dist.finite_field(ramp, p=8)


def test_mutual_information_of_itself(spark):
    x = [i % 10 for i in range(100)]
    pairs = spark.createDataFrame([("s", i, float(v), float(v)) for i, v in enumerate(x)], "series_id string, pos long, x double, y double")
    r = one(dist.mutual_information(pairs))
    assert r.mutual_information == r.entropy_x == r.entropy_y and r.nmi_max == 1.0


def test_windows(spark):
    assert [r.acf for r in win.acf(from_values(spark, [1, -1] * 50), max_lag=2).orderBy("lag").collect()] == pytest.approx([-0.99, 0.98])
    r = one(win.birkhoff_ratio(from_values(spark, [1, 2, 3, 4, 5, 6, 7, 8]), blocks=2))
    assert r.block_size == 4 and r.ergodicity_ratio == pytest.approx(np.var([2.5, 6.5], ddof=1) / (np.var(range(1, 9), ddof=1) / 4), abs=1e-6)
    assert win.box_sizes(1000)[0] == 4 and win.box_sizes(1000)[-1] == 250
    noise = np.random.default_rng(1).normal(size=2000)
    assert one(win.dfa_hurst(from_values(spark, noise.tolist()))).hurst_std == pytest.approx(0.5, abs=0.1)
    assert win.delay_embedding(from_values(spark, list(range(10))), m=3, tau=2).count() == 6


def test_order_statistics(spark):
    ramp = one(order.ks_test(from_values(spark, list(range(100)))))
    assert ramp.d_statistic < 0.02 and ramp.p_value > 0.9
    assert one(order.ks_test(from_values(spark, [5.0] * 50))).status == "validation"
    assert one(order.anderson_darling(from_values(spark, list(range(100))), distribution="uniform")).is_infinite
    r = one(order.shapiro_order_stats(from_values(spark, [5, 1, 4, 2, 3])))
    assert (r.min, r.q1, r.median, r.q3, r.max) == (1, 2, 3, 4, 5)
    z = [r.z for r in order.zscore_values(from_values(spark, [1, 3, 2, 5, 4]), modified=True).orderBy("pos").collect()]
    assert z == pytest.approx([-1.349, 0, -0.6745, 1.349, 0.6745])
    assert one(order.shapiro_wilk(from_values(spark, [1.0, 1, 1, 2, 10] * 4))).skewness > 0


def test_geometry_and_chaos(spark):
    x, chaotic = 0.1, []
    for _ in range(200):
        chaotic.append(x)
        x = 4 * x * (1 - x)
    assert one(geo.lyapunov_exponent(from_values(spark, chaotic), m=2, fit_points=5)).lyapunov_exponent > 0
    r = one(geo.vietoris_rips(from_values(spark, np.sin(np.arange(30) * 0.3).tolist())))
    assert r.euler_characteristic == r.vertices - r.edges + r.triangles and r.edge_density == 1.0


def test_graphs(spark):
    values = [1, 3, 2, 4, 1, 3, 2, 4, 1, 2]
    for kind in ("natural", "horizontal"):
        edges = {(r.src, r.dst) for r in net.graph_edges(from_values(spark, values), kind=kind).collect()}
        assert edges == {(i, j) for i, a in enumerate(num.adjacency(np.array(values, float), kind)) for j in a if i < j}
    r = one(net.graph_metrics(from_values(spark, [3.0, 1.0, 3.0]), kind="natural"))
    assert (r.edges, r.transitivity, r.transitivity_std) == (3, 9.0 / 3, 1.0)
    star = [[1, 2, 3], [0], [0], [0]]
    assert num.closeness(star).tolist() == pytest.approx([1, 0.6, 0.6, 0.6])
    assert num.betweenness(star).tolist() == pytest.approx([2, 0, 0, 0])
    assert num.eigenvector([[1, 2], [0, 2], [0, 1]]).tolist() == pytest.approx([1 / math.sqrt(3)] * 3)
    two = [[1, 2], [0, 2], [0, 1], [4, 5], [3, 5], [3, 4]]
    labels = num.spread_labels(two)
    assert len(set(labels.tolist())) == 2 and num.quality(two, labels) == pytest.approx(0.5)
    assert num._paths([[1], [0, 2], [1]]) == (2, 4 / 3, 1)


def test_spectra_and_matrices():
    t = np.arange(256)
    f = num.fft_features.rows(np.sin(2 * np.pi * 32 / 256 * t) + 0.5 * np.sin(2 * np.pi * 70 / 256 * t))
    assert f["dominant_frequency"] == 32 / 256
    assert num._coherence(t + 0.0, t + 0.0, 64, 32, "hann")[1:32] == pytest.approx(1)
    rho = num.density(np.random.default_rng(0).normal(size=101), 4)
    assert np.trace(rho) == pytest.approx(1) and (num.eigenvalues(rho) >= 0).all()
    assert num.entropy_of(np.array([0.5, 0.5])) == 1
    assert [len(num.partitions(6, s)) for s in ("bipartition", "sequential", "balanced")] == [5, 15, 3]
    phi = num.integrated_information.rows(np.sin(0.1 * np.arange(40)))
    assert phi["phi"] <= phi["total_entropy"]


def test_union_find_by_tree():
    points = np.random.default_rng(4).normal(size=(30, 2))
    pairs, merges = num.merge_distances(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    parent = list(range(30))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    met = []
    for i, j in sorted(((i, j) for i in range(30) for j in range(i)), key=lambda e: d[e]):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            met.append(d[i, j])
    assert merges.tolist() == pytest.approx(met)


def plain_persistence(x, steps):
    points = num.planar(np.array(x, float))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    n = len(points)
    grid = np.linspace(0, 1, steps) * np.sort(d[np.triu_indices(n, 1)])[n * (n - 1) // 2 * 3 // 4]
    out = []
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for eps in grid:
        for i in range(n):
            for j in range(i + 1, n):
                if d[i, j] <= eps:
                    a, b = root(i), root(j)
                    if a == b:
                        out.append((1, 1.5 * eps - d[i, j]))
                    else:
                        parent[b] = a
                        if eps > 0:
                            out.append((0, eps))
    return out


def test_persistence_counts_match_the_listing():
    x = np.random.default_rng(2).normal(size=40)
    pairs = plain_persistence(x, 10)
    got = num.persistence.rows(x, steps=10)
    assert got["h0_features"] == sum(k == 0 for k, _ in pairs) and got["h1_features"] == sum(k == 1 for k, _ in pairs)
    lives = [v for _, v in pairs]
    assert got["avg_persistence"] == pytest.approx(np.mean(lives)) and got["max_persistence"] == pytest.approx(max(lives))
    assert got["significant_features"] == sum(v > 0.1 for v in lives)


def test_sampler_is_repeatable_and_right():
    chain, rate = num.metropolis(lambda t: -((t[0] - 5) ** 2) / 8, 1, iterations=20_000, burn_in=2000, step=3.0, seed=3)
    assert 0 < rate < 1 and chain.mean() == pytest.approx(5, abs=0.3) and chain.std() == pytest.approx(2, abs=0.3)
    assert (num.metropolis(lambda t: -t[0] ** 2, 1, 100, 10, seed=1)[0] == num.metropolis(lambda t: -t[0] ** 2, 1, 100, 10, seed=1)[0]).all()


def test_analyzers_refuse_politely(spark):
    short = from_values(spark, [1.0, 2.0, 3.0], "short").unionByName(from_values(spark, [float("nan")] * 40, "nan")).unionByName(from_values(spark, list(range(60)), "fine"))
    rows = {(r.series_id, r.framework): r for r in analyze_batch(short, ["chi_squared", "zscore"]).collect()}
    assert {r.status for (s, _), r in rows.items() if s == "short"} == {"insufficient_data"}
    assert {r.status for (s, _), r in rows.items() if s == "nan"} == {"validation"}
    fine = rows["fine", "Chi-Squared Test"]
    assert fine.status == "ok" and "chi_squared" in fine.metrics and fine.interpretation.startswith("uniform") and rows["short", "Chi-Squared Test"].metrics is None
    assert len(ANALYZERS) == 34


def test_takens_embedding():
    t = np.arange(700)
    x = np.sin(2 * np.pi * t / 40) + 0.3 * np.sin(2 * np.pi * t / 13)
    r = num.takens.rows(x)
    assert r["dimension"] >= 2 and r["vectors"] == 700 - (r["dimension"] - 1) * r["tau"]
    y = np.random.default_rng(0).normal(size=80)
    for m in (1, 2, 3):
        points = np.stack([y[j * 2 : j * 2 + 80 - m * 2] for j in range(m)], axis=1)
        wrong = 0
        for i in range(len(points)):
            d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
            d[i] = np.inf
            j = int(d.argmin())
            gap = abs(y[i + 2] - y[j + 2])
            wrong += gap / d[j] > 3 or math.hypot(d[j], gap) / y.std() > 3
        assert num.false_neighbours(y, m, 2, 3.0, block=7) == pytest.approx(wrong / len(points))
    assert num.takens.rows(x[:500]) is None


def test_parts_in_closed_form_are_those_of_the_eigenvalues():
    rng = np.random.default_rng(3)
    for n in [*range(1, 12), 33, 64]:
        for x in (rng.normal(size=n), np.ones(n), np.arange(n, dtype=float), np.r_[np.zeros(n // 2), rng.normal(size=n - n // 2)]):
            want = num.entropy_of(num.eigenvalues(num.density(x, min(n, 2))))
            assert abs(num.part_entropy(x) - want) < 1e-9, (n, x)


def test_entanglement_and_divisions():
    x = np.sin(0.3 * np.arange(40))
    one = num.entanglement.rows(x, sizes=(10, 20))
    assert [r["size"] for r in one] == [10, 20]
    for r in one:
        assert abs(r["mutual_information"] - (r["entropy_first"] + r["entropy_rest"] - r["entropy"])) < 1e-12
        assert abs(r["conditional_entropy"] - (r["entropy"] - r["entropy_rest"])) < 1e-12
    each = num.effective_information.rows(x)
    phi = num.integrated_information.rows(x)
    assert len(each) == 39 and abs(phi["phi"] - min(r["effective_information"] for r in each)) < 1e-9
    assert phi["is_integrated"] != phi["is_reducible"] and num.entanglement.rows(x, sizes=(40,)) is None
    assert num.density_checks.rows(x)["is_valid"] and len(num.density_matrix_entries.rows(x, dim=3)) == 9


def test_centralities_against_plain_searches():
    rng = np.random.default_rng(4)
    for n in (5, 12, 20):
        near = num.adjacency(rng.normal(size=n), "deviation")
        steps = [num.hops(near, i) for i in range(n)]
        assert np.allclose(num.closeness(near), [(d > 0).sum() / d[d > 0].sum() for d in steps])
        assert (num.all_hops(near)[1] == np.array(steps)).all()
        ways = np.zeros((n, n))
        for s in range(n):  # shortest ways, counted from the source outwards
            ways[s, s] = 1
            for v in sorted(range(n), key=lambda v: steps[s][v]):
                ways[s, v] += sum(ways[s, u] for u in near[v] if steps[s][u] == steps[s][v] - 1)
        want = [sum(ways[s, v] * ways[v, t] / ways[s, t] for s in range(n) for t in range(n) if len({s, t, v}) == 3 and steps[s][v] + steps[v][t] == steps[s][t]) / ((n - 1) * (n - 2) / 2) for v in range(n)]
        assert np.allclose(num.betweenness(near), want)
        link = num.all_hops(near)[0]
        top = np.abs(np.linalg.eigh(link)[1][:, -1])
        assert n == 5 or np.allclose(num.eigenvector(near, rounds=5000, tolerance=1e-14), top, atol=1e-6)


def test_betti_and_persistence_derived_values():
    x = np.cos(0.2 * np.arange(70)) + np.sin(0.37 * np.arange(70))
    curve, top = num.betti_curve.rows(x), num.betti_summary.rows(x)
    best = max(r["b1"] for r in curve)
    assert top["complexity"] == best and top["optimal_step"] == next(r["step"] for r in curve if r["b1"] == best)
    assert top["trivial_scales"] == sum((r["b0"], r["b1"], r["b2"]) == (1, 0, 0) for r in curve)
    points = num.planar(x, scaled=True)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for r in curve:  # components by flooding
        left, parts = set(range(len(points))), 0
        while left:
            todo, parts = [left.pop()], parts + 1
            while todo:
                here = todo.pop()
                new = {j for j in left if d[here, j] <= r["scale"]}
                left -= new
                todo += new
        assert r["b0"] == parts
    pairs, sums = num.persistence_pairs.rows(x, dim=1), num.persistence.rows(x)
    assert sum(p["dimension"] == 0 for p in pairs) == sums["h0_features"] and sum(p["dimension"] == 1 for p in pairs) == sums["h1_features"]
    assert abs(max(p["persistence"] for p in pairs) - sums["max_persistence"]) < 1e-9 and sum(p["is_significant"] for p in pairs) == sums["significant_features"]
    assert all(p["persistence"] > 0.5 for p in num.persistence_pairs.rows(x, dim=1, least=0.5))


def test_communities_add_up():
    x = np.random.default_rng(1).normal(size=60)
    sizes, told = num.community_sizes.rows(x), num.label_propagation.rows(x)
    assert sum(r["size"] for r in sizes) == 60 and len(sizes) == told["communities"] and max(r["size"] for r in sizes) == told["largest"]


def test_error_states(spark):
    series = spark.createDataFrame([("s", i, 1.0) for i in range(200)], "series_id string, pos long, value double")
    with pytest.raises(InvalidParameter, match="bins"):
        ANALYZERS["chi_squared"].configured(no_such_bins=3)
    with pytest.raises(InvalidParameter, match="0 or more"):
        ANALYZERS["partition_balance"].configured(partitions=-1)
    refused = Analyzer("Refuser", num.graph_paths, 2).analyze(series.where("pos < 3")).first()
    assert refused.status == "analysis_failed" and refused.metrics is None


def drawn(spark, sums):
    """Draws of two numbers with the given sums, by series."""
    rows = [(s, pos, n) for s, totals in sums.items() for pos, total in enumerate(totals) for n in (total // 2, total - total // 2)]
    return spark.createDataFrame(rows, "series_id string, pos long, number int")


def test_draw_chaos_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for span, n in ((1, 40), (2, 90), (20, 500)):
        points = rng.integers(0, span, (n, 3))
        cells, counts = np.unique(points, axis=0, return_counts=True)
        far = ((points[:, None] - points) ** 2).sum(axis=2)[np.triu_indices(n, 1)]
        found = draws.grid_distances(cells, counts)
        assert found.tolist() == np.bincount(far, minlength=len(found)).tolist()
    # one series on a grid, one with means that lie close and come back late, one of uneven draws, one with a single mean, and one too short
    sums = {"grid": rng.integers(2, 30, 300).tolist(), "few": [4, 9] * 2 + [4] * 30 + [9, 10, 17] * 20, "same": [6] * 60, "short": [4, 9, 5]}
    uneven = [("uneven", pos, int(n)) for pos in range(150) for n in rng.integers(1, 51, rng.integers(1, 7))]
    series = drawn(spark, sums).union(spark.createDataFrame(uneven, "series_id string, pos long, number int"))
    want = sorted(map(tuple, draws.draw_chaos_pairs(series).collect()))
    assert {r[0] for r in want} >= {"grid", "few", "uneven"}
    assert sorted(map(tuple, draws.draw_chaos(series).collect())) == want
    monkeypatch.setattr(draws, "GRID_DRAWS", 50)
    assert sorted(map(tuple, draws.draw_chaos(series).collect())) == want


def test_draw_chaos_of_many_draws(spark):
    totals = np.random.default_rng(6).integers(2, 25, 60_000)
    started = time.monotonic()
    got = one(draws.draw_chaos(drawn(spark, {"s": totals.tolist()})))
    assert time.monotonic() - started < 120  # all pairs are 5.4 billion
    points, counts = np.unique(np.stack([totals[:-2], totals[1:-1], totals[2:]], axis=1), axis=0, return_counts=True)
    pairs = np.zeros(3 * 22**2 + 1, np.int64)
    for k, point in enumerate(points):
        pairs += np.bincount(((points - point) ** 2).sum(axis=1), counts[k] * counts, len(pairs)).astype(np.int64)
    pairs[0] -= counts.sum()
    r, pairs = np.round(np.sqrt(np.flatnonzero(pairs)) / 2, 9), pairs[pairs > 0] // 2
    median = r[np.flatnonzero(pairs.cumsum() > pairs.sum() // 2)[0]]
    nearer = [pairs[r < scale * median].sum() for scale in (0.5, 1, 2)]
    assert got.correlation_dimension == pytest.approx(np.polyfit(np.log([0.5, 1, 2]), np.log(nearer), 1)[0], abs=1e-4)


#: Values 3 and 9 differ by just half the mean; in order of position the sum makes them an edge, in reverse or by pairs it does not.
TIED = [24.41, 7.9, 23.85, 24.86, 2.93, 28.18, 13.92, 26.72, 28.37, 15.35, 7.07, 24.68]


def of_tied(name):
    """The rows of a catalog query's twin over the tied values."""
    import duckdb

    text = catalog.ENTRIES[name].text or catalog.ENTRIES[name].operator.sql(DUCK, "src")
    values = ", ".join(f"('series', {i}, {v}e0)" for i, v in enumerate(TIED))
    return duckdb.sql(joined(f"src(series_id, pos, value) AS (VALUES {values})", text)).fetchall()


def test_betweenness_sums_the_limit_in_order(spark):
    assert 9 in num.adjacency(np.array(TIED), "mean")[3]
    got = [tuple(r) for r in num.centralities(from_values(spark, TIED), measures=("betweenness",)).collect()]
    want = of_tied("centrality_betweenness")
    assert [r[:2] for r in got] == [r[:2] for r in want] and got[0][2:] == pytest.approx(want[0][2:], abs=1e-9)


def test_top_nodes_sum_the_limit_in_order(spark):
    backwards = spark.createDataFrame([("series", i, v) for i, v in reversed([*enumerate(TIED)])], "series_id string, pos long, value double").coalesce(1)
    want = sorted(of_tied("top_nodes"))
    assert sorted(map(tuple, net.top_nodes(backwards).collect())) == want
    gap = spark.createDataFrame([("s", 0, None), ("s", 1, 2.0), ("s", 2, None), ("t", 0, None)], "series_id string, pos long, value double")
    assert {tuple(r) for r in net.graph_edges(gap, kind="mean").collect()} == {("s", 0, 1), ("s", 1, 2)}


def test_betweenness_of_long_series(spark):
    import duckdb

    values = [round(30 + 20 * math.sin(1.7 * i) + i % 11, 2) for i in range(210)]
    got = [tuple(r) for r in num.centralities(from_values(spark, values), measures=("betweenness",)).collect()]
    rows = ", ".join(f"('series', {i}, {v}e0)" for i, v in enumerate(values))
    want = duckdb.sql(joined(f"src(series_id, pos, value) AS (VALUES {rows})", catalog.ENTRIES["centrality_betweenness"].text)).fetchall()
    assert [r[:2] for r in got] == [r[:2] for r in want] == [("series", "betweenness")] and got[0][2:] == pytest.approx(want[0][2:], abs=1e-9)
    near = num.adjacency(np.array(values), "mean")
    whole = num.betweenness(near, num.all_hops(near))
    assert np.allclose(num.betweenness(near), whole) and np.allclose(num.betweenness(near, edges=5000), whole)  # two nodes at a time


def test_betweenness_where_ways_outgrow_doubles():
    loops = 1100  # a chain of squares: ways double with each
    n = 3 * loops + 1
    near = [[] for _ in range(n)]
    for i in range(0, n - 1, 3):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3)):
            near[a].append(b)
            near[b].append(a)
    left = np.arange(n) // 3 * 3  # nodes before the square's first corner
    want = np.where(np.arange(n) % 3 == 0, 2.0 * left * (n - 1 - left) + 2, (left + 1.0) * (n - 3 - left))
    want[[0, -1]] = 1, 1  # end corners: only between the two sides of their square
    got = num.betweenness(near)
    assert got == pytest.approx(want / ((n - 1) * (n - 2) / 2), rel=1e-9)
