"""Graphs of a series: visibility graphs and similarity bands, with the metrics that are joins and aggregates."""

from __future__ import annotations

from driftwood.plans.dialect import Spark, operator


def _visible(d: Spark, s: str, horizontal: bool) -> str:
    """edges (series_id, src, dst), src < dst: what stands between is a running maximum over the row's own pairs."""
    tall = "max(b.value)" if horizontal else "max((b.value - a.value) / (b.pos - a.pos))"
    sees = "between_ IS NULL OR between_ < least(vi, vj)" if horizontal else "between_ IS NULL OR between_ < (vj - vi) / (dst - src)"
    return f"""nodes AS (SELECT series_id, pos AS id FROM {s}), pairs AS (SELECT a.series_id, a.pos AS src, b.pos AS dst, a.value AS vi, b.value AS vj,
  {tall} OVER (PARTITION BY a.series_id, a.pos ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS between_ FROM {s} a JOIN {s} b ON a.series_id = b.series_id AND a.pos < b.pos),
edges AS (SELECT series_id, src, dst FROM pairs WHERE {sees})"""


def _band(d: Spark, s: str, spread: str, over: str | None = None) -> str:
    """edges: neighbours in time, and places 2 to 9 apart whose values differ by less than half the spread (over another input)."""
    return f"""nodes AS (SELECT series_id, pos AS id FROM {s}), lim AS (SELECT series_id AS sid, 0.5e0 * {spread} AS lim FROM {over or s} GROUP BY series_id), reach AS (SELECT series_id, pos, value, {d.seq('1', '9')} AS step FROM {s}),
edges AS (SELECT a.series_id, a.pos AS src, b.pos AS dst FROM reach a JOIN lim ON sid = a.series_id JOIN {s} b ON b.series_id = a.series_id AND b.pos = a.pos + step WHERE step = 1 OR abs(a.value - b.value) < lim)"""


def _mean_band(d: Spark, s: str) -> str:
    """Differences may equal the limit, so the mean is of a sum in order of position, as DuckDB sums; Spark alone would sum in any."""
    if d.name != "spark":
        return _band(d, s, "avg(abs(value))")
    summed = f"(SELECT series_id, pos, value, sum(abs(value)) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM {s})"
    return _band(d, s, "(max_by(total, pos) / nullif(count(value), 0))", summed)


def graph(d: Spark, s: str, kind: str) -> str:
    """nodes and edges of a graph: natural, horizontal, mean (band by mean |value|) or deviation (band by standard deviation)."""
    return {"natural": lambda: _visible(d, s, False), "horizontal": lambda: _visible(d, s, True), "mean": lambda: _mean_band(d, s), "deviation": lambda: _band(d, s, "stddev_pop(value)")}[kind]()


_DEGREES = """ends AS (SELECT series_id, src AS id, dst AS other FROM edges UNION ALL SELECT series_id, dst, src FROM edges),
degrees AS (SELECT n.series_id, n.id, count(e.other) AS deg FROM nodes n LEFT JOIN ends e ON e.series_id = n.series_id AND e.id = n.id GROUP BY n.series_id, n.id)"""
#: Triangles with i < j < k, once each.
_TRIANGLES = "tri AS (SELECT a.series_id, a.src AS i, a.dst AS j, b.dst AS k FROM edges a JOIN edges b ON b.series_id = a.series_id AND b.src = a.dst JOIN edges c ON c.series_id = a.series_id AND c.src = a.src AND c.dst = b.dst)"


@operator
def graph_edges(d: Spark, s: str, kind: str = "natural") -> str:
    return f"WITH {graph(d, s, kind)} SELECT series_id, src, dst FROM edges"


@operator
def degree_distribution(d: Spark, s: str, kind: str = "natural") -> str:
    return f"WITH {graph(d, s, kind)}, {_DEGREES} SELECT series_id, cast(deg AS int) AS degree, cast(count(*) AS bigint) AS nodes FROM degrees GROUP BY series_id, deg"


@operator
def graph_metrics(d: Spark, s: str, kind: str = "natural") -> str:
    """Size, degrees, density and transitivity (closed triples counted at each centre, times three; _std is a third of it)."""
    return f"""WITH {graph(d, s, kind)}, {_DEGREES}, {_TRIANGLES}, g AS (SELECT series_id, count(*) AS n, sum(deg) / 2 AS e, avg(deg) AS mean, stddev_pop(deg) AS sd, min(deg) AS lo, max(deg) AS hi, sum(deg * (deg - 1) / 2) AS triples FROM degrees GROUP BY series_id),
t AS (SELECT series_id AS sid, count(*) AS t FROM tri GROUP BY series_id), j AS (SELECT g.*, CASE WHEN triples > 0 THEN 9 * coalesce(t, 0) / triples ELSE 0 END AS tr FROM g LEFT JOIN t ON sid = series_id)
SELECT series_id, cast(n AS bigint) AS nodes, cast(e AS bigint) AS edges, {d.r('mean')} AS average_degree, {d.r('sd')} AS degree_std, cast(lo AS int) AS min_degree, cast(hi AS int) AS max_degree, {d.r('CASE WHEN n > 1 THEN 2 * e / (n * (n - 1)) ELSE 0 END')} AS density, {d.r('tr')} AS transitivity, {d.r('tr / 3')} AS transitivity_std FROM j"""


@operator
def centrality_degree(d: Spark, s: str, kind: str = "mean") -> str:
    return f"""WITH {graph(d, s, kind)}, {_DEGREES}, c AS (SELECT series_id, id, CASE WHEN count(*) OVER (PARTITION BY series_id) > 1 THEN deg / (count(*) OVER (PARTITION BY series_id) - 1e0) ELSE 0e0 END AS c FROM degrees),
m AS (SELECT *, max(c) OVER (PARTITION BY series_id) AS most FROM c)
SELECT series_id, cast(count(*) AS bigint) AS nodes, {d.r('avg(c)')} AS average, {d.r('var_pop(c)')} AS variance, {d.r('CASE WHEN count(*) > 2 THEN sum(most - c) / (count(*) - 1) ELSE 0 END')} AS centralization FROM m GROUP BY series_id"""


@operator
def top_nodes(d: Spark, s: str, k: int = 10, kind: str = "mean") -> str:
    """The k nodes of highest degree; ties to the smaller id."""
    return f"WITH {graph(d, s, kind)}, {_DEGREES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY deg DESC, id) AS place FROM degrees) SELECT series_id, cast(place AS int) AS place, id, cast(deg AS int) AS degree FROM r WHERE place <= {k}"


@operator
def triangles(d: Spark, s: str, kind: str = "deviation") -> str:
    return f"WITH {graph(d, s, kind)}, {_TRIANGLES} SELECT series_id, cast(count(*) AS bigint) AS triangles FROM tri GROUP BY series_id"


_LOCAL = """corner AS (SELECT series_id, i AS id FROM tri UNION ALL SELECT series_id, j FROM tri UNION ALL SELECT series_id, k FROM tri), links AS (SELECT series_id, id, count(*) AS t FROM corner GROUP BY series_id, id),
local_ AS (SELECT g.series_id, g.id, deg, CASE WHEN deg < 2 THEN 0e0 ELSE coalesce(t, 0) / (deg * (deg - 1) / 2e0) END AS c FROM degrees g LEFT JOIN links l ON l.series_id = g.series_id AND l.id = g.id)"""


@operator
def clustering_distribution(d: Spark, s: str, kind: str = "deviation") -> str:
    """A row for each node: its local clustering coefficient."""
    return f"WITH {graph(d, s, kind)}, {_DEGREES}, {_TRIANGLES}, {_LOCAL} SELECT series_id, id, {d.r('c')} AS clustering FROM local_"


@operator
def clustering_coefficients(d: Spark, s: str, kind: str = "deviation") -> str:
    """Mean local coefficient over nodes with two neighbours or more, the global one (times three, and _std), and triangles."""
    return f"""WITH {graph(d, s, kind)}, {_DEGREES}, {_TRIANGLES}, {_LOCAL}, g AS (SELECT series_id, avg(CASE WHEN deg >= 2 THEN c END) AS mean, sum(deg * (deg - 1) / 2) AS triples FROM local_ GROUP BY series_id), t AS (SELECT series_id AS sid, count(*) AS t FROM tri GROUP BY series_id)
SELECT series_id, {d.r('coalesce(mean, 0)')} AS average_clustering, {d.r('CASE WHEN triples > 0 THEN 9 * coalesce(t, 0) / triples ELSE 0 END')} AS global_clustering, {d.r('CASE WHEN triples > 0 THEN 3 * coalesce(t, 0) / triples ELSE 0 END')} AS global_clustering_std, cast(coalesce(t, 0) AS bigint) AS triangles FROM g LEFT JOIN t ON sid = series_id"""


@operator
def modularity(d: Spark, s: str, block: int = 16, kind: str = "deviation") -> str:
    """Newman's Q of the division into stretches of `block` places: by community, links inside less the share expected."""
    of = lambda c: d.idiv(c, str(block))
    return f"""WITH {graph(d, s, kind)}, {_DEGREES}, m AS (SELECT series_id AS sid, count(*) AS m FROM edges GROUP BY series_id), inside AS (SELECT series_id, {of('src')} AS c, count(*) AS l FROM edges WHERE {of('src')} = {of('dst')} GROUP BY series_id, {of('src')}),
sums AS (SELECT series_id, {of('id')} AS c, sum(deg) AS dsum FROM degrees GROUP BY series_id, {of('id')})
SELECT x.series_id, cast(count(*) AS int) AS communities, {d.r('sum(coalesce(l, 0) / m - dsum / (2e0 * m) * (dsum / (2e0 * m)))')} AS modularity FROM sums x JOIN m ON sid = x.series_id LEFT JOIN inside i ON i.series_id = x.series_id AND i.c = x.c GROUP BY x.series_id"""
