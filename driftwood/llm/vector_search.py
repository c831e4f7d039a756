"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Fitting: at most MAX_SAMPLE vectors (those of smallest hash) are clustered by k-means, each cluster again, until a
cluster stands for about LEAF_ROWS rows of the table: the number of leaves grows with the table as far as the sample
allows. Every inner node is a row of child centres. Vectors of unequal length are lifted by one coordinate to equal
length first, which turns the largest inner product into the smallest distance.

Index: every vector goes down the tree to a leaf. Neighbouring leaves (in the order of the tree) make blocks of about
BLOCK vectors; a leaf with more is cut into parts by a hash, so a leaf with a third of all vectors is many parts.

Search: a query goes down the tree with a priority queue of branches, nearest centre first, and gets its leaves in
that order. How many it visits is calibrated: for SAMPLE_QUERIES queries, which the tree is not fitted on, the exact
neighbours among all vectors are found, with the rank of the leaf in which each lies; visits widen until AIM of the
neighbours are met. A query travels once to each block that holds leaves of its list, and is compared with the vectors
of those leaves alone; blocks are held one at a time and queries stream past them.
Scores are exact inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftwood.llm import shared

#: Bound on the vectors that the tree is fitted on.
MAX_SAMPLE = 32768
BRANCHES = 8
#: Rows of the table that a cluster may stand for before it is divided again.
LEAF_ROWS = 64
#: Vectors that a search task holds at a time, about.
BLOCK = 2048
#: Queries that a search task compares at a time.
CHUNK = 256
SAMPLE_QUERIES = 128
#: Share of the calibration queries' neighbours that the visits must meet.
AIM = 0.93


class Tree(NamedTuple):
    centres: list[np.ndarray]  # of each inner node, a row a child
    children: list[list[int]]  # inner node k is k, leaf k is -1 - k
    leaves: int
    top: float  # square of the largest length, for lifting


def lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))[:, None]])


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = (near[:, None] == np.arange(k)).astype(x.dtype).T @ x
        count = np.bincount(near, minlength=k)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def fit(sample: np.ndarray, seed: int = 1, branches: int = BRANCHES, leaf: int = LEAF_ROWS) -> Tree:
    """The tree of a sample, its leaves numbered from left to right. Clusters that k-means can't divide (equal vectors) become leaves."""
    rng = np.random.default_rng(seed)
    top = float((sample * sample).sum(axis=1).max(initial=0.0))
    tree = Tree([], [], 0, top)
    leaves = 0

    def grow(x: np.ndarray) -> int:
        nonlocal leaves
        if len(x) > max(leaf, branches):
            centres = _k_means(x, branches, rng)
            near = _nearest(x, centres)
            if np.bincount(near, minlength=branches).max() < len(x):
                node = len(tree.centres)
                tree.centres.append(centres)
                tree.children.append([])
                tree.children[node].extend(grow(x[near == k]) for k in range(branches))
                return node
        leaves += 1
        return -leaves

    if grow(lift(sample, top)) < 0:  # one leaf
        tree.centres.append(np.zeros((1, sample.shape[1] + 1)))
        tree.children.append([-1])
    return tree._replace(leaves=leaves)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    x = lift(x, tree.top)
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        near = _nearest(x[rows], tree.centres[node])
        for k, child in enumerate(tree.children[node]):
            mine = rows[near == k]
            if child < 0:
                out[mine] = -1 - child
            elif len(mine):
                todo.append((child, mine))
    return out


class Router:
    """Best-bin-first traversal; the distances of all centres are computed for many queries at a time."""

    def __init__(self, tree: Tree):
        self.top = tree.top
        self.centres = np.concatenate(tree.centres)
        self.squares = (self.centres * self.centres).sum(axis=1)
        ends = np.cumsum([len(c) for c in tree.centres]).tolist()
        self.branches = [list(zip(range(e - len(c), e), c, strict=True)) for e, c in zip(ends, tree.children, strict=True)]

    def bins(self, queries: np.ndarray, visits: int) -> Iterator[list[int]]:
        """The first leaves of each query, by a queue of branches ordered by the distance of their centres."""
        for a in range(0, len(queries), CHUNK):
            q = queries[a : a + CHUNK]
            # the order of products doesn't depend on a query's length
            q = q * np.sqrt(self.top / np.maximum((q * q).sum(axis=1), 1e-300))[:, None]
            far = self.squares - 2 * q @ self.centres[:, :-1].T
            for one in far:
                yield self._walk(one.tolist(), visits)

    def _walk(self, far: list[float], visits: int) -> list[int]:
        queue: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        push, pop, branches = heapq.heappush, heapq.heappop, self.branches
        while queue and len(out) < visits:
            node = pop(queue)[1]
            if node < 0:
                out.append(-1 - node)
            else:
                for c, child in branches[node]:
                    push(queue, (far[c], child))
        return out


def best_bins(tree: Tree, q: np.ndarray, visits: int) -> list[int]:
    """The first leaves of one query."""
    return next(Router(tree).bins(q[None], visits))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part: not null, not zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))


def train(vectors: DataFrame, max_sample: int = MAX_SAMPLE) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree, and the ids and vectors of the calibration queries, from a bounded sample of usable vectors.

    The queries are left out of the fit where there are enough other vectors.
    """
    rows = vectors.count()
    chosen = shared.hashed_sample(vectors, "vec_id", max_sample, rows).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample)
    sample = chosen.select("vec_id", "vector").toPandas()
    x = np.array(sample["vector"].tolist(), np.float64)
    fitted = x[SAMPLE_QUERIES:] if len(x) > 2 * SAMPLE_QUERIES else x
    return fit(fitted, leaf=max(BRANCHES, LEAF_ROWS * len(x) // max(1, rows))), sample["vec_id"].to_numpy()[:SAMPLE_QUERIES], x[:SAMPLE_QUERIES]


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def index(vectors: DataFrame, tree: Tree) -> DataFrame:
    """vec_id, vector, leaf and row (a number of its own) of every vector, written."""
    sent = vectors.sparkSession.sparkContext.broadcast(tree)  # of bounded size, as its sample

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(leaf_of(sent.value, _matrix(batch.column("vector"))).astype(np.int32))], names=["vec_id", "vector", "leaf"])

    placed = vectors.mapInArrow(task, "vec_id long, vector array<double>, leaf int")
    return shared.written(placed.withColumn("row", F.monotonically_increasing_id()), "index")


def calibrate(indexed: DataFrame, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, aim: float = AIM) -> int:
    """Leaves to visit so that `aim` of the exact k nearest of the calibration queries lie in them.

    All vectors are compared with the few queries; each task passes on its k best. A query's own row is the first of its
    id and vector; it is passed over by leaving out one row of the largest score among those.
    """
    ranks = [{leaf: r for r, leaf in enumerate(bins)} for bins in Router(tree).bins(queries, tree.leaves)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            names, leaves = (batch.column(c).to_numpy() for c in ("vec_id", "leaf"))
            scores = queries @ _matrix(batch.column("vector")).T
            for i, (s, n, r) in enumerate(best):
                s, n, r = np.append(s, scores[i]), np.append(n, names), np.append(r, leaves)
                at = _top(s, n, k + 1)
                best[i] = s[at], n[at], r[at]
        for i, (s, n, r) in enumerate(best):
            yield pa.record_batch([pa.array(np.full(len(s), i, np.int32)), pa.array(s), pa.array(n), pa.array(r.astype(np.int32))], names=["q", "score", "vec_id", "leaf"])

    found = indexed.select("vec_id", "vector", "leaf").mapInArrow(task, "q int, score double, vec_id long, leaf int").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("n"), "leaf")), asc=False), 1, k + 1).alias("best"))
    met = []
    for r in found.collect():  # a row a calibration query
        own = next((j for j, x in enumerate(r.best) if -x.n == ids[r.q]), k)
        met += [ranks[r.q][x.leaf] for j, x in enumerate(r.best) if j != own]
    met.sort()
    return met[min(len(met) - 1, int(np.ceil(aim * len(met))))] + 1 if met else 1


def blocks_of(sizes: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The block of each leaf, neighbours together up to about `most` vectors, and the parts of each block."""
    block, rows = np.zeros(len(sizes), np.int64), [0]
    for leaf, n in enumerate(sizes.tolist()):
        if rows[-1] and rows[-1] + n > most:
            rows.append(0)
        rows[-1] += n
        block[leaf] = len(rows) - 1
    return block, np.maximum(1, -(-np.array(rows) // most))


def search(indexed: DataFrame, queries: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (a row of the index), its own row left out.

    Each block passes on its k best of a query in one row; these are merged over partitions sorted by query.
    """
    spark = indexed.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row a leaf
        sizes[r.leaf] = r["count"]
    block, parts = blocks_of(sizes)
    sent = spark.sparkContext.broadcast((tree, block, parts, sizes))  # numbers a leaf

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, block, parts, _ = sent.value
        for batch in batches:
            mine = block[batch.column("leaf").to_numpy()]
            part = (shared.mix64(batch.column("row").to_numpy().astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % parts[mine]
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1), pa.int32()), batch.column("leaf"))
            yield pa.record_batch([pa.array(mine), pa.array(part), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("row"), batch.column("vec_id"), leaves, batch.column("vector")], names=names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, block, parts, sizes = sent.value
        router = Router(tree)
        for batch in batches:
            origin, to, part, lists = [], [], [], []
            for i, bins in enumerate(router.bins(_matrix(batch.column("vector")), visits) if batch.num_rows else []):
                leaves = np.array(bins)
                leaves = np.sort(leaves[sizes[leaves] > 0])
                there = block[leaves]
                for b in np.unique(there).tolist():
                    for p in range(int(parts[b])):
                        origin.append(i)
                        to.append(b)
                        part.append(p)
                        lists.append(leaves[there == b])
            at = pa.array(origin, pa.int64())
            copies = [batch.column(c).take(at) for c in ("row", "vec_id", "vector")]
            yield pa.record_batch([pa.array(to, pa.int64()), pa.array(part, pa.int64()), pa.array(np.ones(len(to), np.int32)), *copies[:2], pa.array(lists, pa.list_(pa.int32())), copies[2]], names=names)

    names = ["block", "part", "side", "row", "vec_id", "leaves", "vector"]
    schema = "block long, part long, side int, row long, vec_id long, leaves array<int>, vector array<double>"
    rows = ["leaf", "row", "vec_id", "vector"]
    together = indexed.select(*rows).mapInArrow(place, schema).unionByName(queries.select(*rows).mapInArrow(route, schema))
    together = together.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "side")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pieces, held = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "part", "side")], axis=1)
            own, ids, x = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"))
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if a == b:
                    continue
                here, side = tuple(key[a][:2].tolist()), key[a][2]
                if here != group:
                    group, pieces, held = here, [], None
                if side == 0:
                    pieces.append((batch.column("leaves").slice(a, b - a).flatten().to_numpy(), own[a:b], ids[a:b], x[a:b]))
                    continue
                if held is None and pieces:
                    held, pieces = _Held(*(np.concatenate(c) for c in zip(*pieces, strict=True))), []
                for c in range(a, b if held else a, CHUNK):
                    d = min(b, c + CHUNK)
                    out += held.nearest(own[c:d], ids[c:d], x[c:d], batch.column("leaves").slice(c, d - c), k)
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)], names=["row", "query_id", "ids", "scores"])

    partial = together.mapInArrow(scan, "row long, query_id long, ids array<long>, scores array<double>").repartition(tasks, "row").sortWithinPartitions("row")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, ids, scores = None, None, np.zeros(0, np.int64), np.zeros(0)
        rows: list[tuple] = []

        def close() -> None:
            rows.extend((name, r, int(i), float(s)) for r, (i, s) in enumerate(zip(ids, scores, strict=True), 1))

        def take() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for row, q, i, s in zip(batch.column("row").to_pylist(), batch.column("query_id").to_pylist(), batch.column("ids"), batch.column("scores"), strict=True):
                if row != now:
                    if now is not None:
                        close()
                    now, name, ids, scores = row, q, np.zeros(0, np.int64), np.zeros(0)
                ids, scores = np.append(ids, i.values.to_numpy()), np.append(scores, s.values.to_numpy())
                at = _top(scores, ids, k)
                ids, scores = ids[at], scores[at]
            yield take()
        if now is not None:
            close()
            yield take()

    return partial.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


class _Held:
    """The vectors of a block, by leaf."""

    def __init__(self, leaves: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, leaves))
        self.leaves, self.rows, self.ids, self.x = leaves[order], rows[order], ids[order], x[order]
        self.names, self.starts = np.unique(self.leaves, return_index=True)
        self.ends = np.append(self.starts[1:], len(self.leaves))
        self.by_row = np.argsort(self.rows)

    def nearest(self, own: np.ndarray, names: np.ndarray, q: np.ndarray, lists: pa.ListArray, k: int) -> list[tuple]:
        """(row, id, ids, scores) of each query: the k best of the vectors in its leaves.

        Products of whole leaves tell the candidates; their scores are summed vector by vector, so that equal vectors
        have equal scores wherever they lie, and ties go to the smaller id.
        """
        scores = np.full((len(q), len(self.x)), -np.inf)
        wanted, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(wanted, kind="stable")
        wanted, owner = wanted[order], owner[order]
        cuts = np.searchsorted(wanted, self.names), np.searchsorted(wanted, self.names, side="right")
        for a, b, lo, hi in zip(self.starts, self.ends, *cuts, strict=True):
            if lo < hi:
                scores[owner[lo:hi], a:b] = q[owner[lo:hi]] @ self.x[a:b].T
        spot = np.minimum(np.searchsorted(self.rows, own, sorter=self.by_row), len(self.rows) - 1)
        mine = self.by_row[spot]
        there = self.rows[mine] == own
        scores[np.flatnonzero(there), mine[there]] = -np.inf
        most = min(k, scores.shape[1])
        least = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        out = []
        for i in range(len(q)):
            s = scores[i]
            some = np.flatnonzero((s >= least[i] - 1e-9 * abs(least[i]) - 1e-300) & (s > -np.inf) if least[i] > -np.inf else s > -np.inf)
            if len(some):
                exact = (self.x[some] * q[i]).sum(axis=1)
                at = _top(exact, self.ids[some], k)
                out.append((int(own[i]), int(names[i]), self.ids[some[at]], exact[at]))
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, aim: float = AIM) -> DataFrame:
    """The k nearest of the rows that are queries, among all other rows of the table (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components take no part; the others are compared with those
    of their own length. Ties go to the smaller vec_id. Only a query's own row is left out: other rows of its id are
    candidates, and each row of a repeated id is a query with neighbours of its own. An empty table gives no rows.
    Other columns are not read.
    """
    fine = usable(vectors)
    found = None
    for r in fine.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect():  # a row a length
        some = fine.where(F.size("vector") == r.n)
        tree, ids, sample = train(some)
        indexed = index(some, tree)
        mine = search(indexed, indexed.where(is_query), tree, calibrate(indexed, tree, ids, sample, k, aim), k)
        found = mine if found is None else found.unionByName(mine)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found


def op2_kmeans_tree(spark, sf_dir: str) -> DataFrame:
    return nearest(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
