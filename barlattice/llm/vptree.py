"""Nearest neighbours by inner product with vantage-point trees, one per shard."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, spread, tidy
from .vectors import matrix, valid

NEIGHBOURS = 20
#: Rows of a shard, and queries that are searched at once: what one task holds.
SHARD, BLOCK = 8192, 4096
#: Cells of vectors of one length, at most; a cell of more rows than a shard is several shards. The centres come from a
#: sample of four vectors for each.
CELLS = 1024
LEAF = 256
#: 1 is exact; above 1, a branch goes as soon as its bound times the factor passes the k-th distance.
FACTOR = 1.0
SLACK = 1e-9


class VantageTree:
    """A tree over points in a metric space where the nearest is the one of largest inner product.

    A point x stands at (x, sqrt(M^2 - |x|^2)), M the largest norm of the shard, and a query at (q, 0):
    their squared distance is |q|^2 + M^2 - 2 q.x, so the triangle inequality holds for any norms.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.ids, self.points, self.leaf = ids, points, leaf
        squares = np.einsum("ij,ij->i", points, points)
        self.most = float(squares.max()) if len(points) else 0.0
        self.extra = np.sqrt(np.maximum(self.most - squares, 0))
        self.squares = squares
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(ids))) if len(ids) else None

    def _between(self, i: int, rows: np.ndarray) -> np.ndarray:
        flat = self.points[rows] - self.points[i]
        return np.sqrt(np.einsum("ij,ij->i", flat, flat) + (self.extra[rows] - self.extra[i]) ** 2)

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        tried = self.random.choice(rows, min(5, len(rows)), replace=False)
        seen = self.random.choice(rows, min(64, len(rows)), replace=False)
        vantage = int(max(tried, key=lambda i: float(self._between(i, seen).var())))
        apart = self._between(vantage, rows)
        middle = float(np.median(apart))
        inside = apart < middle
        if not inside.any() or inside.all():  # ties, such as copies of one vector
            return rows
        return vantage, middle, self._grow(rows[inside]), self._grow(rows[~inside])

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float = FACTOR, least: np.ndarray | None = None):
        """(row of the query, id, inner product): the k best of each query but itself, ties to smaller ids.

        ``least`` is a score that k other points reach already: what is below it is not looked for.
        """
        self.least = np.full(len(queries), -np.inf) if least is None else least
        self.best_score = np.full((len(queries), k), -np.inf)
        self.best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.queries, self.query_ids, self.k, self.factor = queries, query_ids, k, factor
        self.base = np.einsum("ij,ij->i", queries, queries) + self.most
        if self.root is not None and len(queries):
            self._visit(self.root, np.arange(len(queries)))
        row, place = np.nonzero(np.isfinite(self.best_score))
        return row, self.best_id[row, place], self.best_score[row, place]

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        worst = np.maximum(self.best_score[rows, -1], self.least[rows])
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(self.base[rows] - 2 * np.where(np.isfinite(worst), worst, 0), 0)), np.inf)

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for a in range(0, len(node), 4 * self.leaf):
                for b in range(0, len(rows), 512):
                    self._compare(node[a : a + 4 * self.leaf], rows[b : b + 512])
            return
        vantage, middle, inside, outside = node
        away = np.sqrt(np.maximum(self.base[rows] - 2 * (self.queries[rows] @ self.points[vantage]), 0))
        near = away < middle
        self._visit(inside, rows[near])
        self._visit(outside, rows[~near])
        bound = np.abs(away - middle) * self.factor
        open_ = bound <= self._reach(rows) + SLACK
        self._visit(outside, rows[near & open_])
        self._visit(inside, rows[~near & open_])

    def _compare(self, points: np.ndarray, rows: np.ndarray) -> None:
        rough = self.queries[rows] @ self.points[points].T
        scale = 1e-12 * np.sqrt(self.base[rows] * max(self.most, 1e-300)) + 1e-300
        q, p = np.nonzero(rough >= (np.maximum(self.best_score[rows, -1], self.least[rows]) - scale)[:, None])
        other = self.ids[points[p]] != self.query_ids[rows[q]]
        q, p = q[other], p[other]
        if not len(q):
            return
        # Summed from the first component to the last, so that equal vectors score equally.
        left, right = self.queries[rows[q]], self.points[points[p]]
        score = np.zeros(len(q))
        for j in range(left.shape[1]):
            score += left[:, j] * right[:, j]
        touched = np.unique(q)
        q_all = np.concatenate([q, np.repeat(touched, self.k)])
        s_all = np.concatenate([score, self.best_score[rows[touched]].ravel()])
        i_all = np.concatenate([self.ids[points[p]], self.best_id[rows[touched]].ravel()])
        order = np.lexsort((i_all, -s_all, q_all))
        q_all, s_all, i_all = q_all[order], s_all[order], i_all[order]
        head = np.searchsorted(q_all, touched)
        take = head[:, None] + np.arange(self.k)
        self.best_score[rows[touched]] = s_all[take]
        self.best_id[rows[touched]] = i_all[take]


def apart(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the rows, each the farthest from those before."""
    chosen, away = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


class Cells:
    """The cells of the vectors of one length: each vector is in the cell of its nearest centre, in the metric of the trees."""

    def __init__(self, centres: np.ndarray, most: float):
        self.centres, self.most = centres, most
        self.squares = np.einsum("ij,ij->i", centres, centres)
        self.extra = np.sqrt(np.maximum(most - self.squares, 0))

    def _away(self, rows: np.ndarray, squares: np.ndarray, extra: np.ndarray) -> np.ndarray:
        flat = squares[:, None] + self.squares - 2 * (rows @ self.centres.T)
        return np.sqrt(np.maximum(flat, 0) + (extra[:, None] - self.extra) ** 2)

    def of_points(self, rows: np.ndarray) -> np.ndarray:
        squares = np.einsum("ij,ij->i", rows, rows)
        return self._away(rows, squares, np.sqrt(np.maximum(self.most - squares, 0)))

    def of_queries(self, rows: np.ndarray) -> np.ndarray:
        return self._away(rows, np.einsum("ij,ij->i", rows, rows), np.zeros(len(rows)))


def groups(batch: pa.RecordBatch, column: str):
    """(value, rows) for each value of a column of numbers."""
    values = batch.column(column).to_numpy()
    for value in np.unique(values):
        yield int(value), batch.filter(pa.array(values == value))


def searched(points: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score: the k best of each asked (dim, cell, part, id, v, least) within its shard.

    A task reads the points of a shard, plants its tree once, and lets the queries pass in batches.
    """
    keys = ["dim", "cell", "part"]
    both = points.select(*keys, F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("least")).unionByName(asked.select(*keys, F.lit(True).alias("asks"), "id", "v", "least"))
    n = partitions(points.sparkSession) * 2

    @tidy
    def run(batches):
        shard, held, tree = None, [], None
        for batch in batches:
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "asks")]
            change = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1 if batch.num_rows else []
            edges = [0, *change, batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:]):
                own, some = tuple(int(m[a]) for m in marks[:3]), batch.slice(a, b - a)
                if own != shard:
                    shard, held, tree = own, [], None
                if not marks[3][a]:
                    held.append((some.column("id").to_numpy(), matrix(some.column("v"))))
                    continue
                if not held:
                    continue  # an empty shard
                if tree is None:
                    tree = VantageTree(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                for i in range(0, some.num_rows, BLOCK):
                    part = some.slice(i, BLOCK)
                    ids, least = part.column("id").to_numpy(), part.column("least").fill_null(-np.inf).to_numpy()
                    row, found, score = tree.search(matrix(part.column("v")), ids, k, factor, least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    together = both.repartition(n, *keys).sortWithinPartitions(*keys, "asks")
    return together.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(candidates: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates of largest inner product for every query, its own id left out.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller vec_id; fewer
    rows where there are fewer candidates. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows with a null id, and vectors meet only vectors of
    their own length. Repeated candidates of one id may each be found; repeated queries count as one.

    Candidates are dealt into cells around sampled centres, and large cells into shards. A query first
    visits one shard of its nearest cell (of more where cells are tiny). Its k-th best there bounds the rest: it goes on only to shards
    whose cell the triangle inequality cannot rule out, and takes the bound into their trees. With
    ``factor`` 1 that is exact; above 1, cells and branches go earlier.
    """
    def sized(df):
        return valid(df, vector_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("dim"))

    points, asked = sized(candidates), sized(queries).dropDuplicates(["id"])
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    lengths = points.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.max(square).alias("most")).collect()  # one row per vector length
    cells = {}
    for row in lengths:
        count = min(CELLS, math.ceil(row.rows / shard))
        sample = points.where(F.col("dim") == row.dim).orderBy(F.xxhash64("id"), "id").limit(4 * count).select("v").collect()
        # A little room, so that no norm is above the most by a rounding.
        cells[row.dim] = Cells(apart(np.array([c.v for c in sample]), count), row.most * (1 + 1e-12))

    @tidy
    def settle(batches):
        for batch in batches:
            for dim, some in groups(batch, "dim"):
                away = cells[dim].of_points(matrix(some.column("v")))
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], names=["id", "v", "dim", "cell", "away"])

    if not lengths:
        return points.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    settled = cut(points.mapInArrow(settle, "id long, v array<double>, dim int, cell int, away double"))
    held = settled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"), F.min("away").alias("inner"), F.max("away").alias("outer")).collect()  # one row per cell
    reach = {d: np.zeros((4, len(c.centres))) for d, c in cells.items()}
    for row in held:
        reach[row.dim][:, row.cell] = max(1, math.ceil(row.rows / shard)), row.inner, row.outer, row.rows
    parts = F.create_map(*[x for r in held for x in (F.lit(r.dim * CELLS + r.cell), F.lit(max(1, math.ceil(r.rows / shard))))])
    dealt = settled.withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("dim") * CELLS + F.col("cell")]).cast("int"))

    def first_stops(dim: int, away: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, part): one shard of the nearest cell and of further ones, until they hold twice what is sought."""
        shards, _, _, rows = reach[dim]
        order = np.argsort(np.where(shards > 0, away, np.inf), axis=1, kind="stable")
        size = (rows / np.maximum(shards, 1))[order]
        i, place = np.nonzero((np.cumsum(size, axis=1) - size < 2 * (k + 1)) & (size > 0))
        c = order[i, place]
        return i, c, (ids.view(np.uint64)[i] % shards[c].astype(np.uint64)).astype(np.int64)

    def route(home: bool):
        """Each query with its first shards, or with all others that may hold better than ``least``."""

        @tidy
        def run(batches):
            for batch in batches:
                for dim, some in groups(batch, "dim"):
                    if dim not in cells:
                        continue
                    rows, ids = matrix(some.column("v")), some.column("id").to_numpy()
                    away, (shards, inner, outer, _) = cells[dim].of_queries(rows), reach[dim]
                    i, c, p = first_stops(dim, away, ids)
                    least = np.full(len(ids), -np.inf)
                    if not home:
                        wide = int(shards.max())
                        seen = (i * CELLS + c) * wide + p
                        least = some.column("least").fill_null(-np.inf).to_numpy()
                        flat = np.einsum("ij,ij->i", rows, rows) + cells[dim].most - 2 * np.where(np.isfinite(least), least, 0)
                        bound = np.where(np.isfinite(least), np.sqrt(np.maximum(flat, 0)), np.inf)
                        gap = np.maximum(np.maximum(away - outer, inner - away), 0)
                        i, c = np.nonzero((gap * factor <= bound[:, None] + SLACK * (1 + bound[:, None])) & (shards > 0))
                        times = shards[c].astype(np.int64)
                        p = spread(np.zeros(len(times), np.int64), times)
                        i, c = np.repeat(i, times), np.repeat(c, times)
                        rest = ~np.isin((i * CELLS + c) * wide + p, seen)
                        i, c, p = i[rest], c[rest], p[rest]
                    for a in range(0, len(i), 1 << 14):
                        w = i[a : a + (1 << 14)]
                        taken = some.select(["id", "v", "dim"]).take(pa.array(w))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(c[a : a + (1 << 14)].astype(np.int32)), pa.array(p[a : a + (1 << 14)].astype(np.int32)), pa.array(least[w])], names=["id", "v", "dim", "cell", "part", "least"])

        return run

    routed = "id long, v array<double>, dim int, cell int, part int, least double"
    near = cut(searched(dealt, asked.mapInArrow(route(True), routed), k, factor))
    kth = near.groupBy(F.col("query_id").alias("__q")).agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("least"))
    bounded = asked.join(kth, F.col("id") == F.col("__q"), "left").select("id", "v", "dim", "least")
    far = searched(dealt, bounded.mapInArrow(route(False), routed), k, factor)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
