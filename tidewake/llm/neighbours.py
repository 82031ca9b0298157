"""Operator 7, approximate nearest neighbours: low-dimensional stable projections in a kd-tree.

Vectors are projected on ``DIM`` random directions, Gaussian (2-stable) and then made orthogonal, scaled so that a squared
projected distance is the squared distance times a chi-square variable of DIM degrees (a little narrower, as the
directions are orthogonal; with no more dimensions than DIM it is exact). A global kd-tree, split on a bounded sample of
projections, gives every vector one cell; a cell of over ``CELL`` vectors has several parts. Each part is indexed by a
kd-tree of its own, which hands out projected neighbours in order of their distance; they are verified on all dimensions
until the chi-square test holds: with the squared ratio of the next projected distance to the k-th distance found, a
vector left is nearer with a probability under ``MISS``. A query searches its own cell first, then the cells that the
same test leaves open at the distance found. Vectors are never copied, broadcast or collected; queries go to the parts.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part; equal vectors are one point with several ids; ties go to the smaller id; a query never finds its
own row; repeated ids count once for each different vector, and a query id finds the nearest of all its vectors; fewer
candidates than k give all of them; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.llm.common import cut

DIM, LEAF, MISS, K, SEED = 40, 128, 0.18, 10, 7
#: Vectors of a part; cells of the global tree and rows of the sample that splits it, for each of them.
CELL, MAX_CELLS, SAMPLE = 16_384, 4_096, 64
#: Projected neighbours verified at a time.
STEP = 32
FOUND = "id long, v array<double>, ids array<long>, scores array<double>, verified long"


def chi_square(x: float, dim: int) -> float:
    """Distribution function of chi-square: the series of the incomplete gamma function."""
    a, half = dim / 2, x / 2
    if half <= 0:
        return 0.0
    term = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    total, n = 0.0, 0
    while term > 1e-17 or half > a + n:
        total += term
        n += 1
        term *= half / (a + n)
    return min(total, 1.0)


def chi_square_bound(p: float, dim: int) -> float:
    """Where the distribution function reaches p."""
    low, high = 0.0, 20.0 * dim + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dim) < p else (low, mid)
    return high


def directions(size: int, seed: int = SEED) -> np.ndarray:
    gauss = np.random.default_rng(seed).standard_normal((size, min(DIM, size)))
    return np.linalg.qr(gauss)[0] * math.sqrt(size)


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cells:
    """The global kd-tree: halves of a sample, by the axis along which it is widest."""

    def __init__(self, sample: np.ndarray, n: int):
        self.axis, self.split, self.left, self.right, self.cell = [], [], [], [], []
        self.n = 0
        todo = [(sample, max(1, n), self._new())]
        while todo:
            own, n, node = todo.pop()
            axis = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            if n < 2 or len(own) < 2 or np.ptp(own[:, axis]) == 0:
                self.cell[node], self.n = self.n, self.n + 1
                continue
            values = np.unique(own[:, axis])
            at = min(float(np.median(own[:, axis])), float(values[-2]))
            low = own[:, axis] <= at
            if not low.any():
                at = float(values[0])
                low = own[:, axis] <= at
            self.axis[node], self.split[node], self.left[node], self.right[node] = axis, at, self._new(), self._new()
            todo += [(own[low], n // 2, self.left[node]), (own[~low], n - n // 2, self.right[node])]
        self.arrays = tuple(np.array(x) for x in (self.axis, self.split, self.left, self.right, self.cell))

    def _new(self) -> int:
        for own, empty in ((self.axis, -1), (self.split, 0.0), (self.left, 0), (self.right, 0), (self.cell, -1)):
            own.append(empty)
        return len(self.axis) - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        axis, split, left, right, cell = self.arrays
        at = np.zeros(len(points), dtype=np.int64)
        while len(rows := np.flatnonzero(cell[at] < 0)):
            own = at[rows]
            at[rows] = np.where(points[rows, axis[own]] <= split[own], left[own], right[own])
        return cell[at]

    def within(self, point: np.ndarray, limit: float) -> list[int]:
        """Cells that may hold points of at most this squared projected distance."""
        out, todo = [], [(0, 0.0, {})]
        while todo:
            node, away, sides = todo.pop()
            if (cell := self.cell[node]) >= 0:
                out.append(cell)
                continue
            axis, gap = self.axis[node], float(point[self.axis[node]]) - self.split[node]
            near, far = (self.left[node], self.right[node]) if gap <= 0 else (self.right[node], self.left[node])
            todo.append((near, away, sides))
            more = away + gap * gap - sides.get(axis, 0.0)
            if more <= limit:
                todo.append((far, more, {**sides, axis: gap * gap}))
        return out


class Index:
    """kd-tree over the projections of distinct vectors; leaves of at most LEAF points."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        points, group = np.unique(vectors[order], axis=0, return_inverse=True)
        group, flat = group.ravel(), points @ matrix
        self.left, self.low, self.high, self.span = [], [], [], []
        place = np.arange(len(points))
        todo = [(0, len(points))] if len(points) else []
        for start, end in todo:  # breadth first: the children of a node are neighbours
            own = flat[place[start:end]]
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.span.append((start, end))
            width = self.high[-1] - self.low[-1]
            if end - start <= LEAF or not width.any():
                self.left.append(-1)
                continue
            self.left.append(len(todo))
            half = (end - start) // 2
            place[start:end] = place[start:end][np.argpartition(own[:, int(width.argmax())], half)]
            todo += [(start, start + half), (start + half, end)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points, self.flat = points[place], flat[place]
        # ids of each point, ascending, in the order of the tree
        rank = np.empty(len(points), dtype=np.int64)
        rank[place] = np.arange(len(points))
        by = np.argsort(rank[group], kind="stable")
        self.ids, self.first = ids[order][by], np.searchsorted(rank[group][by], np.arange(len(points) + 1))

    def away(self, node: int, p: np.ndarray) -> list[float]:
        """Squared projected distances of the boxes of a node and the one after it."""
        gap = np.maximum(np.maximum(self.low[node : node + 2] - p, p - self.high[node : node + 2]), 0.0)
        return (gap * gap).sum(axis=1).tolist()

    def search(self, query: int, vector: np.ndarray, p: np.ndarray, bound: float, k: int = K, limit: float = math.inf) -> tuple[list[int], list[float], int]:
        """ids and distances of the k nearest found, nearest first, none beyond limit; and how many vectors were verified."""
        best_d, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
        verified = 0
        near_d, near_at = np.zeros(0), np.zeros(0, dtype=np.int64)  # projected neighbours not yet verified, in order
        fresh, lowest = [], math.inf  # those of leaves just opened, and the least distance of all
        heap = [(self.away(0, p)[0], 0)] if len(self.points) else []
        while heap or lowest < math.inf:
            until = heap[0][0] if heap else math.inf
            if lowest <= until and fresh:
                ds, ats = zip((near_d, near_at), *fresh)
                near_d, near_at, fresh = np.concatenate(ds), np.concatenate(ats), []
                order = np.argsort(near_d, kind="stable")
                near_d, near_at = near_d[order], near_at[order]
            while lowest <= until:
                if lowest > bound * limit * limit:
                    return best_i.tolist(), best_d.tolist(), verified
                n = min(STEP, int(np.searchsorted(near_d, min(until, bound * limit * limit), side="right")))
                at, near_d, near_at = near_at[:n], near_d[n:], near_at[n:]
                lowest = float(near_d[0]) if len(near_d) else math.inf
                d = np.sqrt(((self.points[at] - vector) ** 2).sum(axis=1))
                verified += n
                if (d <= limit).any():
                    at, d = at[d <= limit], d[d <= limit]
                    own = [self.ids[self.first[i] : self.first[i + 1]][: k + 1] for i in at]
                    ids = np.concatenate([best_i, *own])
                    ds = np.concatenate([best_d, np.repeat(d, [len(x) for x in own])])
                    order = np.lexsort((ids, ds))
                    order = order[ids[order] != query][:k]
                    best_d, best_i = ds[order], ids[order]
                    if len(best_d) == k:
                        limit = min(limit, float(best_d[-1]))
                if lowest == math.inf:
                    break
            if not heap or until > bound * limit * limit:
                break
            _, node = heapq.heappop(heap)
            if (left := self.left[node]) >= 0:
                for child, d in enumerate(self.away(left, p)):
                    heapq.heappush(heap, (d, left + child))
                continue
            start, end = self.span[node]
            d = ((self.flat[start:end] - p) ** 2).sum(axis=1)
            fresh.append((d, np.arange(start, end)))
            lowest = min(lowest, float(d.min()))
        return best_i.tolist(), best_d.tolist(), verified


def search_parts(rows: DataFrame, size: int, n_parts: int, k: int, miss: float) -> DataFrame:
    """rows: cell, part, is_query, id, v, limit. A part's vectors come first and are indexed; its queries then pass by in
    batches, so that a task holds one part and one batch, whatever the number of queries."""
    matrix = directions(size)
    bound = chi_square_bound(1 - miss, min(DIM, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            cells, parts, kinds = (batch.column(c).to_numpy() for c in ("cell", "part", "is_query"))
            new = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(cells)]):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if (at := (cells[a], parts[a])) != key:
                    key, held, index = at, [], None
                ids, vectors = own.column("id").to_numpy(), vectors_of(own.column("v"))
                if not kinds[a]:
                    held.append((ids, vectors))
                    continue
                if held:
                    index, held = Index(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), matrix), []
                if index is None:
                    continue
                limits = own.column("limit").to_numpy()
                found = [index.search(q, v, p, bound, k, limit) for q, v, p, limit in zip(ids.tolist(), vectors, vectors @ matrix, limits.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("v"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.int64())],
                    names=["id", "v", "ids", "scores", "verified"],
                )

    dealt = rows.repartition(min(4 * n_parts, 8192), "cell", "part").sortWithinPartitions("cell", "part", "is_query")
    return dealt.select("cell", "part", "is_query", "id", "v", "limit").mapInArrow(run, FOUND)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(key).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def find(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", cell: int = CELL, miss: float = MISS) -> DataFrame:
    """id, v, ids, scores, verified: for every query (a condition on column id) a row for each part that it searched."""
    spark = df.sparkSession
    rows = usable(df, key, vector)
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    if common is None:
        return spark.createDataFrame([], FOUND)
    size = common["n"]
    rows = cut(rows.filter(F.size("v") == size).dropDuplicates(["id", "v"]), "vectors")
    n = rows.count()
    n_cells = min(MAX_CELLS, math.ceil(n / cell))
    # About SAMPLE rows a cell, chosen by a hash: a bounded sample that only places the splits.
    share = min(1.0, SAMPLE * n_cells / max(n, 1))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE * n_cells)
    matrix = directions(size)

    def project(batches):
        for b in batches:
            flat = vectors_of(b.column(0)) @ matrix
            yield pa.RecordBatch.from_arrays([pa.array(list(flat.astype(np.float32)), pa.list_(pa.float32()))], names=["p"])

    sample = np.array([r["p"] for r in chosen.mapInArrow(project, "p array<float>").collect()], dtype=np.float64) if n_cells > 1 else np.zeros((0, min(DIM, size)))
    cells = Cells(sample.reshape(-1, min(DIM, size)), n_cells)

    def assign(batches):
        for b in batches:
            own = pa.array(cells.of(vectors_of(b.column(1)) @ matrix), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, own], names=["id", "v", "cell"])

    placed = cut(rows.mapInArrow(assign, "id long, v array<double>, cell int"), "cells")
    # One row a cell, of which there are at most MAX_CELLS.
    counts = cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts")), "cell-parts")
    n_parts = counts.agg(F.sum("parts")).first()[0]
    parts = F.broadcast(counts)
    part = F.pmod(F.xxhash64(F.lit(SEED + 1), "id", "v"), F.col("parts")).cast("int")
    vectors = placed.join(parts, "cell").select("cell", part.alias("part"), F.lit(0).alias("is_query"), "id", "v", F.lit(0.0).alias("limit"))

    def to_parts(queries: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        return vectors.unionByName(queries.join(parts, "cell").select("cell", every, F.lit(1).alias("is_query"), "id", "v", "limit"))

    queries = placed.filter(is_query)
    at_home = cut(search_parts(to_parts(queries.withColumn("limit", F.lit(math.inf))), size, n_parts, k, miss), "found-at-home")
    bound = chi_square_bound(1 - miss, min(DIM, size))
    reached = F.min(F.when(F.size("scores") == k, F.element_at("scores", k)))  # of parts, the nearest k-th
    limits = at_home.groupBy("id", "v").agg(F.coalesce(reached, F.lit(math.inf)).alias("limit"))

    def open_cells(batches):
        for b in batches:
            v = vectors_of(b.column("v"))
            flat, limit = v @ matrix, b.column("limit").to_numpy()
            home = cells.of(flat)
            own = [[c for c in cells.within(p, bound * x * x) if c != h] for p, x, h in zip(flat, limit.tolist(), home.tolist())]
            row = np.repeat(np.arange(len(own)), [len(c) for c in own])
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row)) for c in ("id", "v", "limit")], pa.array(np.concatenate([np.zeros(0), *own]).astype(np.int32))], names=["id", "v", "limit", "cell"])

    away = limits.mapInArrow(open_cells, "id long, v array<double>, limit double, cell int")
    return at_home.unionByName(search_parts(to_parts(away), size, n_parts, k, miss))


def nearest(df: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", cell: int = CELL, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every usable row that satisfies is_query (of column id)."""
    found = find(df, is_query, k, key, vector, cell, miss)
    pairs = found.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("query_id", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
