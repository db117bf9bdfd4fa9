"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Largest inner products become nearest points by one more coordinate that brings every vector to the
same length. Points are projected on a few Gaussian (2-stable) directions. A kd-tree over a bounded
sample of them cuts the projected space into cells, all points are dealt by cell, and each task indexes
its cell by a kd-tree of its own. A query visits cells, and within a cell leaves, in the order of their
projected distance, a growing number of cells in each round, and verifies the points in them by the true
inner product, until the chi-square test says that a point nearer than the worst one kept would, with
the given probability, have been met already: the squared ratio of projected to true distance follows a
chi-square distribution with as many degrees of freedom as directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Projected dimensions (even, for the closed form of the chi-square distribution) and points of a leaf.
DIRECTIONS, LEAF = 8, 64
#: Rows of a block of candidates and of a block of queries; a task holds one of each.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024
#: Points sampled for the cells and the most cells (a larger cell is dealt in blocks), cells that a query visits in the first round, and the growth of their number.
SAMPLE, MAX_CELLS, FIRST, GROWTH = 20_000, 2048, 2, 4
_RESULT = "query_id long, rank int, vec_id long, score double"
_PLACES = [f"p{i}" for i in range(DIRECTIONS)]


def chi_square_cdf(x: np.ndarray, degrees: int = DIRECTIONS) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, np.float64) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(degrees // 2))


def directions(dim: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, DIRECTIONS))


class KdTree:
    """Leaves of at most LEAF points, split at the median of the widest dimension, with their bounding boxes."""

    def __init__(self, points: np.ndarray):
        leaves, stack = [], [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            part = points[rows]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            order = np.argpartition(part[:, axis], len(rows) // 2)
            stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.order = np.concatenate(leaves)
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.stack([points[x].min(0) for x in leaves])
        self.high = np.stack([points[x].max(0) for x in leaves])

    def gaps(self, point: np.ndarray) -> np.ndarray:
        return box_gaps(self.low, self.high, point)


def box_gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    return (np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(1)


class Cells:
    """A kd-tree's splits of the projected space into about n cells of equal shares of a sample."""

    def __init__(self, sample: np.ndarray, n: int):
        self.axis, self.cut, self.low, self.high = [], [], [], []
        self.n = 0
        self._grow(sample, n)

    def _grow(self, points: np.ndarray, n: int) -> int:
        """The number of a node, or -1 less that of a cell."""
        spread = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(1)
        if n < 2 or not spread.max() > 0:
            self.n += 1
            return -self.n
        axis = int(np.argmax(spread))
        cut = float(np.quantile(points[:, axis], (n // 2) / n))
        below = points[:, axis] < cut
        if not below.any():
            below = points[:, axis] <= (cut := float(np.nextafter(points[:, axis].min(), np.inf)))
        node = len(self.axis)
        for x, v in ((self.axis, axis), (self.cut, cut), (self.low, 0), (self.high, 0)):
            x.append(v)
        self.low[node] = self._grow(points[below], n // 2)
        self.high[node] = self._grow(points[~below], n - n // 2)
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        if not self.axis:
            return np.zeros(len(points), np.int32)
        axis, cut, low, high = map(np.asarray, (self.axis, self.cut, self.low, self.high))
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(points[inner, axis[node]] < cut[node], low[node], high[node])
        return (-at - 1).astype(np.int32)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Projected places of vectors that one more coordinate has brought to the length of the longest."""
    lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.column_stack([vectors, lift]) @ directions(vectors.shape[1] + 1)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, longest: float, k: int, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best candidates found for each query, other than itself and not below its floor."""
    plane = directions(vectors.shape[1] + 1)
    tree = KdTree(lifted(vectors, longest))
    ids, vectors = ids[tree.order], vectors[tree.order]
    projected = queries @ plane[:-1]
    lengths = (queries**2).sum(1)
    out_q, out_v, out_s = [], [], []
    for q in range(len(queries)):
        gaps = tree.gaps(projected[q])
        walk = np.argsort(gaps, kind="stable")
        kept_ids, kept = np.empty(0, ids.dtype), np.empty(0)
        at, step = 0, 4
        while at < len(walk):
            floor = max(floors[q], kept[k - 1]) if len(kept) >= k else floors[q]
            if floor > -np.inf:
                worst = max(lengths[q] + longest**2 - 2 * floor, 1e-300)
                if chi_square_cdf(gaps[walk[at]] / worst) >= sure:
                    break
            rows = np.concatenate([np.arange(tree.starts[x], tree.starts[x + 1]) for x in walk[at : at + step]])
            rows = rows[ids[rows] != query_ids[q]]
            score = (vectors[rows] * queries[q]).sum(1)
            better = score >= floor
            rows, score = rows[better], score[better]
            kept_ids, kept = np.concatenate([kept_ids, ids[rows]]), np.concatenate([kept, score])
            best = np.lexsort((kept_ids, -kept))[:k]
            kept_ids, kept = kept_ids[best], kept[best]
            at, step = at + step, min(16, step * 2)
        out_q.append(np.full(len(kept), query_ids[q]))
        out_v.append(kept_ids)
        out_s.append(kept)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty or zero, and has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k candidates of largest inner product found.

    Candidates are all usable vectors but the query's own id; unusable vectors, vectors of another length
    than the most frequent one and null ids take no part. Scores are inner products in double precision
    of the original vectors; ties fall to the smaller id. Rows that repeat an id are candidates of their
    own, and a repeated query answers once. Fewer than k candidates give fewer ranks; an empty table
    gives an empty result. Every task holds one block of candidates and one of queries, of fixed sizes,
    and candidates only travel to queries that the stopping test doesn't keep from their cell.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where("id IS NOT NULL").where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).orderBy(F.desc("c"), "n").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], _RESULT)
    rows = rows.where(F.size("v") == sizes.n)
    longest = math.sqrt(sizes.top)
    n_cells = min(MAX_CELLS, -(-sizes.c // CANDIDATE_BLOCK))

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        return lifted(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1), longest)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), *projected(b).T], names=["h", *_PLACES])

    placed = rows.select(F.xxhash64("id", "v").alias("h"), "v").mapInArrow(places, ", ".join(["h long", *(f"{x} double" for x in _PLACES)]))
    sample = placed.orderBy("h", *_PLACES).limit(SAMPLE).toPandas()  # SAMPLE rows of a few numbers
    cells = rows.sparkSession.sparkContext.broadcast(Cells(sample[_PLACES].to_numpy(), n_cells))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = projected(b)
            yield pa.RecordBatch.from_arrays([pa.array(cells.value.of(at)), b.column("id"), b.column("v"), *at.T], names=["cell", "id", "v", *_PLACES])

    dealt = rows.select("id", "v").mapInArrow(assign, ", ".join(["cell int, id long, v array<double>", *(f"{x} double" for x in _PLACES)]))
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *(f(x).alias(f"{f.__name__}_{x}") for x in _PLACES for f in (F.min, F.max))).orderBy("cell").toPandas()  # MAX_CELLS rows
    shared = rows.sparkSession.sparkContext.broadcast((boxes.cell.to_numpy(), *(boxes[[f"{f}_{x}" for x in _PLACES]].to_numpy() for f in ("min", "max"))))
    blocks = {int(c): -(-int(n) // CANDIDATE_BLOCK) for c, n in zip(boxes.cell, boxes.n, strict=True)}
    asking = materialize(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")), "queries")

    def route(first: int, last: int):
        """(cell, id, v, floor): the cells from first to last in a query's order that its stopping test doesn't spare."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, low, high = shared.value
            for b in batches:
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
                at, lengths = v @ directions(v.shape[1] + 1)[:-1], (v**2).sum(1)
                floor = b.column("floor").to_numpy(zero_copy_only=False)
                query, cell = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
                for q in range(b.num_rows):
                    gaps = box_gaps(low, high, at[q])
                    walk = np.argsort(gaps, kind="stable")[first:last]
                    if not np.isnan(floor[q]):
                        worst = max(lengths[q] + longest**2 - 2 * floor[q], 1e-300)
                        walk = walk[chi_square_cdf(gaps[walk] / worst) < sure]
                    query.append(np.full(len(walk), q))
                    cell.append(names[walk].astype(np.int32))
                rest = b.take(pa.array(np.concatenate(query)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), rest.column("id"), rest.column("v"), rest.column("floor")], names=["cell", "id", "v", "floor"])

        return run

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        floors = queries["floor"].fillna(-np.inf).to_numpy()
        q, v, s = search_block(candidates["id"].to_numpy(), np.stack(candidates["v"]), queries["id"].to_numpy(), np.stack(queries["v"]), floors, longest, k, sure)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, first, width = None, 0, FIRST
    while first < len(boxes):
        if best is None:
            asked = asking.withColumn("floor", F.lit(None).cast("double"))
        else:
            asked = asking.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor")), "id", "left")
        routes = materialize(asked.select("id", "v", "floor").mapInArrow(route(first, first + width), "cell int, id long, v array<double>, floor double"), "routes")
        first, width = first + width, width * GROWTH
        visits = routes.groupBy("cell").count().collect()  # MAX_CELLS rows
        if not visits:  # farther cells are spared too
            break
        plan = rows.sparkSession.createDataFrame([(r.cell, blocks[r.cell], -(-r["count"] // QUERY_BLOCK)) for r in visits], "cell int, blocks int, parts int")
        asks = routes.join(F.broadcast(plan), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "v", "floor")
        held = dealt.select("cell", "id", "v", F.monotonically_increasing_id().alias("row")).join(F.broadcast(plan), "cell")
        held = held.select("cell", F.pmod("row", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v")
        found = held.groupBy("cell", "block", "part").cogroup(asks.groupBy("cell", "block", "part")).applyInPandas(run, schema)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
    if best is None:
        return rows.sparkSession.createDataFrame([], _RESULT)
    return best.select("query_id", "rank", "vec_id", "score")
