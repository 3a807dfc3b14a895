"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

A tree splits at the median of a random projection, one direction per tree and level, until leaves hold about ``leaf``
vectors; medians come from a bounded sample of the vectors, and below the depth at which a sample node holds ``LEAST``
of them all its descendants of a level share one median.  Every vector is indexed, in one leaf of each tree.  A query
pops nodes of all trees from one queue, ordered by the squared distance to the planes crossed, until it has as many
leaves as a sample of the queries, compared with all vectors, needs for the recall asked for; the vectors of these
leaves are reranked by their exact inner products.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import bounded_sample
from tidemark.session import materialize

LEAST = 16
ROWS = 4096  # vectors of a leaf that one task scores at once; a larger leaf is split


@dataclass
class Forest:
    planes: np.ndarray  # trees x levels x dimensions
    cuts: list[list[np.ndarray]]  # per tree and level, one threshold per node of the sampled levels

    @property
    def depth(self) -> int:
        return self.planes.shape[1]

    def cut(self, tree: int, level: int, node: np.ndarray | int):
        known = self.cuts[tree][level]
        return known[node >> max(0, level - int(math.log2(len(known))))]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector (row) in each tree (column)."""
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t, planes in enumerate(self.planes):
            side = x @ planes.T
            for level in range(self.depth):
                out[:, t] = out[:, t] * 2 + (side[:, level] > self.cut(t, level, out[:, t]))
        return out

    def search(self, x: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first ``most`` (tree, leaf) of the shared queue for one vector."""
        side = (self.planes @ x).tolist()
        queue = [(0.0, t, 0, 0) for t in range(len(self.planes))]
        found: list[tuple[int, int]] = []
        while queue and len(found) < most:
            far, t, level, node = heapq.heappop(queue)
            if level == self.depth:
                found.append((t, node))
                continue
            gap = side[t][level] - float(self.cut(t, level, node))
            near = int(gap > 0)
            heapq.heappush(queue, (far, t, level + 1, 2 * node + near))
            heapq.heappush(queue, (far + gap * gap, t, level + 1, 2 * node + 1 - near))
        return found

    def distances(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The distance by which the queue orders each leaf of a tree, for one vector."""
        side, far = self.planes[tree] @ x, np.zeros(1)
        for level in range(self.depth):
            node = np.arange(1 << level)
            gap = side[level] - self.cut(tree, level, node)
            near = (gap > 0).astype(np.int64)
            after = np.empty(2 << level)
            after[2 * node + near], after[2 * node + 1 - near] = far, far + gap * gap
            far = after
        return far

    def opened(self, x: np.ndarray, found: np.ndarray) -> np.ndarray:
        """How many leaves the search for ``x`` opens until it meets each vector (row) of ``found``."""
        far = [self.distances(x, t) for t in range(len(self.planes))]
        least = np.min([f[n] for f, n in zip(far, self.leaves(found).T)], axis=0)
        return sum(np.searchsorted(np.sort(f), least, side="right") for f in far)


def grow(sample: np.ndarray, total: int, *, trees: int, leaf: int, seed: int) -> Forest:
    depth = max(0, math.ceil(math.log2(max(1, total) / leaf)))
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(trees, depth, sample.shape[1]))
    cuts = []
    for t in range(trees):
        side, node, levels, width = sample @ planes[t].T, np.zeros(len(sample), np.int64), [], 1
        for level in range(depth):
            own = np.zeros(width)
            for n in range(width):
                here = side[node == n, level]
                own[n] = np.median(here) if len(here) else 0.0
            levels.append(own)
            if len(sample) / (2 * width) >= LEAST:
                node, width = node * 2 + (side[:, level] > own[node]), width * 2
        cuts.append(levels)
    return Forest(planes, cuts)


def leaves_needed(forest: Forest, vectors: DataFrame, asked: DataFrame, *, k: int, recall: float, probes: int) -> int:
    """Leaves to open so that a sample of about ``probes`` of ``asked`` meets a share ``recall`` of its k best vectors.

    The k best are those of all ``vectors``: each task holds its own k best of every sampled query.
    """
    some = bounded_sample(asked.select("g", "vector"), F.col("g"), probes).orderBy("g").toArrow()
    if not len(some):
        return 0
    own, x = some.column("g").to_numpy(), V.matrix(some.column("vector"))

    def best(batches):
        score, found = np.zeros((len(x), 0)), np.zeros((len(x), 0, x.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = V.matrix(batch.column("vector"))
            s = x @ y.T
            s[own[:, None] == batch.column("g").to_numpy()[None]] = -np.inf
            at = np.argpartition(-s, min(k, len(y)) - 1, axis=1)[:, :k]
            score, found = np.hstack([score, np.take_along_axis(s, at, 1)]), np.concatenate([found, y[at]], axis=1)
            at = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, found = np.take_along_axis(score, at, 1), np.take_along_axis(found, at[:, :, None], 1)
        q, at = np.nonzero(np.isfinite(score))
        flat = found[q, at]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, at]), lists], ["q", "score", "vector"])

    def count(held: pa.Table) -> pa.Table:
        q = held.column("q")[0].as_py()
        return pa.table({"leaves": pa.array(forest.opened(x[q], V.matrix(held.column("vector"))), pa.int64())})

    top = vectors.select("g", "vector").mapInArrow(best, "q bigint, score double, vector array<double>")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    counts = np.sort([r["leaves"] for r in top.groupBy("q").applyInArrow(count, "leaves bigint").collect()])
    return int(counts[math.ceil(recall * len(counts)) - 1]) if len(counts) else 0


def search(
    df: DataFrame, queries: Column, *, k: int = 20, trees: int = 16, leaf: int = 800, visit: int = 128, recall: float = 0.95, probes: int = 256,
    sample: int = 20_000, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Columns query_id, rank, vec_id, score: about the k largest inner products of each query row with other rows.

    ``queries`` is a condition on ``vec_id``.  Rows as ``vectors.usable`` says take part (zero vectors do not); equal
    rows count once, equal vectors of different rows are found together, ties go to the smaller id.  A query
    opens ``visit`` leaves at least, and as many more as about ``probes`` of the queries need to meet a share ``recall`` of
    their k best of all vectors; ``sample`` bounds the vectors that the medians are taken from.
    """
    rows = V.usable(df, id_col, vector_col, zeros=False)
    unique = V.distinct(rows, k)
    total = unique.count()
    mine = materialize(V.query_rows(rows, unique, queries), "queries")
    if not total:
        return V.answers(df.sparkSession.createDataFrame([], "q bigint, g bigint, least bigint, score double"), mine, unique, k)
    picked = bounded_sample(unique.select("g", "vector"), F.col("g"), sample, total).orderBy("g").toArrow()
    points = V.matrix(picked.column("vector")) if len(picked) else np.zeros((1, len(unique.first()["vector"])))
    forest = grow(points, total, trees=trees, leaf=leaf, seed=seed)

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = V.matrix(batch.column("vector"))
            where = forest.leaves(x)
            again = pa.array(np.repeat(np.arange(len(x)), where.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(where.shape[1]), len(x))), pa.array(where.ravel()), *[batch.column(c).take(again) for c in ("g", "vector", "least")]],
                ["tree", "leaf", "g", "vector", "least"])

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = V.matrix(batch.column("vector"))
            for at in range(0, len(x), 256):
                found = [(at + i, t, n) for i, y in enumerate(x[at : at + 256]) for t, n in forest.search(y, most)]
                i, t, n = (np.array(c, np.int64) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n), *[batch.column(c).take(pa.array(i)) for c in ("g", "vector")]], ["tree", "leaf", "g", "vector"])

    whole = unique.select("g", "vector", F.element_at("ids", 1).alias("least"))
    asked = unique.join(mine.select("g").distinct(), "g").select("g", "vector")
    most = max(trees, visit)
    if most < trees << forest.depth:
        most = max(most, leaves_needed(forest, whole, asked, k=k, recall=recall, probes=probes))
    # a leaf is dealt in parts of a size known beforehand; its probes go to each part
    parts = max(1, math.ceil(2 * total / 2**forest.depth / ROWS))
    data = whole.mapInArrow(index, "tree bigint, leaf bigint, g bigint, vector array<double>, least bigint").withColumn("part", F.pmod("g", F.lit(parts)))
    data = data.withColumn("vector", F.col("vector").cast("array<float>")) if _single(df, vector_col) else data
    probes = asked.mapInArrow(probe, "tree bigint, leaf bigint, g bigint, vector array<double>").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = V.matrix(left.column("vector")), V.matrix(right.column("vector"))

        def product(numbers):
            return x[numbers] @ y.T

        if not len(left) or not len(right):
            return V.best_of_tile(lambda n: np.zeros((len(n), 0)), left.slice(0, 0), right.slice(0, 0), k + 1, pa.float64())
        best = V.best_of_tile(product, left, right, k + 1, pa.float64())
        # the reported value is summed in one order whatever tile the pair was met in
        a, b = _positions(left, best, "q"), _positions(right, best, "g")
        return best.set_column(3, "score", pa.array((x[a] * y[b]).sum(axis=1)))

    keys = ("tree", "leaf", "part")
    best = probes.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "q bigint, g bigint, least bigint, score double")
    return V.answers(best, mine, unique, k)


def _single(df: DataFrame, vector_col: str) -> bool:
    """Components are single precision, so shipping them as such loses nothing."""
    return df.schema[vector_col].dataType.simpleString() == "array<float>"


def _positions(tile: pa.Table, best: pa.Table, column: str) -> np.ndarray:
    g = tile.column("g").to_numpy()
    order = np.argsort(g)
    return order[np.searchsorted(g[order], best.column(column).to_numpy())]
