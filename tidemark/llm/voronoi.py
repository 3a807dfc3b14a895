"""Exact top-k by a Voronoi join: pivots group queries and data, bounds from summaries decide what is replicated.

Every query belongs to the cell of its nearest pivot.  A cell's summary is the largest distance r of its queries to
the pivot p.  For a vector x and any query of the cell, p.x - r|x| <= q.x <= p.x + r|x|.  The (k+1)-th largest lower
bound over a bounded set of witnesses is a score that every query of the cell is sure to reach; a vector is copied to
the cell only if its upper bound reaches that score.  Cells are solved in tiles of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vectors as V
from tidemark.llm.common import bounded_sample
from tidemark.session import materialize

DATA_ROWS, QUERY_ROWS = 4096, 1024


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """n points, each the farthest from those before it."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row, and its distance to the pivot."""
    far = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
    cell = far.argmin(axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def search(
    df: DataFrame, queries: Column, *, scale: int = 64, k: int = 20, pivots: int = 32, witnesses: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Columns query_id, rank, vec_id, score (long): the k largest products of the vectors floor(scale * x), exactly.

    ``queries`` is a condition on ``vec_id``.  Rows as ``vectors.usable`` says take part, zero vectors too; equal rows
    count once; ties go to the smaller id.  Components are 64-bit integers; beyond 2**53 in a score the products are
    taken in integers instead of doubles.
    """
    rows = V.usable(df, id_col, vector_col, zeros=True)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")))
    unique = V.distinct(rows, k)
    mine = materialize(V.query_rows(rows, unique, queries), "queries")
    size = unique.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("peak"), F.max(F.size("vector")).alias("d")).first()
    if not size["n"]:
        return V.answers(df.sparkSession.createDataFrame([], "q bigint, g bigint, least bigint, score bigint"), mine, unique, k)
    exact = size["peak"] ** 2 * size["d"] < 2**53
    packed = next(t for t, top in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1), ("i8", 2**63)) if size["peak"] <= top)
    sample = V.matrix(bounded_sample(unique.select("g", "vector"), F.col("g"), witnesses, size["n"]).orderBy("g").toArrow().column("vector"))
    sample = sample if len(sample) else np.zeros((1, size["d"]))
    centres = spread(sample, pivots)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest(V.matrix(batch.column("vector")), centres)
                yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("vector"), pa.array(cell), pa.array(far)], ["g", "vector", "cell", "far"])

    asked = unique.join(mine.select("g").distinct(), "g").select("g", "vector")
    asked = materialize(asked.mapInArrow(assign, "g bigint, vector array<bigint>, cell bigint, far double"), "query-cells")
    summary = {r["cell"]: (r["r"], r["n"]) for r in asked.groupBy("cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    cells = np.array(sorted(summary), np.int64)
    radius = np.array([summary[c][0] for c in cells]) * (1 + 1e-9) + 1e-6
    at = centres[cells]
    sure = np.full(len(cells), -np.inf)
    if len(sample) > k:
        low = at @ sample.T - radius[:, None] * np.sqrt((sample**2).sum(axis=1))
        sure = np.partition(low, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]

    def reach(batches):
        """(cell, vector) pairs whose upper bound reaches the cell's sure score."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = V.matrix(batch.column("vector"))
            high = x @ at.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius
            r, c = np.nonzero(high * (1 + 1e-9 * np.sign(high)) + 1e-6 >= sure)
            raw = pa.array([v.tobytes() for v in V.matrix(batch.column("vector"), "i8").astype(packed)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[c]), *[batch.column(n).take(pa.array(r)) for n in ("g", "least")], raw.take(pa.array(r))], ["cell", "g", "least", "raw"])

    whole = unique.select("g", "vector", F.element_at("ids", 1).alias("least"))
    copies = whole.mapInArrow(reach, "cell bigint, g bigint, least bigint, raw binary")
    parts = max(1, math.ceil(size["n"] / DATA_ROWS))
    split = F.create_map(*[F.lit(v) for c in cells.tolist() for v in (c, max(1, math.ceil(summary[c][1] / QUERY_ROWS)))]) if len(cells) else None
    if split is None:
        return V.answers(df.sparkSession.createDataFrame([], "q bigint, g bigint, least bigint, score bigint"), mine, unique, k)
    turn = F.sequence(F.lit(0), split[F.col("cell")] - 1)
    copies = copies.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts))).withColumn("turn", F.explode(turn))
    asked = asked.select("cell", "g", "vector", F.pmod(F.xxhash64("g"), split[F.col("cell")]).cast("int").alias("turn"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return V.best_of_tile(lambda n: np.zeros((len(n), 0), np.int64), left.slice(0, 0), right.slice(0, 0), k + 1, pa.int64())
        kind = "f8" if exact else "i8"
        x = V.matrix(left.column("vector"), "i8").astype(kind)
        y = np.frombuffer(b"".join(right.column("raw").to_pylist()), packed).reshape(len(right), -1).astype(kind)
        return V.best_of_tile(lambda n: (x[n] @ y.T).astype(np.int64), left, right, k + 1, pa.int64())

    keys = ("cell", "part", "turn")
    best = asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(solve, "q bigint, g bigint, least bigint, score bigint")
    return V.answers(best, mine, unique, k)
