"""Exact nearest neighbours inside blocks and sliding windows, and graphs built from them.

Distances are computed as matrices inside tasks and only the k nearest leave a task; no operator
joins all pairs of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import squared_distance
from tidemark.plans.blocks import map_blocks, tile_stream
from tidemark.plans.scan import with_halo

TILE = 2048


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, summed feature by feature so equal inputs give equal results."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def knn_join(
    query: DataFrame, ref: DataFrame, by: list[str], k: int, *, query_id: str = "id", ref_id: str = "id", features: str = "features",
    exclude_self: bool = False, tile: int = TILE,
) -> DataFrame:
    """k nearest rows of ``ref`` in the same block for each row of ``query``.

    Returns (by*, query_id, neighbor, distance, rank), ties by the lower neighbour id.  Queries of a
    block are cut into tiles of about ``tile`` rows, one task each; a block's references stream past
    a tile in batches, so a hot block uses many tasks and bounded memory and stays exact.
    """
    side = lambda df, ident: df.select(*by, F.col(ident).cast("bigint").alias("__id"), F.col(features).alias("__x"))
    schema = T.StructType([query.schema[c] for c in by] + [
        T.StructField(query_id, T.LongType()), T.StructField("neighbor", T.LongType()),
        T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def begin(q):
        return np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def update(acc, q, r):
        ids = r["__id"].to_numpy()
        d = _distances(np.stack(q["__x"].to_numpy()), np.stack(r["__x"].to_numpy()))
        near = np.broadcast_to(ids, d.shape)
        if exclude_self:
            d = np.where(near == q["__id"].to_numpy()[:, None], np.inf, d)
        d, near = np.concatenate([acc[0], d], 1), np.concatenate([acc[1], near], 1)
        order = np.lexsort((near, d), axis=1)[:, :k]
        return np.take_along_axis(d, order, 1), np.take_along_axis(near, order, 1)

    def finish(acc, q):
        rows, cols = np.nonzero(np.isfinite(acc[0]))
        out = q.iloc[rows][by].reset_index(drop=True) if by else pd.DataFrame(index=range(len(rows)))
        out[query_id] = q["__id"].to_numpy()[rows]
        out["neighbor"] = acc[1][rows, cols]
        out["distance"] = np.sqrt(acc[0][rows, cols])
        out["rank"] = (cols + 1).astype(np.int32)
        return out

    return tile_stream(side(query, query_id), side(ref, ref_id), by, "__id", begin, update, finish, schema, tile=tile)


def window_knn_regress(
    df: DataFrame, keys: list[str], features: list[str], target: str, *, k: int = 2, window: int = 1000, agg: str = "mean", seq: str = "seq",
    bucket: int | None = None,
) -> DataFrame:
    """Predict each row as the mean or median target of its k nearest among the ``window`` rows before it.

    0 while fewer than ``k`` earlier rows exist; ties in distance go to the earlier row.  ``seq`` is
    dense per key.  Each bucket of rows travels with the ``window`` rows before it, so a task holds at
    most bucket + window rows of one key.
    """
    if agg not in ("mean", "median"):
        raise ValueError("agg must be 'mean' or 'median'")
    size = bucket or max(4 * window, 1000)
    spread = with_halo(df.select(*keys, seq, *features, target), window, seq=seq, size=size)
    schema = T.StructType([df.schema[c] for c in [*keys, seq, target]] + [T.StructField("y_pred", T.DoubleType())])

    def predict(block: pd.DataFrame) -> pd.DataFrame:
        x = block[features].to_numpy(dtype=float)
        y = block[target].to_numpy(dtype=float)
        at = block[seq].to_numpy()
        home = np.flatnonzero(block["__home"].to_numpy())
        pred = np.zeros(len(home))
        for lo in range(0, len(home), 256):
            mine = home[lo : lo + 256]
            first = np.searchsorted(at, at[mine[0]] - window)
            last = mine[-1]
            if last <= first:
                continue
            d = _distances(x[mine], x[first:last])
            back = at[mine][:, None] - at[None, first:last]
            d[(back < 1) | (back > window)] = np.inf
            if d.shape[1] < k:
                continue
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            near = d <= kth[:, None]
            for i in np.flatnonzero(np.isfinite(kth)):
                pick = np.flatnonzero(near[i])
                if len(pick) > k:
                    pick = pick[np.argsort(d[i, pick], kind="stable")[:k]]
                value = y[first:last][pick]
                pred[lo + i] = value.mean() if agg == "mean" else np.median(value)
        out = block.iloc[home][[*keys, seq, target]].reset_index(drop=True)
        out["y_pred"] = pred
        return out

    return map_blocks(spread, [*keys, "__bucket"], [seq], predict, schema, max_rows=size + window)


def anchor_similarity(df: DataFrame, features: str, anchors: list[list[float]], *, k: int = 5, sigma: float = 5.0, name: str = "similarity") -> DataFrame:
    """Row-normalised Gaussian similarity to the k nearest anchors: ARRAY<(anchor, weight)>.

    Anchors are a fixed-size parameter, so they travel as a literal in the expression.
    """
    if len(anchors) > 1000:
        raise ValueError("at most 1000 anchors")
    points = F.array(*[F.struct(F.lit(i).alias("anchor"), F.array(*[F.lit(float(v)) for v in a]).alias("x")) for i, a in enumerate(anchors)])
    near = F.slice(F.array_sort(F.transform(points, lambda p: F.struct(
        squared_distance(F.col(features), p["x"]).alias("d"), p["anchor"].alias("anchor")))), 1, k)
    weights = F.transform("__near", lambda n: F.exp(-n["d"] / (2 * sigma * sigma)))
    total = F.aggregate("__w", F.lit(0.0), lambda a, w: a + w) + F.lit(1e-10)
    return (
        df.withColumn("__near", near).withColumn("__w", weights).withColumn("__t", total)
        .withColumn(name, F.zip_with("__near", "__w", lambda n, w: F.struct(n["anchor"].alias("anchor"), (w / F.col("__t")).alias("weight"))))
        .drop("__near", "__w", "__t")
    )


def knn_graph(df: DataFrame, by: list[str], k: int = 10, *, ident: str = "id", features: str = "features") -> DataFrame:
    """Symmetrised k-nearest-neighbour edges (by*, row, col) inside each block."""
    near = knn_join(df, df, by, k, query_id=ident, ref_id=ident, features=features, exclude_self=True)
    one = near.select(*by, F.col(ident).alias("row"), F.col("neighbor").alias("col"))
    return one.unionByName(one.select(*by, F.col("col").alias("row"), F.col("row").alias("col"))).distinct()


def graph_laplacian(edges: DataFrame, by: list[str]) -> DataFrame:
    """Nonzero entries (by*, row, col, value) of degree minus adjacency."""
    degree = edges.groupBy(*by, "row").agg(F.count("*").cast("double").alias("value")).select(*by, "row", F.col("row").alias("col"), "value")
    return edges.withColumn("value", F.lit(-1.0)).unionByName(degree)


def minority_pairs(near: DataFrame, by: list[str], ident: str) -> DataFrame:
    """(row, neighbour) pairs for interpolation from an array of chosen neighbours per row."""
    return near.select(*by, ident, F.explode("neighbors").alias("neighbor"))


def reverse_nn_density(df: DataFrame, keys: list[str], features: str, *, window: int = 100, seq: str = "seq", bucket: int | None = None) -> DataFrame:
    """Local density: how many of the ``window`` rows before a row have it as their nearest neighbour so far.

    A row's nearest distance so far is to the rows up to ``window`` after it; a new row counts for
    each earlier row whose nearest distance it lowers.
    """
    size = bucket or max(4 * window, 1000)
    spread = with_halo(df.select(*keys, seq, features), 2 * window, seq=seq, size=max(size, 2 * window))
    schema = T.StructType([df.schema[c] for c in [*keys, seq]] + [T.StructField("density", T.IntegerType())])

    def count(block: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(block[features].to_numpy()).astype(float)
        at = block[seq].to_numpy()
        nearest = np.full(len(x), np.inf)
        density = np.zeros(len(x), dtype=np.int32)
        for i in range(len(x)):
            lo = np.searchsorted(at, at[i] - window)
            if lo < i:
                d = ((x[lo:i] - x[i]) ** 2).sum(axis=1)
                closer = d < nearest[lo:i]
                density[i] = closer.sum()
                nearest[lo:i] = np.minimum(nearest[lo:i], d)
                nearest[i] = d.min()
        home = block["__home"].to_numpy()
        return block.loc[home, [*keys, seq]].assign(density=density[home]).reset_index(drop=True)

    return map_blocks(spread, [*keys, "__bucket"], [seq], count, schema, max_rows=max(size, 2 * window) + 2 * window)
