"""Shared parts of the vector searches: distinct vectors, tile scoring, and expansion to rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def usable(df: DataFrame, id_col: str, vector_col: str, *, zeros: bool) -> DataFrame:
    """Columns vec_id, vector (array<double>): rows whose vector has only finite components and the common length.

    Rows with a null id, a null or empty vector, a null, NaN or infinite component, or (unless ``zeros``) only zeros
    take no part; nor do vectors of another length than the most frequent one (the longer of two equally frequent).
    """
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if not zeros:
        rows = rows.filter(F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.filter(F.size(v) == (sizes[0]["size"] if sizes else 0))


def distinct(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """Columns g (a number), vector, ids: each distinct vector with its k + 1 smallest ids.

    A query leaves out at most its own id, so no result of k can name another id of that vector.  The cut by rank
    runs before the shuffle too, so a vector that many rows share does not gather in one task.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.select("vec_id", "vector").withColumn("r", F.dense_rank().over(first)).filter(F.col("r") <= k + 1)
    grouped = few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return materialize(grouped.select(F.monotonically_increasing_id().alias("g"), "vector", "ids"), "vectors")


def matrix(column: pa.Array, dtype: str = "f8") -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def best_of_tile(score: Callable, queries: pa.Table, data: pa.Table, k: int, kind: pa.DataType, block: int = 1 << 22) -> pa.Table:
    """The k best of a tile for each query: columns q, g, least (smallest id of g) and score.

    Ties go to the smaller id.  ``score(query numbers, data)`` gives a block of the score matrix; at most ``block``
    scores are held at once.
    """
    least, g = data.column("least").to_numpy(), data.column("g").to_numpy()
    q = queries.column("g").to_numpy()
    order = np.argsort(least, kind="stable")
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, len(q), max(1, block // max(1, len(g)))):
        rows = np.arange(at, min(len(q), at + max(1, block // max(1, len(g)))))
        s = score(rows)[:, order]
        n = min(k, s.shape[1])
        if not n:
            continue
        cut = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        r, c = np.nonzero(s >= cut[:, None])
        value = s[r, c]
        by = np.lexsort((c, -value, r))  # c is in the order of ids
        r, c, value = r[by], c[by], value[by]
        start = np.searchsorted(r, np.arange(len(rows)))
        keep = np.arange(len(r)) - start[r] < n
        for part, x in zip(out, (q[rows[r[keep]]], g[order[c[keep]]], least[order[c[keep]]], value[keep])):
            part.append(x)
    types = (np.int64, np.int64, np.int64, kind.to_pandas_dtype())
    return pa.table([pa.array(np.concatenate(x) if x else [], type=pa.from_numpy_dtype(t)) for x, t in zip(out, types)], names=["q", "g", "least", "score"])


def answers(best: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, g) of ``queries``, from the best vectors (q, g, least, score).

    The k + 1 best rows of each distinct query vector are one short array; a query row takes them without itself.
    """
    by = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    top = best.select("q", "g", "least", "score").distinct().withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    rows = top.join(vectors.select("g", "ids"), "g").select("q", "score", F.explode("ids").alias("vec_id"))
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    lists = rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    mine = queries.join(lists.withColumnRenamed("q", "g"), "g").select(F.col("vec_id").alias("query_id"), "found")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    mine = mine.select("query_id", F.posexplode(others).alias("i", "x"))
    return mine.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query_rows(rows: DataFrame, vectors: DataFrame, chosen: Column) -> DataFrame:
    """(vec_id, g) of the query rows; ``chosen`` is a condition on vec_id."""
    return rows.filter(chosen).select("vec_id", "vector").distinct().join(vectors.select("vector", "g"), "vector").select("vec_id", "g")
