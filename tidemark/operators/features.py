"""Feature transforms: permutations, dropped features, subspaces, running moments, random nodes."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.arrays import pick
from tidemark.functions.hashing import hash_uniform
from tidemark.plans.scan import running


def permute_features(features: Column, batch: Column, n: int, kind: str = "rotate", seed: int = 42) -> Column:
    """Move feature columns, differently in each batch (batch 0 stays as it is).

    ``rotate`` shifts by the batch number, ``permute`` orders positions by a hash of the batch,
    ``swap`` exchanges one hashed pair per batch.
    """
    ids = F.sequence(F.lit(0), F.lit(n - 1))
    if kind == "rotate":
        index = F.transform(ids, lambda i: F.pmod(i - batch, F.lit(n)).cast("int"))
    elif kind == "permute":
        draws = F.array(*[F.struct(hash_uniform(batch, f"{seed}:perm{i}").alias("u"), F.lit(i).alias("i")) for i in range(n)])
        index = F.transform(F.array_sort(draws), lambda d: d["i"])
    elif kind == "swap":
        a = F.floor(hash_uniform(batch, f"{seed}:a") * n).cast("int")
        b = F.pmod(a + 1 + F.floor(hash_uniform(batch, f"{seed}:b") * (n - 1)).cast("int"), F.lit(n))
        index = F.transform(ids, lambda i: F.when(i == a, b).when(i == b, a).otherwise(i))
    else:
        raise ValueError("kind must be 'rotate', 'permute' or 'swap'")
    return F.when(batch == 0, features).otherwise(pick(features, index))


def drop_features(x: Column, seq: Column, n_rows: int, n_features: int, mode: str = "capricious", seed: int = 42) -> Column:
    """Remove features from a map row.

    ``capricious`` keeps a hashed half of the features per row (all of them from the half-way chunk
    end on); ``trapezoidal`` keeps a prefix that grows by a tenth of the features per tenth of rows.
    """
    index = seq - 1
    if mode == "trapezoidal":
        left = (F.floor(index / F.lit(n_rows / 10.0)).cast("int") + 1) * int(n_features / 10)
        left = F.when(seq == n_rows, F.lit(n_features - 2)).otherwise(left)
        return F.map_filter(x, lambda k, v: k <= left)
    if mode != "capricious":
        raise ValueError("mode must be 'capricious' or 'trapezoidal'")
    half = math.ceil(n_features * 0.5)
    chunk = math.ceil(n_rows * 0.5)
    keep = F.least(F.lit(half) * (1 + F.floor(seq / F.lit(chunk)).cast("int")), F.lit(n_features))
    draws = F.array(*[F.struct(hash_uniform(seq, f"{seed}:drop{i}").alias("u"), F.lit(i).alias("i")) for i in range(n_features)])
    kept = F.transform(F.slice(F.array_sort(draws), F.lit(1), keep), lambda d: d["i"])
    return F.map_filter(x, lambda k, v: F.array_contains(kept, k))


def signed_label(label: Column) -> Column:
    """{0, 1} to {-1, 1}."""
    return F.when(label == 1, 1).when(label == 0, -1).otherwise(label)


def unsigned_label(label: Column) -> Column:
    """{-1, 1} to {0, 1}."""
    return F.when(label == -1, 0).otherwise(label)


def subspace_size(n_features: int, mode: str, k: int) -> int:
    """How many features a member sees; negative sizes count back from all of them."""
    root = math.sqrt(n_features)
    size = {
        "m": k, "sqrtM1": round(root) + 1, "MsqrtM1": n_features - (round(root) + 1),
        "percentage": round(n_features * abs(k) / 100.0) * (-1 if k < 0 else 1),
    }.get(mode)
    if size is None:
        raise ValueError("mode must be 'm', 'sqrtM1', 'MsqrtM1' or 'percentage'")
    if size < 0:
        size = n_features + size
    return min(max(int(size), 1), n_features)


def subspaces(spark: SparkSession, n_features: int, members: int, mode: str = "percentage", k: int = 60, seed: int = 42) -> DataFrame:
    """(member, features ARRAY<INT>): random feature subsets; distinct ones when few exist.

    With at most 20 features members walk through all combinations in hashed order; otherwise
    each member takes the features with the smallest hashes.
    """
    size = subspace_size(n_features, mode, k)
    if n_features <= 20:
        combos = [list(c) for c in itertools.combinations(range(n_features), size)]
        table = spark.createDataFrame([(i, c) for i, c in enumerate(combos)], "combo int, features array<int>")
        ranked = table.agg(F.array_sort(F.collect_list(F.struct(
            hash_uniform(F.col("combo"), f"{seed}:space").alias("u"), F.col("features").alias("f")))).alias("all"))
        member = F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member")
        return ranked.select("all", member).select(
            "member", F.get("all", F.col("member") % F.size("all"))["f"].alias("features"))
    draws = F.array(*[F.struct(hash_uniform(F.col("id"), f"{seed}:space{i}").alias("u"), F.lit(i).alias("i")) for i in range(n_features)])
    chosen = F.transform(F.slice(F.array_sort(draws), 1, size), lambda d: d["i"])
    return spark.range(members).select(F.col("id").cast("int").alias("member"), F.array_sort(chosen).alias("features"))


def running_feature_moments(df: DataFrame, order: str, x: str, *, span: int = 1_000_000) -> DataFrame:
    """Count, mean and population variance of each map feature up to and including each row."""
    cells = df.select(order, F.explode(x).alias("feature", "value")).filter(F.col("value").isNotNull())
    run = running(cells, ["feature"], order, {
        "n": ("sum", F.lit(1).cast("bigint")), "__s": ("sum", F.col("value")), "__q": ("sum", F.col("value") * F.col("value"))}, span=span)
    mean = F.col("__s") / F.col("n")
    return run.withColumn("mean", mean).withColumn("variance", F.col("__q") / F.col("n") - F.col("mean") * F.col("mean")).drop("__s", "__q")
