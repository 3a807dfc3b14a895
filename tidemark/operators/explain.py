"""Chunk-wise selection by how a linear model's explanations move."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import jeffreys_rank_divergence, norm_l2
from tidemark.operators.select import query_topk_per_chunk
from tidemark.plans.keyed import Machine, keyed_scan


def attributions(df: DataFrame, features: list[str], weights: list[list[float]], means: list[float], class_weight: Column, name: str = "attribution") -> DataFrame:
    """Class-weighted linear contribution of each feature: sum_c cw_c * w_cj * (x_j - mean_j)."""
    parts = []
    for j, f in enumerate(features):
        per_class = F.array(*[F.lit(float(w[j])) for w in weights])
        blend = F.aggregate(F.zip_with(class_weight, per_class, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        parts.append(blend * (F.col(f).cast("double") - F.lit(float(means[j]))))
    return df.withColumn(name, F.array(*parts))


def ranking(values: Column) -> Column:
    """Feature positions in ascending order of value, ties by position."""
    pairs = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"].cast("double"))


def attribution_ranking(df: DataFrame, by: list[str], attribution: str, n_features: int) -> DataFrame:
    """Per group, feature positions in ascending order of their summed attribution."""
    sums = df.groupBy(*by).agg(*[F.sum(F.get(attribution, F.lit(j))).alias(f"__a{j}") for j in range(n_features)])
    return sums.select(*by, ranking(F.array(*[F.col(f"__a{j}") for j in range(n_features)])).alias("ranking"))


class QuietGate(Machine):
    """Opens when the divergence from the chunk before reaches gamma; gamma falls by e^-alpha per quiet chunk."""

    inputs = ("divergence",)
    outputs = (("is_open", "boolean"), ("gamma", "double"))

    def __init__(self, gamma: float = 0.6, alpha: float = 0.1):
        self.gamma, self.alpha = gamma, alpha

    def start(self):
        return 0

    def feed(self, quiet, cols):
        n = len(cols["divergence"])
        opened, used = np.zeros(n, bool), np.zeros(n)
        for i, d in enumerate(cols["divergence"].tolist()):
            used[i] = self.gamma * math.exp(-self.alpha * quiet)
            opened[i] = d >= used[i]
            quiet = 0 if opened[i] else quiet + 1
        return quiet, {"row": np.arange(n), "is_open": opened, "gamma": used}


def query_explanation_chunk(
    df: DataFrame, keys: list[str], chunk: str, order: str, features: list[str], weights: list[list[float]], means: list[float], proba: str, *,
    query_size: int, gamma: float = 0.6, alpha: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """(selected rows, gate per chunk).

    A chunk's ranking of summed attributions is compared with the ranking of the chunk before (found by
    an equi-join on the chunk number).  In an open chunk the ``query_size`` rows of least
    divergence plus class-weighted confidence are asked.  Class weights are the predicted class
    shares of the chunk before, equal at the start.
    """
    n_classes = len(weights)
    pred = F.array_position(F.col(proba), F.array_max(proba)).cast("int") - 1
    shares = df.groupBy(*keys, chunk).agg(*[F.avg((pred == c).cast("double")).alias(f"__s{c}") for c in range(n_classes)])
    shares = shares.select(*keys, (F.col(chunk) + 1).alias(chunk), F.array(*[F.col(f"__s{c}") for c in range(n_classes)]).alias("__cw"))
    even = F.array(*[F.lit(1.0 / n_classes)] * n_classes)
    rows = df.join(shares, [*keys, chunk], "left").withColumn("__cw", F.coalesce("__cw", even))
    rows = attributions(rows, features, weights, means, F.col("__cw"))
    ranks = attribution_ranking(rows, [*keys, chunk], "attribution", len(features))
    earlier = ranks.select(*keys, (F.col(chunk) + 1).alias(chunk), F.col("ranking").alias("__before"))
    moved = ranks.join(earlier, [*keys, chunk], "left").withColumn(
        "divergence", F.coalesce(jeffreys_rank_divergence(F.col("ranking"), F.col("__before")), F.lit(0.0)))
    # one small row per chunk; a single stream is its own key
    lane = moved.withColumn("__lane", F.lit(0))
    gate = keyed_scan(lane, [*keys, "__lane"], chunk, QuietGate(gamma, alpha), keep=("divergence",)).drop("__lane")
    opened = rows.join(gate.filter("is_open").select(*keys, chunk), [*keys, chunk]).join(earlier, [*keys, chunk])
    own = F.element_at(F.col("__cw"), F.array_position(F.col(proba), F.array_max(proba)).cast("int"))
    score = jeffreys_rank_divergence(ranking(F.col("attribution")), F.col("__before")) + own * norm_l2(F.col(proba))
    picked = query_topk_per_chunk(opened.withColumn("score", score), [*keys, chunk], "score", order, query_size)
    return picked, gate
