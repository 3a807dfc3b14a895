"""Weights and priors that follow performance over time: small folds over per-period aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.keyed import Machine, keyed_scan


class Ewma(Machine):
    """r becomes (1 - alpha) r + alpha x, starting from 0."""

    inputs = ("x",)
    outputs = (("ewma", "double"),)

    def __init__(self, alpha: float = 0.1):
        self.alpha = alpha

    def start(self):
        return 0.0

    def feed(self, state, cols):
        out = np.empty(len(cols["x"]))
        for i, x in enumerate(cols["x"].tolist()):
            state = (1 - self.alpha) * state + self.alpha * x
            out[i] = state
        return state, {"row": np.arange(len(out)), "ewma": out}


def ewma_metric(df: DataFrame, keys: list[str], order: str, value: Column, alpha: float = 0.1, **scan) -> DataFrame:
    """Exponentially weighted metric per key after each step."""
    return keyed_scan(df.withColumn("x", value.cast("double")), keys, order, Ewma(alpha), **scan)


def best_model_ewma(ewma: DataFrame, model: str, order: str) -> DataFrame:
    """The model of least running metric at each step; ties go to the lower name."""
    best = ewma.groupBy(order).agg(F.min(F.struct(F.col("ewma"), F.col(model))).alias("b"))
    return best.select(order, F.col(f"b.{model}").alias(model), F.col("b.ewma").alias("ewma"))


class LabelPrior(Machine):
    """Exponentiated-gradient class prior: pi * exp(-eta / sqrt(t) * g) + 1e-4, renormalised."""

    inputs = ("gradient",)
    outputs = (("prior", "array<double>"),)

    def __init__(self, n_classes: int, eta: float):
        self.n_classes, self.eta = n_classes, eta

    def start(self):
        return (0, [1.0 / self.n_classes] * self.n_classes)

    def feed(self, state, cols):
        t, pi = state
        out = []
        for g in cols["gradient"]:
            t += 1
            step = self.eta / math.sqrt(t)
            raised = [p * math.exp(-step * x) + 1e-4 for p, x in zip(pi, g)]
            total = sum(raised)
            pi = [r / total for r in raised]
            out.append(pi)
        return (t, pi), {"row": np.arange(len(out)), "prior": out}


def label_prior_omd(df: DataFrame, keys: list[str], chunk: str, proba: str, label: str, n_classes: int, eta: float = 0.1, **scan) -> DataFrame:
    """Class prior after each chunk; a chunk's gradient is the mean of prediction minus one-hot label."""
    gradient = [F.avg(F.get(F.col(proba), F.lit(i)) - (F.col(label) == i).cast("double")).alias(f"__g{i}") for i in range(n_classes)]
    per = df.groupBy(*keys, chunk).agg(*gradient).withColumn("gradient", F.array(*[F.col(f"__g{i}") for i in range(n_classes)]))
    return keyed_scan(per, keys, chunk, LabelPrior(n_classes, eta), **scan)


class MemberWeights(Machine):
    """Weights of all members, updated by one array of chunk errors per step.

    ``rule`` maps (weights, errors) to new weights; the weights used at a step are those before it.
    """

    inputs = ("errors",)
    outputs = (("weights", "array<double>"),)

    def __init__(self, n_members: int, rule):
        self.n_members, self.rule = n_members, rule

    def start(self):
        return [1.0] * self.n_members

    def feed(self, state, cols):
        out = []
        for e in cols["errors"]:
            out.append(list(state))
            state = self.rule(state, e)
        return state, {"row": np.arange(len(out)), "weights": out}


def majority_rule(beta: float = 0.5, prune: float = 0.01):
    """Weight times beta^error, scaled so the largest is 1; under ``prune`` a member is silent (0)."""

    def rule(weights, errors):
        raw = [w * beta**e for w, e in zip(weights, errors)]
        top = max(raw) or 1.0
        return [r / top if r / top >= prune else 0.0 for r in raw]

    return rule


def member_errors(scored: DataFrame, keys: list[str], chunk: str, member: str, n_members: int, wrong: Column) -> DataFrame:
    """(keys, chunk, errors ARRAY): mean error of each member per chunk."""
    sums = scored.groupBy(*keys, chunk).agg(*[F.avg(F.when(F.col(member) == m, wrong.cast("double"))).alias(f"__e{m}") for m in range(n_members)])
    return sums.select(*keys, chunk, F.array(*[F.coalesce(F.col(f"__e{m}"), F.lit(0.0)) for m in range(n_members)]).alias("errors"))


def dynamic_weights(errors: DataFrame, keys: list[str], chunk: str, n_members: int, rule=None, **scan) -> DataFrame:
    """Member weights in force at each chunk (learned from the chunks before it)."""
    return keyed_scan(errors, keys, chunk, MemberWeights(n_members, rule or majority_rule()), **scan)


def weighted_vote(scored: DataFrame, weights: DataFrame, keys: list[str], chunk: str, row: list[str], member: str, pred: str) -> DataFrame:
    """Class of largest summed member weight per row; ties and silence go to the lower class."""
    joined = scored.join(weights, [*keys, chunk])
    votes = joined.groupBy(*keys, chunk, *row, pred).agg(F.sum(F.get("weights", F.col(member))).alias("v"))
    best = votes.groupBy(*keys, chunk, *row).agg(F.min(F.struct((-F.col("v")).alias("v"), F.col(pred).alias("p"))).alias("b"))
    return best.select(*keys, chunk, *row, F.col("b.p").alias("y_pred"))


def cost_weights(df: DataFrame, label: str, pred: str, costs: list[float], weight: str = "weight") -> DataFrame:
    """Cost-sensitive boosting weight (class cost inside and outside the exponent) of one round.

    alpha = 0.5 ln(sum of cost-weighted right / sum of cost-weighted wrong), weight becomes
    cost * weight * exp(-+ alpha), scaled to sum to the row count.  Returns it with ``alpha``.
    """
    cost = F.element_at(F.array(*[F.lit(float(c)) for c in costs]), F.col(label) + 1)
    right = F.col(label) == F.col(pred)
    row = df.agg(F.sum(F.when(right, cost * F.col(weight))).alias("r"), F.sum(F.when(~right, cost * F.col(weight))).alias("w")).first()
    alpha = 0.5 * math.log(max(row["r"] or 0.0, 1e-10) / max(row["w"] or 0.0, 1e-10))
    raw = cost * F.col(weight) * F.exp(F.when(right, F.lit(-alpha)).otherwise(F.lit(alpha)))
    out = df.withColumn("__raw", raw)
    total = out.agg(F.sum("__raw").alias("s"), F.count("*").alias("n")).first()
    return out.withColumn(weight, F.col("__raw") / F.lit(total["s"]) * F.lit(float(total["n"]))).withColumn("alpha", F.lit(alpha)).drop("__raw")


