"""Regression learners: stochastic gradient per key, exact ridge over chunks, bagged ridge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import hash_poisson
from tidemark.plans.chunks import lagged_prefix, score_join
from tidemark.plans.keyed import Machine, keyed_scan


class Sgd(Machine):
    """Linear model by one gradient step per row; predicts each row before learning it.

    linear: step * 0.99^n.  ridge: weight decay ``alpha``.  lasso: subgradient of the L1 penalty; a zero
    coefficient moves only when its gradient exceeds ``alpha``.  With ``warm`` the first rows fit the
    scale and are passed ``epochs`` times; they get no prediction.
    """

    inputs = ("features", "target")
    outputs = (("y_pred", "double"),)

    def __init__(self, kind: str = "linear", *, rate: float = 0.01, alpha: float = 0.01, warm: int = 0, epochs: int = 10):
        if kind not in ("linear", "ridge", "lasso"):
            raise ValueError("kind must be 'linear', 'ridge' or 'lasso'")
        self.kind, self.rate, self.alpha, self.warm, self.epochs = kind, rate, alpha, warm, epochs

    def start(self):
        return dict(w=None, b=0.0, rate=self.rate, mean=None, std=None, held=[])

    def learn(self, s, x, y):
        err = y - (float(x @ s["w"]) + s["b"])
        if self.kind == "linear":
            step = s["rate"] * err
            s["w"] = s["w"] + step * x
            s["b"] += step
            s["rate"] *= 0.99
        elif self.kind == "ridge":
            s["w"] = s["w"] - s["rate"] * (self.alpha * s["w"] - err * x)
            s["b"] += s["rate"] * err
        else:
            pull = err * x
            at_zero = np.where(np.abs(pull) > self.alpha, pull - self.alpha * np.sign(pull), 0.0)
            s["w"] = s["w"] + s["rate"] * np.where(s["w"] == 0, at_zero, pull - self.alpha * np.sign(s["w"]))
            s["b"] += s["rate"] * err

    def feed(self, state, cols):
        s = dict(state, held=list(state["held"]))
        rows, preds = [], []
        for i, (x, y) in enumerate(zip(cols["features"], cols["target"].tolist())):
            x = np.asarray(x, dtype=float)
            if s["w"] is None:
                s["w"] = np.zeros(len(x))
            if s["mean"] is None and self.warm:
                s["held"].append((x, y))
                if len(s["held"]) == self.warm:
                    block = np.array([h[0] for h in s["held"]])
                    std = block.std(axis=0)
                    s["mean"], s["std"] = block.mean(axis=0), np.where(std > 0, std, 1.0)
                    for _ in range(self.epochs):
                        for hx, hy in s["held"]:
                            self.learn(s, (hx - s["mean"]) / s["std"], hy)
                    s["held"] = []
                continue
            if self.warm:
                x = (x - s["mean"]) / s["std"]
            rows.append(i)
            preds.append(float(x @ s["w"]) + s["b"])
            self.learn(s, x, y)
        return s, {"row": np.asarray(rows, dtype=np.int64), "y_pred": preds}


def sgd_regression(df: DataFrame, keys: list[str], order: str, features: list[str], target: str, machine: Sgd, **scan) -> DataFrame:
    """Prequential predictions (keys, order, y_true, y_pred) of one model per key."""
    rows = df.select(*keys, order, F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.col(target).cast("double").alias("target"))
    out = keyed_scan(rows, keys, order, machine, keep=("target",), **scan)
    return out.withColumnRenamed("target", "y_true")


# --- exact ridge ----------------------------------------------------------------------------------


def _terms(features: list[str], target: str, weight: str = "1.0D") -> dict[str, str]:
    """Upper triangle of products with an intercept column first, and products with the target."""
    x = ["1.0D", *[f"cast(`{f}` as double)" for f in features]]
    usable = " AND ".join(f"`{c}` IS NOT NULL" for c in [*features, target])
    out = {}
    for i, a in enumerate(x):
        for j in range(i, len(x)):
            out[f"g{i}_{j}"] = f"CASE WHEN {usable} THEN {weight} * {a} * {x[j]} ELSE 0.0D END"
        out[f"t{i}"] = f"CASE WHEN {usable} THEN {weight} * {a} * cast(`{target}` as double) ELSE 0.0D END"
    return out


def _solve(models: DataFrame, keep: list[str], n: int, reg: float) -> DataFrame:
    """Coefficients (intercept first) of each model row; the intercept is not penalised."""
    schema = T.StructType([models.schema[c] for c in keep] + [T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            g = np.zeros((len(f), n, n))
            t = np.zeros((len(f), n, 1))
            for i in range(n):
                t[:, i, 0] = f[f"t{i}"]
                for j in range(i, n):
                    g[:, i, j] = g[:, j, i] = f[f"g{i}_{j}"]
            g += reg * np.diag([1e-12] + [1.0] * (n - 1))
            empty = g[:, 0, 0] <= 1e-9
            g[empty] = np.eye(n)
            coef = np.linalg.solve(g, t)[:, :, 0]
            coef[empty] = 0.0
            yield f[keep].assign(coef=list(coef))

    return models.mapInPandas(run, schema)


def _predict(rows: DataFrame, models: DataFrame, on: list[str], features: list[str]) -> DataFrame:
    line = "coalesce(coef[0], 0.0D)" + "".join(f" + coalesce(coef[{i + 1}], 0.0D) * cast(`{f}` as double)" for i, f in enumerate(features))
    return score_join(rows, models, on).selectExpr(*[f"`{c}`" for c in rows.columns], f"{line} AS y_pred")


def chunked_ridge(df: DataFrame, keys: list[str], chunk: str, features: list[str], target: str, *, reg: float = 1.0) -> DataFrame:
    """Chunk t predicted by ridge on all rows of the chunks before it: exact, from sums of products."""
    terms = _terms(features, target)
    stats = df.groupBy(*keys, chunk).agg(*[F.expr(f"sum({c}) AS {n}") for n, c in terms.items()])
    models = _solve(lagged_prefix(stats, keys, chunk, list(terms)), [*keys, chunk], len(features) + 1, reg)
    return _predict(df, models, [*keys, chunk], features)


def bagged_ridge(df: DataFrame, keys: list[str], chunk: str, ident: str, features: list[str], target: str, *, members: int = 10,
                 lam: float = 6.0, reg: float = 1.0) -> DataFrame:
    """Mean prediction of ridge members, each row weighted Poisson(lam) per member.

    Member sums are combined before the shuffle; since members are linear their mean prediction is the
    prediction of the mean coefficients, so rows meet one model row per chunk.
    """
    spread = df.select(*keys, chunk, ident, *features, target, F.explode(F.array(*[F.lit(m) for m in range(members)])).alias("member"))
    weighted = spread.withColumn("__w", hash_poisson(F.col(ident), F.concat(F.lit("bag"), F.col("member").cast("string")), lam))
    terms = _terms(features, target, "`__w`")
    stats = weighted.filter("__w > 0").groupBy(*keys, chunk, "member").agg(*[F.expr(f"sum({c}) AS {n}") for n, c in terms.items()])
    models = _solve(lagged_prefix(stats, [*keys, "member"], chunk, list(terms)), [*keys, chunk], len(features) + 1, reg)
    mean = models.groupBy(*keys, chunk).agg(*[F.avg(F.get("coef", F.lit(i))).alias(f"__c{i}") for i in range(len(features) + 1)])
    packed = mean.select(*keys, chunk, F.array(*[F.col(f"__c{i}") for i in range(len(features) + 1)]).alias("coef"))
    return _predict(df, packed, [*keys, chunk], features)
