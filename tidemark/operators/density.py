"""Density models per batch and log densities of rows under them."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.broad import mvn_oas
from tidemark.plans.blocks import sum_arrays, tile_stream

MODEL_BYTES = 256 << 20


@dataclasses.dataclass
class BatchDensities:
    """Gaussian models of all batches as arrays: one mean, precision and log determinant each."""

    features: list[str]
    batches: np.ndarray
    means: np.ndarray
    precisions: np.ndarray
    logdets: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, batch: str, features: list[str], *, ridge: float = 1e-9) -> "BatchDensities":
        """Mean and OAS-shrunk covariance per batch.  The number of batches is the number of periods,
        not of rows; it is checked before anything is brought to the driver."""
        models = mvn_oas(df, [batch], features)
        p = len(features)
        most = MODEL_BYTES // ((p * p + p) * 8)
        rows = sorted(models.limit(most + 1).collect(), key=lambda r: r[batch])
        if len(rows) > most:
            raise ValueError(f"more than {most} batches of {p} features; use coarser batches")
        means = np.array([r["mean"] for r in rows])
        covs = np.array([r["cov"] for r in rows]).reshape(-1, p, p) + ridge * np.eye(p)
        return cls(list(features), np.array([r[batch] for r in rows]), means, np.linalg.inv(covs), np.linalg.slogdet(covs)[1])

    def logpdf(self, x: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Rows x models, or one model per row when ``which`` gives its index (-1: none, nan)."""
        const = -0.5 * (x.shape[1] * math.log(2 * math.pi) + self.logdets)
        if which is not None:
            ok = which >= 0
            at = np.where(ok, which, 0)
            gap = x - self.means[at]
            out = const[at] - 0.5 * np.einsum("ni,nij,nj->n", gap, self.precisions[at], gap)
            return np.where(ok, out, np.nan)
        out = np.empty((len(x), len(self.batches)))
        for b in range(len(self.batches)):
            gap = x - self.means[b]
            out[:, b] = const[b] - 0.5 * np.einsum("ni,ij,nj->n", gap, self.precisions[b], gap)
        return out

    def index(self, batch: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.batches, batch)
        at = np.minimum(at, len(self.batches) - 1)
        return np.where(self.batches[at] == batch, at, -1)


def _map(df: DataFrame, names: list[str], fn) -> DataFrame:
    """Add double columns computed from whole Arrow batches."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(frames):
        for f in frames:
            if len(f):
                yield f.assign(**fn(f))

    return df.mapInPandas(run, schema)


def mvn_logpdf(df: DataFrame, models: BatchDensities, model_of: str, name: str = "logpdf") -> DataFrame:
    """Log density of each row under the model of the batch in column ``model_of``."""
    return _map(df, [name], lambda f: {
        name: models.logpdf(f[models.features].to_numpy(dtype=float), models.index(f[model_of].to_numpy()))})


def batch_densities(
    df: DataFrame, models: BatchDensities, batch: str, window: int | None = None, *, need: tuple[str, ...] = ("new", "own", "mean", "near")
) -> DataFrame:
    """Add p_new, p_own, p_mean and p_near: density under the newest batch, the row's own batch, the mean over
    batches, and the mean over the ``window`` batches before the row's own, its own, and the ``window`` - 1 after it
    (the first batch: its own only).  ``need`` names those to add; models that none of them uses are not evaluated."""
    last = len(models.batches) - 1
    names = [n for n in ("new", "own", "mean", "near") if n in need and (n != "near" or window is not None)]

    def fn(f: pd.DataFrame) -> dict:
        x, own = f[models.features].to_numpy(dtype=float), models.index(f[batch].to_numpy())
        out = {}
        if "new" in names:
            out["p_new"] = np.exp(models.logpdf(x, np.full(len(x), last)))
        if "own" in names:
            out["p_own"] = np.exp(models.logpdf(x, own))
        if "mean" in names or "near" in names:
            p = np.exp(models.logpdf(x))
            out |= {"p_mean": p.mean(axis=1)} if "mean" in names else {}
        if "near" in names:
            total = np.concatenate([np.zeros((len(p), 1)), np.cumsum(p, axis=1)], axis=1)
            lo, hi = np.maximum(own - window, 0), np.where(own == 0, 1, np.minimum(own + window, last + 1))
            rows = np.arange(len(p))
            out["p_near"] = (total[rows, hi] - total[rows, lo]) / (hi - lo)
        return out

    return _map(df, [f"p_{n}" for n in names], fn)


def kde_logpdf(query: DataFrame, ref: DataFrame, by: list[str], features: list[str], ident: str, *, bandwidth: float = 1.0, tile: int = 2048) -> DataFrame:
    """Log of the Gaussian kernel density of each query row over all reference rows of its block.

    Equal points are compared once: references count as often as they come, and a point's density goes to all its
    query rows.  Points stream past tiles of query points; only a running log-sum-exp per point is kept.  The work
    grows with the square of a block's distinct points.
    """
    d = len(features)
    parts = [f"__x{j}" for j in range(d)]
    plain = lambda df: df.select(*by, *[F.col(f).cast("double").alias(x) for f, x in zip(features, parts)])
    side = lambda df: plain(df).groupBy(*by, *parts).agg(F.count(F.lit(1)).cast("double").alias("__n")).withColumn("__id", F.xxhash64(*parts))
    schema = T.StructType([query.schema[c] for c in by] + [T.StructField(c, T.DoubleType()) for c in [*parts, "logpdf"]])

    def begin(q):
        return np.full(len(q), -np.inf), np.zeros(len(q)), 0.0

    def update(acc, q, r):
        top, total, n = acc
        e = np.zeros((len(q), len(r)))
        for x in parts:
            e -= (q[x].to_numpy(dtype=float)[:, None] - r[x].to_numpy(dtype=float)[None]) ** 2
        e /= 2 * bandwidth**2
        times = r["__n"].to_numpy()
        new = np.maximum(top, e.max(axis=1))
        with np.errstate(invalid="ignore"):
            total = np.where(np.isfinite(top), total * np.exp(top - new), 0.0) + (np.exp(e - new[:, None]) * times).sum(axis=1)
        return new, total, n + times.sum()

    def finish(acc, q):
        top, total, n = acc
        out = q[[*by, *parts]].reset_index(drop=True)
        with np.errstate(divide="ignore"):
            out["logpdf"] = top + np.log(total) - math.log(max(n, 1)) - d / 2 * math.log(2 * math.pi * bandwidth**2)
        return out

    found = tile_stream(side(query), side(ref), by, "__id", begin, update, finish, schema, tile=tile)
    rows = query.select(*by, ident, *[F.col(f).cast("double").alias(f"__q{j}") for j, f in enumerate(features)])
    known = found.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], *parts, "logpdf")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"__b{i}"))
    for j, x in enumerate(parts):  # a missing number is a point's too
        same = same & F.col(f"__q{j}").eqNullSafe(F.col(x))
    return rows.join(known, same).select(*by, ident, "logpdf")


@dataclasses.dataclass
class Mixture:
    """Weights, means and covariances of a Gaussian mixture."""

    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    steps: int = 0

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows x components."""
        parts = BatchDensities(self.features, np.arange(len(self.weights)), self.means, np.linalg.inv(self.covs), np.linalg.slogdet(self.covs)[1])
        return parts.logpdf(x) + np.log(self.weights)


def _logsum(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1)
    return top + np.log(np.exp(logs - top[:, None]).sum(axis=1))


def fit_mixture(df: DataFrame, features: list[str], *, k: int = 2, steps: int = 100, tolerance: float = 1e-6, ridge: float = 1e-6) -> Mixture:
    """Expectation maximisation, one aggregate of responsibilities per step.

    Component j starts with an equal weight, the diagonal of the overall covariance, and a mean that lies
    (2 j + 1 - k) / k standard deviations from the overall one in every feature, so the fit does not depend on
    draws or partitions.  ``ridge`` is added to each variance.  It ends when the mean log density gains less than
    ``tolerance``, or after ``steps``.  Rows with a missing feature are left out.
    """
    p = len(features)
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).filter(" AND ".join(f"`{f}` IS NOT NULL" for f in features))
    first = rows.agg(*[g(f) for f in features for g in (F.avg, F.var_pop)]).first()
    if first[0] is None:
        raise ValueError("a mixture needs rows")
    mean, var = np.array(first[0::2], float), np.array(first[1::2], float)
    offsets = (2 * np.arange(k) + 1 - k) / k
    mix = Mixture(list(features), np.full(k, 1 / k), mean + offsets[:, None] * np.sqrt(var), np.tile(np.diag(var + ridge), (k, 1, 1)))
    size, before = k * (1 + p + p * p) + 2, -np.inf
    while mix.steps < steps:
        def sums(frames, mix=mix):
            total = np.zeros(size)
            for f in frames:
                for at in range(0, len(f), 1 << 14):
                    x = f[features].to_numpy(dtype=float)[at : at + (1 << 14)]
                    logs = mix.log_parts(x)
                    all_ = _logsum(logs)
                    r = np.exp(logs - all_[:, None])
                    second = np.einsum("nk,ni,nj->kij", r, x - mean, x - mean)
                    total += np.concatenate([r.sum(axis=0), (r.T @ (x - mean)).ravel(), second.ravel(), [all_.sum(), len(x)]])
            yield pd.DataFrame({"all": [0], "v": [total]})

        got = np.array(sum_arrays(rows.mapInPandas(sums, "all int, v array<double>"), ["all"], ["v"], [], salts=32).first()["v"])
        n, s, q = np.maximum(got[:k], 1e-300), got[k : k + k * p].reshape(k, p), got[k + k * p : -2].reshape(k, p, p)
        centre = s / n[:, None]
        covs = q / n[:, None, None] - centre[:, :, None] * centre[:, None] + ridge * np.eye(p)
        level = got[-2] / got[-1]
        mix = Mixture(list(features), n / got[-1], mean + centre, covs, mix.steps + 1)
        if level - before < tolerance:
            break
        before = level
    return mix


def gmm_logpdf(df: DataFrame, fit_on: DataFrame, features: list[str], *, k: int = 2, name: str = "logpdf", **fit) -> DataFrame:
    """Log density under a Gaussian mixture fitted on ``fit_on`` (see ``fit_mixture``); null where a feature is missing."""
    mix = fit_mixture(fit_on, features, k=k, **fit)

    def fn(f):
        x = f[features].to_numpy(dtype=float)
        out = np.full(len(x), np.nan)
        whole = ~np.isnan(x).any(axis=1)
        if whole.any():
            out[whole] = _logsum(mix.log_parts(x[whole]))
        return {name: out}

    return _map(df, [name], fn)
