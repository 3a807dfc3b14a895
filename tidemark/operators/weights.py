"""Importance weights that make old batches look like the newest one, and what to do with them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import hash_uniform
from tidemark.operators import naive_bayes as nb
from tidemark.plans.blocks import sum_arrays
from tidemark.plans.scan import running
from tidemark.session import materialize


def scale_weights(df: DataFrame, raw: Column, *, clip: float | None = 100.0, normalize: bool = True, unit_l2: bool = False, name: str = "weight") -> DataFrame:
    """Clip raw weights to [0, clip] and scale them to sum to the row count.

    The raw weights are written once, so what they are computed from runs once; their sums are small aggregates of
    the written table.  ``unit_l2`` first divides by the Euclidean norm.
    """
    out = materialize(df.withColumn(name, raw.cast("double")), "raw-weights")
    if unit_l2:
        norm = out.agg(F.sqrt(F.sum(F.col(name) * F.col(name)))).first()[0] or 1.0
        out = out.withColumn(name, F.col(name) / F.lit(norm))
    if clip:
        out = out.withColumn(name, F.greatest(F.lit(0.0), F.least(F.col(name), F.lit(float(clip)))))
    if normalize:
        row = out.agg(F.sum(F.abs(name)).alias("s"), F.count("*").alias("n")).first()
        if row["s"]:
            out = out.withColumn(name, F.col(name) / F.lit(row["s"]) * F.lit(float(row["n"])))
    return out


def weight_direct(df: DataFrame, **scale) -> DataFrame:
    """Density under the newest batch."""
    return scale_weights(df, F.col("p_new"), unit_l2=True, **scale)


def weight_ratio(df: DataFrame, **scale) -> DataFrame:
    """Newest density over the density of the row's own batch."""
    return scale_weights(df, F.col("p_new") / (F.col("p_own") + F.lit(1e-16)), **scale)


def weight_balance(df: DataFrame, **scale) -> DataFrame:
    """Newest density over the mean density of all batches (balance heuristic)."""
    return scale_weights(df, F.col("p_new") / F.col("p_mean"), **scale)


def weight_balance_window(df: DataFrame, **scale) -> DataFrame:
    """Newest density over the mean density of nearby batches, plus 0.01."""
    return scale_weights(df, F.col("p_new") / (F.col("p_near") + F.lit(0.01)), **scale)


def weight_power_law(df: DataFrame, lam: float | None = 0.9, s: float = -1.0, *, delta: float = 0.1) -> DataFrame:
    """((1 - lam) w^s + lam)^(1 / s) of the ratio weight; ``lam=None`` tunes it.

    Tuning finds the root of lam^2 / n * sum(weights^2) - 2 log10(1 / delta) / (3 n) in [0, 1] by
    narrowing a grid: one aggregate evaluates all points of a round.
    """
    ratio = F.col("p_new") / (F.col("p_own") + F.lit(1e-16))
    w = F.greatest(ratio, F.lit(1e-300))
    mixed = lambda x: F.pow((1 - x) * F.pow(w, F.lit(s)) + x, F.lit(1.0 / s))
    if lam is None:
        df = materialize(df, "densities")
        lo, hi = 0.0, 1.0
        for _ in range(5):
            grid = [lo + (hi - lo) * i / 16 for i in range(1, 17)]
            row = df.agg(F.count("*").alias("n"), *[F.sum(F.pow(mixed(F.lit(g)), 2)).alias(f"q{i}") for i, g in enumerate(grid)]).first()
            value = lambda i: grid[i] ** 2 / row["n"] * row[f"q{i}"] - 2 * math.log10(1 / delta) / (3 * row["n"])
            above = next((i for i in range(16) if value(i) >= 0), None)
            if above is None:
                lo = hi
                break
            lo, hi = (grid[above - 1] if above else lo), grid[above]
        lam = hi
    return df.withColumn("weight", mixed(F.lit(float(lam)))).withColumn("lam", F.lit(float(lam)))


def weight_recent(df: DataFrame, batch: str, k: int, **scale) -> DataFrame:
    """1 for the last ``k`` batches, 0 before; scaled to sum to the row count."""
    newest = df.agg(F.max(batch)).first()[0]
    return scale_weights(df, (F.col(batch) > F.lit(newest - k)).cast("double"), **scale)


def weight_uniform(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0))


def weight_classifier(df: DataFrame, batch: str, features: list[str], *, model: str = "forest", seed: int = 42, trees: int = 20) -> DataFrame:
    """Probability of belonging to the newest batch by a Spark ML classifier, scaled."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    newest = df.agg(F.max(batch)).first()[0]
    tagged = df.withColumn("__new", (F.col(batch) == F.lit(newest)).cast("double"))
    x = VectorAssembler(inputCols=features, outputCol="__x").transform(tagged)
    names = dict(featuresCol="__x", labelCol="__new", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")
    if model == "forest":
        learner = RandomForestClassifier(numTrees=trees, seed=seed, **names)
    elif model == "logistic":
        learner = LogisticRegression(**names)
    else:
        raise ValueError("model must be 'forest' or 'logistic'")
    if tagged.agg(F.countDistinct("__new")).first()[0] < 2:
        return weight_uniform(df)
    scored = learner.fit(x).transform(x)
    share = scored.withColumn("__share", F.get(vector_to_array("__p"), F.lit(1))).drop("__x", "__p", "__r", "__y", "__new")
    return scale_weights(share, F.col("__share")).drop("__share")


# --- kernel density ratios ------------------------------------------------------------------------


def _kernel(x: np.ndarray, centres: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-((x[:, None, :] - centres[None]) ** 2).sum(axis=2) / (2 * sigma**2))


def _sum_over_rows(df: DataFrame, features: list[str], extra: list[str], size: int, fn) -> np.ndarray:
    """Sum of ``fn(x, extra columns)`` (a flat array of ``size`` numbers) over all rows.

    Each task adds up its own rows; the partial sums are added by the JVM in two rounds, so the driver gets one array.
    """
    def run(frames):
        total = np.zeros(size)
        for f in frames:
            if len(f):
                total += fn(f[features].to_numpy(dtype=float), f[extra])
        yield pd.DataFrame({"all": [0], "v": [total]})

    parts = df.select(*features, *extra).mapInPandas(run, "all int, v array<double>")
    row = sum_arrays(parts, ["all"], ["v"], [], salts=32).first()
    return np.zeros(size) if row is None else np.array(row["v"])


def _centres(df: DataFrame, features: list[str], ident: str, n: int, seed: int) -> np.ndarray:
    """``n`` rows with the smallest hashes: the same rows under any partitioning."""
    drawn = df.withColumn("__u", hash_uniform(F.col(ident), f"{seed}:centre")).orderBy("__u", ident).limit(n)
    return np.array([[float(r[f]) for f in features] for r in drawn.select(*features).collect()])


def weight_rulsif(
    df: DataFrame, batch: str, features: list[str], ident: str, *, alpha: float = 0.0, centres: int = 100,
    sigmas: tuple = (0.1, 10.0), lambdas: tuple = (0.1, 10.0), folds: int = 3, seed: int = 42,
) -> DataFrame:
    """Relative density ratio newest / rest as a ridge fit on kernels at newest-batch centres.

    All sums (second moments of the kernel values and their mean) come from one pass per sigma,
    kept per hash fold, so choosing sigma and lambda by held-out score costs no more passes.
    """
    newest = df.agg(F.max(batch)).first()[0]
    local = df.filter(F.col(batch) == F.lit(newest))
    c = _centres(local, features, ident, centres, seed)
    b = len(c)
    tagged = df.withColumn("__new", (F.col(batch) == F.lit(newest)).cast("int")).withColumn(
        "__fold", F.floor(hash_uniform(F.col(ident), f"{seed}:fold") * folds).cast("int"))
    block = b * b + b + 1  # second moments, sums, count; per side and fold
    best = None
    for sigma in sigmas:
        def collect(x, extra, sigma=sigma):
            out = np.zeros(2 * folds * block)
            k = _kernel(x, c, sigma)
            side, fold = extra["__new"].to_numpy(), extra["__fold"].to_numpy()
            for s in (0, 1):
                for f in range(folds):
                    m = k[(side == s) & (fold == f)]
                    at = (s * folds + f) * block
                    out[at : at + b * b] = (m.T @ m).ravel()
                    out[at + b * b : at + b * b + b] = m.sum(axis=0)
                    out[at + block - 1] = len(m)
            return out

        sums = _sum_over_rows(tagged, features, ["__new", "__fold"], 2 * folds * block, collect).reshape(2, folds, block)
        second, first, count = sums[:, :, : b * b].reshape(2, folds, b, b), sums[:, :, b * b : -1], sums[:, :, -1]

        def moments(keep):
            n_old, n_new = max(count[0, keep].sum(), 1), max(count[1, keep].sum(), 1)
            h2 = alpha * second[1, keep].sum(axis=0) / n_new + (1 - alpha) * second[0, keep].sum(axis=0) / n_old
            return h2, first[1, keep].sum(axis=0) / n_new

        for lam in lambdas:
            score = 0.0
            for f in range(folds):
                h2, h1 = moments([g for g in range(folds) if g != f] or [f])
                theta = np.linalg.solve(h2 + lam * np.eye(b), h1)
                t2, t1 = moments([f])
                score += 0.5 * theta @ t2 @ theta - t1 @ theta
            if best is None or score < best[0]:
                h2, h1 = moments(list(range(folds)))
                best = (score, sigma, np.linalg.solve(h2 + lam * np.eye(b), h1))
    _, sigma, theta = best
    return _kernel_weight(df, features, c, sigma, np.maximum(theta, 0.0))


def nonnegative_minimum(h: np.ndarray, c: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """The x >= 0 of least x'hx / 2 + c'x, by active sets (h positive definite)."""
    x, free = np.zeros(len(c)), np.zeros(len(c), bool)
    for _ in range(3 * len(c)):
        slope = np.where(free, -np.inf, -(h @ x + c))
        k = int(slope.argmax())
        if slope[k] <= tolerance:
            break
        free[k] = True
        while True:
            on = np.flatnonzero(free)
            goal = np.linalg.solve(h[np.ix_(on, on)], -c[on])
            if (goal > 0).all():
                x[on] = goal
                break
            down = goal <= 0
            step = (x[on][down] / np.maximum(x[on][down] - goal[down], 1e-300)).min()
            x[on] += step * (goal - x[on])
            free[on[x[on] <= 1e-15]] = False
            x[~free] = 0.0
    return x


class _Mixture:
    """One KLIEP fit: shares of kernels on the simplex, advanced by quadratic steps, or a multiplicative one where such a step fails.

    ``told`` takes what a pass found at ``share``: the number of rows, the sum of log ratios, the sums of
    kernel / ratio and of their products.  ``done`` once no share can gain more than ``tolerance``.
    """

    def __init__(self, usable: np.ndarray, tolerance: float):
        self.usable, self.tolerance, self.done = usable, tolerance, not usable.any()
        self.share = usable / max(usable.sum(), 1)
        self.at, self.best, self.gap, self.plain = None, np.inf, np.inf, False

    def told(self, n: float, logs: float, first: np.ndarray, second: np.ndarray) -> None:
        if self.done or not n:
            self.done = True
            return
        value = -logs / n
        if self.at is not None and value > self.best + 1e-12 and not self.plain:
            self.share, self.plain = self._normal(self.at * self.rise), True  # too far: the plain step never loses
            return
        self.at, self.best = self.share, value
        self.rise = np.where(self.usable, first / n, 0.0)
        self.gap = float(np.where(self.usable, self.rise - 1, -np.inf).max())
        if self.gap <= self.tolerance:
            self.done = True
            return
        on = np.flatnonzero(self.usable)
        h = second[np.ix_(on, on)] / n
        h = h + np.eye(len(on)) * 1e-8 * max(np.trace(h) / len(on), 1e-300)
        goal = np.zeros(len(self.share))
        goal[on] = nonnegative_minimum(h, 1 - self.rise[on] - h @ self.share[on])
        self.share, self.plain = self._normal(np.maximum(goal, 0.02 * self.at)), False  # no share vanishes at once

    @staticmethod
    def _normal(share: np.ndarray) -> np.ndarray:
        return share / share.sum()


def weight_kliep(
    df: DataFrame, batch: str, features: list[str], ident: str, *, sigmas: tuple = (0.01, 0.1, 0.25, 0.5, 0.75, 1.0), centres: tuple = (50, 100),
    folds: int = 3, tolerance: float = 1e-4, iterations: int = 200, seed: int = 42,
) -> DataFrame:
    """Ratio rest / newest as a non-negative kernel mixture maximising the mean log ratio (KLIEP).

    Kernel width (in standard deviations of each feature over the rows before the newest batch) and number of
    centres are those of the best mean log ratio on held-out hash folds.  The fits of all widths, numbers and
    folds, and those on all rows, advance together: one aggregate over the numerator rows per step.  A fit ends
    when its mean log ratio is provably within ``tolerance`` of the largest; ``iterations`` guards against
    more steps and raises.  Equal points of a fold are evaluated once, with their number.  Kernels are scaled to mean 1 over the newest batch, where the ratio then has mean 1.
    """
    newest = df.agg(F.max(batch)).first()[0]
    is_new = F.col(batch) == F.lit(newest)
    fold = F.floor(hash_uniform(F.col(ident), f"{seed}:fold") * folds).cast("int").alias("__fold")
    rest = materialize(df.filter(~is_new).select(ident, *features, fold), "kliep")
    c = _centres(rest, features, ident, max(centres), seed)
    if not len(c):
        return df.withColumn("weight", F.lit(1.0))
    spread = rest.agg(*[F.stddev_pop(F.col(f).cast("double")) for f in features]).first()
    scale = np.array([s if s else 1.0 for s in spread])
    c, b, widths = c / scale, len(c), list(sigmas)

    def kernels(x):
        gap = ((x / scale)[:, None, :] - c[None]) ** 2
        return [np.exp(-gap.sum(axis=2) / (2 * s * s)) for s in widths]

    blocks = lambda x: [x[i : i + 4096] for i in range(0, len(x), 4096)]
    times = F.count(F.lit(1)).cast("double").alias("__times")
    points = materialize(rest.groupBy(*features, "__fold").agg(times), "kliep-points")

    def totals(x, extra):
        n = extra["__times"].to_numpy()
        return np.append(sum(np.concatenate([w @ k for k in kernels(part)]) for part, w in zip(blocks(x), blocks(n))), n.sum())

    mean = _sum_over_rows(df.filter(is_new).groupBy(*features).agg(times), features, ["__times"], len(widths) * b + 1, totals)
    mean = mean[:-1].reshape(-1, b) / max(mean[-1], 1)
    counts = sorted({min(n, b) for n in centres})
    fits = {(w, n, f): _Mixture((mean[w] > 1e-12) & (np.arange(b) < n), tolerance) for w in range(len(widths)) for n in counts for f in [*range(folds), None]}
    kept: dict[tuple, float] = {}
    for _ in range(iterations):
        active = [key for key, fit in fits.items() if not fit.done]
        if not active:
            break
        shares = {key: fits[key].share for key in active}
        size = 3 + b + b * b  # rows, logs, logs held out, first and second sums

        def collect(x, extra, active=active, shares=shares, size=size):
            out = np.zeros((len(active), size))
            which, n = extra["__fold"].to_numpy(), extra["__times"].to_numpy()
            for at, part in zip(range(0, len(x), 4096), blocks(x)):
                k = [g / np.where(m > 1e-12, m, np.inf) for g, m in zip(kernels(part), mean)]
                inside, w = which[at : at + 4096], n[at : at + 4096]
                for i, key in enumerate(active):
                    phi = k[key[0]]
                    ratio = np.maximum(phi @ shares[key], 1e-300)
                    mine = np.ones(len(part), bool) if key[2] is None else inside != key[2]
                    scaled, many = phi[mine] / ratio[mine, None], w[mine]
                    logs = np.log(ratio) * w
                    out[i] += np.concatenate([[many.sum(), logs[mine].sum(), logs[~mine].sum()], many @ scaled, (scaled.T @ (scaled * many[:, None])).ravel()])
            return out.ravel()

        found = _sum_over_rows(points, features, ["__fold", "__times"], len(active) * size, collect).reshape(len(active), size)
        for key, row in zip(active, found):
            before = fits[key].at
            fits[key].told(row[0], row[1], row[3 : 3 + b], row[3 + b :].reshape(b, b))
            if fits[key].at is not before:
                kept[key] = row[2]  # held-out score of the accepted shares
    if any(not fit.done for fit in fits.values()):
        raise ArithmeticError(f"no convergence in {iterations} steps")
    score = {(w, n): sum(kept.get((w, n, f), -np.inf) for f in range(folds)) if fits[w, n, None].usable.any() else -np.inf for w in range(len(widths)) for n in counts}
    w, n = max(score, key=lambda key: (score[key], -key[0], -key[1]))
    theta = np.where(mean[w] > 1e-12, fits[w, n, None].share / np.where(mean[w] > 1e-12, mean[w], 1.0), 0.0)
    return _kernel_weight(df, features, c * scale, widths[w], theta, scale)


def _kernel_weight(df: DataFrame, features: list[str], centres: np.ndarray, sigma: float, theta: np.ndarray, scale: np.ndarray | float = 1.0) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("weight", T.DoubleType())])

    def run(frames):
        for f in frames:
            if len(f):
                yield f.assign(weight=_kernel(f[features].to_numpy(dtype=float) / scale, centres / scale, sigma) @ theta)

    return df.mapInPandas(run, schema)


# --- using weights --------------------------------------------------------------------------------


def importance_resample(df: DataFrame, weight: str, seq: str, *, size: int, replicas: int = 10, seed: int = 42) -> DataFrame:
    """``replicas`` samples of ``size`` rows drawn with replacement in proportion to weight.

    Rows own consecutive intervals of the cumulative weight; a draw belongs to the last interval
    starting at or before it.  Rows and draws meet in one two-level scan over the interval axis.
    """
    positive = df.filter(F.col(weight) > 0)
    head = positive.agg(F.sum(weight).alias("w"), F.count("*").alias("n")).first()
    total, ticks = head["w"], 1 << 52
    blocks = max(512, head["n"] // 500_000)  # of equal weight mass, so their row count stays bounded on average
    cum = running(positive, [], seq, {"__before": ("sum", F.col(weight).cast("double"))}, exclusive=True)
    marks = cum.withColumn("__at", F.floor(F.col("__before") / F.lit(float(total)) * F.lit(float(ticks))).cast("bigint") * 2).select(
        "__at", F.struct(*[F.col(c) for c in df.columns]).alias("__row"))
    u = hash_uniform(F.col("id"), f"{seed}:draw")
    draws = df.sparkSession.range(size * replicas).select(
        (F.floor(u * F.lit(float(ticks))).cast("bigint") * 2 + 1).alias("__at"),
        F.expr(f"cast(id div {size} as int)").alias("replica"), F.expr(f"cast(id % {size} as int)").alias("draw"))
    both = draws.unionByName(marks, allowMissingColumns=True)
    run = running(both, [], "__at", {"__last": ("last", F.col("__row"))}, span=ticks // blocks)
    return run.filter(F.col("draw").isNotNull()).select("replica", "draw", "__last.*")


def weighted_refit(df: DataFrame, features: list[str], label: str, classes: list[int], weight: str) -> dict[str, float]:
    """Naive Bayes fitted with importance weights; plain when the weights carry no mass."""
    usable = df.agg(F.sum(weight), F.count_if(F.col(weight).isNull() | F.isnan(weight) | (F.col(weight) < 0))).first()
    if not usable[0] or usable[1]:
        return nb.fit_nb(df, features, label, classes)
    return nb.fit_nb(df, features, label, classes, weight=weight)


def resampled_bag(df: DataFrame, test: DataFrame, weight: str, seq: str, features: list[str], label: str, classes: list[int], *,
                  size: int = 200, replicas: int = 10, seed: int = 42) -> DataFrame:
    """Mean class probability of one naive Bayes per replica."""
    sample = importance_resample(df, weight, seq, size=size, replicas=replicas, seed=seed)
    models = nb.parameters(nb.nb_stats(sample, ["replica"], features, label, classes), len(features), classes).collect()
    out = test
    for m in models:  # one literal model per replica; ``replicas`` is a small parameter
        out = nb.predict_nb(out, {k: v for k, v in m.asDict().items() if k != "replica"}, features, classes, pred="__y", proba=f"__p{m['replica']}").drop("__y")
    names = [f"__p{m['replica']}" for m in models]
    mean = [sum((F.get(F.col(n), F.lit(i)) for n in names), F.lit(0.0)) / len(names) for i in range(len(classes))]
    return out.withColumn("proba", F.array(*mean)).drop(*names)
