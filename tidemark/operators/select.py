"""Label-query rules over a scored table: which rows are worth asking a label for.

Rules of one row or chunk also take a chunk that a task holds (a pandas frame whose ``proba`` are arrays) and then
give the frame with ``is_queried``, as they do for a table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import argmax_first, range_margin
from tidemark.functions.hashing import hash_uniform
from tidemark.plans.keyed import Machine, keyed_resume, keyed_scan
from tidemark.plans.scan import over_last, running, with_seq


def label_budget_estimate(df: DataFrame, keys: list[str], order: str, is_label: str, window: int = 200) -> DataFrame:
    """Recent label spend: v_hat = (labels in the last ``window`` rows) * (w - 1) / w + current; spend = v_hat / w."""
    numbered = with_seq(df, keys, order, name="__rn")
    lately = over_last(numbered, keys, window, {"__v": (F.sum(is_label), window - 1, 0)}, seq="__rn")
    v_hat = F.col("__v") * F.lit(float(window - 1)) / F.lit(float(window)) + F.col(is_label)
    return lately.withColumn("v_hat", v_hat).withColumn("spend", F.col("v_hat") / F.lit(float(window))).drop("__rn", "__v")


def running_class_counts(df: DataFrame, keys: list[str], order: str, label: str, labelled: Column, classes: list[int]) -> DataFrame:
    """Labelled rows of each class strictly before each row, as columns n_0, n_1, ..."""
    return running(
        df, keys, order,
        {f"n_{c}": ("sum", F.when(labelled & (F.col(label) == c), 1).otherwise(0).cast("bigint")) for c in classes}, exclusive=True)


# --- rules that look at one row -------------------------------------------------------------------


def query_hashed(df: DataFrame | pd.DataFrame, ident: str, salt: str, ratio: float) -> DataFrame | pd.DataFrame:
    """Ask for the rows whose hashed draw is under ``ratio``."""
    if isinstance(df, pd.DataFrame):
        return df.assign(is_queried=_asked(draws(df[ident], salt), ratio))
    return df.withColumn("is_queried", hash_uniform(F.col(ident), salt) < ratio)


def query_random(df: DataFrame | pd.DataFrame, ident: str, ratio: float, seed: int = 42) -> DataFrame | pd.DataFrame:
    """Ask for a hashed share of rows."""
    return query_hashed(df, ident, f"{seed}:query", ratio)


def query_all(df: DataFrame | pd.DataFrame) -> DataFrame | pd.DataFrame:
    """Ask for every label: plain supervised learning."""
    if isinstance(df, pd.DataFrame):
        return df.assign(is_queried=pd.array([True] * len(df), dtype="boolean"))
    return df.withColumn("is_queried", F.lit(True))


def query_margin_fixed(df: DataFrame | pd.DataFrame, proba: str, theta: float = 0.5) -> DataFrame | pd.DataFrame:
    """Ask when the largest and smallest class probability are closer than ``theta``."""
    if isinstance(df, pd.DataFrame):
        return df.assign(is_queried=_asked(margins(df[proba]), theta))
    return df.withColumn("is_queried", range_margin(F.col(proba)) < theta)


def query_least_sure(
    df: DataFrame | pd.DataFrame, keys: list[str], proba: str, order: str, size: int, digits: int | None = None
) -> DataFrame | pd.DataFrame:
    """Ask for the ``size`` rows of each chunk with the smallest margin (to ``digits`` places); a task holds one chunk."""
    if isinstance(df, pd.DataFrame):
        margin = margins(df[proba])
        ranked = df.assign(__m=margin if digits is None else np.round(margin, digits)).sort_values(["__m", order], na_position="first", kind="stable")
        best = ranked[[order]].head(size).dropna().assign(is_queried=True)
        out = df.reset_index().merge(best, on=order, how="left").set_index("index")
        return out.assign(is_queried=out["is_queried"].astype("boolean").fillna(False))
    margin = range_margin(F.col(proba))
    ranked = query_topk_per_chunk(df.withColumn("__m", margin if digits is None else F.round(margin, digits)), keys, "__m", order, size)
    return df.join(ranked.select(order, F.lit(True).alias("is_queried")), order, "left").withColumn("is_queried", F.coalesce("is_queried", F.lit(False)))


def margins(proba: pd.Series) -> np.ndarray:
    """Largest minus smallest probability of each row of a frame; nan where one is missing."""
    p = np.stack(proba.to_numpy()) if len(proba) else np.zeros((0, 1))
    return p.max(axis=1) - p.min(axis=1)


def draws(ident: pd.Series, salt: str) -> np.ndarray:
    """``hash_uniform`` of a frame's column of strings or whole numbers; nan where there is none."""
    text = lambda v: v if isinstance(v, str) else str(int(v))
    return np.array([np.nan if pd.isna(v) else int(hashlib.md5(f"{text(v)}:{salt}".encode()).hexdigest()[:8], 16) / 4294967296.0 for v in ident], float)


def _asked(value: np.ndarray, limit: float) -> pd.api.extensions.ExtensionArray:
    """value < limit, missing where the value is."""
    out = pd.array(value < limit, dtype="boolean")
    out[np.isnan(value)] = pd.NA
    return out


def class_shares(members: DataFrame, sigma: float, n_classes: int) -> DataFrame:
    """Weighted class share over ensemble members and the query rate it implies per class.

    ``members`` has (class, h, w): how many rows of the class each member saw, and its weight.
    share = sum(h * w) / total; rate = max(sigma / (share * L), sigma), or 1 where the share is 0.
    """
    g = members.groupBy("class").agg(F.sum(F.col("h") * F.col("w")).alias("__hw"))
    total = g.agg(F.sum("__hw")).first()[0]  # one number
    share = F.col("__hw") / F.lit(float(total or 1.0))
    return g.select("class", share.alias("share")).withColumn(
        "rate", F.when(F.col("share") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(sigma) / (F.col("share") * n_classes), F.lit(sigma))))


def query_imbalance(df: DataFrame, rates: DataFrame, proba: str, ident: str, seed: int = 42) -> DataFrame:
    """Ask with a probability that depends on the predicted class (``rates`` has one row per class)."""
    scored = df.withColumn("class", argmax_first(F.col(proba)))
    return scored.join(rates.select("class", "rate"), "class", "left").withColumn(
        "is_queried", hash_uniform(F.col(ident), f"{seed}:imbalance") < F.col("rate"))


def query_topk_per_chunk(df: DataFrame, keys: list[str], score: str, order: str, size: int) -> DataFrame:
    """The ``size`` rows of lowest score in each chunk.

    A per-task top-k runs first, so a chunk that holds much of the table reaches its ranking
    window as at most ``size`` rows per task.
    """
    first = _local_rank(df, keys, score, order, size)
    w = Window.partitionBy(*keys).orderBy(score, order)
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size)


def _local_rank(df: DataFrame, keys: list[str], score: str, order: str, size: int) -> DataFrame:
    """The rows of lowest score in each of as many slots as the session has shuffle partitions."""
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64(order), F.lit(slots))
    w = Window.partitionBy(*keys, "__slot").orderBy(score, order)
    return df.withColumn("__slot", slot).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= size).drop("__slot", "__r")


def recent_per_class(df: DataFrame, keys: list[str], label: str, order: str, n: int) -> DataFrame:
    """Replay buffer: the newest ``n`` rows of each class, by a salted then a final ranking."""
    by = [*keys, label]
    neg = df.withColumn("__neg", -F.col(order))
    first = _local_rank(neg, by, "__neg", order, n)
    w = Window.partitionBy(*by).orderBy("__neg")
    return first.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n).drop("__neg")


def replay_union(sample: DataFrame, buffer: DataFrame, ident: list[str]) -> DataFrame:
    """A new sample plus the buffered rows it does not already hold."""
    extra = buffer.join(sample.select(*ident), ident, "left_anti")
    return sample.unionByName(extra.select(*sample.columns))


def already_labelled(rows: DataFrame, labelled: DataFrame, ident: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows labelled before, rows still to label)."""
    known = labelled.select(*ident).distinct()
    return rows.join(known, ident, "left_semi"), rows.join(known, ident, "left_anti")


def weakest_member(members: DataFrame, by: list[str]) -> DataFrame:
    """Member of least weight per group; ties go to the lower id."""
    return members.groupBy(*by).agg(F.min(F.struct("weight", "member")).alias("m")).select(*by, F.col("m.member").alias("member"), F.col("m.weight").alias("weight"))


def newest_members(members: DataFrame, by: list[str], age: str, keep: int) -> DataFrame:
    """First-in-first-out eviction: the ``keep`` newest members per group."""
    w = Window.partitionBy(*by).orderBy(F.col(age).desc())
    return members.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= keep).drop("__r")


# --- rules that remember earlier answers ----------------------------------------------------------


class _Rule(Machine):
    """A rule that decides row by row; subclasses implement ``decide``."""

    outputs = (("is_queried", "boolean"), ("threshold", "double"))

    def feed(self, state, cols):
        n = len(cols[self.inputs[0]])
        asked, thresholds = np.zeros(n, dtype=bool), np.zeros(n)
        rows = list(zip(*[c.tolist() if c.dtype != object else c for c in (cols[i] for i in self.inputs)]))
        for i, row in enumerate(rows):
            state, asked[i], thresholds[i] = self.decide(state, *row)
        return state, {"row": np.arange(n), "is_queried": asked, "threshold": thresholds}


class MarginVariable(_Rule):
    """Asks when the margin is under a threshold that shrinks on each question and grows otherwise."""

    inputs = ("margin",)

    def __init__(self, theta: float = 0.5, step: float = 0.01):
        self.theta, self.step = theta, step

    def start(self):
        return self.theta

    def decide(self, theta, margin):
        ask = margin < theta
        return theta * (1 - self.step if ask else 1 + self.step), ask, theta


class MarginOrRandom(_Rule):
    """Asks when the top-two margin is at most a threshold that shrinks on such questions, else at random.

    The threshold starts at 2 * theta / classes; with ``period`` it returns there every so many rows.
    """

    inputs = ("margin", "draw")

    def __init__(self, theta: float = 0.4, n_classes: int = 2, step: float = 0.01, sigma: float = 0.01, period: int | None = None):
        self.first, self.step, self.sigma, self.period = 2 * theta / n_classes, step, sigma, period

    def start(self):
        return (self.first, 0)

    def decide(self, state, margin, draw):
        theta, n = state
        ask = margin <= theta
        after = theta * (1 - self.step) if ask else theta
        n += 1
        if self.period and n % self.period == 0:
            after = self.first
        return (after, n), ask or draw <= self.sigma, theta


class Budget(_Rule):
    """Lets a wanted question through while labels / rows so far does not exceed ``ratio``."""

    inputs = ("wanted",)

    def __init__(self, ratio: float):
        self.ratio = ratio

    def start(self):
        return (0, 0)

    def decide(self, state, wanted):
        seen, asked = state
        spend = asked / seen if seen else 0.0
        ask = bool(wanted) and spend <= self.ratio
        return (seen + 1, asked + ask), ask, spend


class Submodular(_Rule):
    """Asks when the expected gain of a concave coverage of classes exceeds ``gamma``."""

    inputs = ("proba", "label")

    def __init__(self, n_classes: int, kappa: float = 2.0, gamma: float = 0.3):
        self.n_classes, self.kappa, self.gamma = n_classes, kappa, gamma

    def start(self):
        return [0] * self.n_classes

    def gain(self, counts, proba):
        lo, hi = min(proba), max(proba)
        scaled = [(p - lo) / (hi - lo + 1e-10) for p in proba]
        total = sum(scaled)
        r = 1 / self.kappa
        return sum((s / total if total else 0.0) * ((n + 1) ** r - n**r) for s, n in zip(scaled, counts))

    def decide(self, counts, proba, label):
        gain = self.gain(counts, proba)
        ask = gain > self.gamma
        if ask:
            counts = list(counts)
            counts[int(label)] += 1
        return counts, ask, gain


class SubmodularDynamic(Submodular):
    """Submodular rule whose threshold falls as classes fill up, with a forced question after a long quiet.

    After each answer, when the Jensen-Shannon divergence between the answer and the normalised
    prediction exceeds 0.1, gamma falls by alpha / kappa * (n + 1)^(1 / kappa - 1) down to a floor.
    A question forced by ``quiet`` skipped rows lets gamma restart from the class's own threshold,
    clears the counts and marks a refit from memory.
    """

    outputs = (("is_queried", "boolean"), ("threshold", "double"), ("is_refit", "boolean"))

    # fixed values: fall rate, floor, divergence limit, class threshold after a refit
    ALPHA, FLOOR, LIMIT, RESTART = 0.10, 0.15, 0.10, 0.40

    def __init__(self, n_classes: int, kappa: float = 2.0, gamma: float = 0.4, quiet: int = 20):
        super().__init__(n_classes, kappa, gamma)
        self.quiet = quiet

    def start(self):
        return dict(counts=[0] * self.n_classes, gamma=self.gamma, own=[self.gamma] * self.n_classes, skipped=0)

    def divergence(self, proba, label):
        lo, hi = min(proba), max(proba)
        scaled = [(p - lo) / (hi - lo + 1e-10) for p in proba]
        total = sum(scaled) or 1.0
        q = [s / total for s in scaled]
        p = [1.0 if i == label else 0.0 for i in range(len(q))]
        mid = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda a: sum(x * math.log(x / m) for x, m in zip(a, mid) if x > 0)
        return 0.5 * kl(p) + 0.5 * kl(q)

    def feed(self, state, cols):
        n = len(cols["label"])
        asked, refit, gammas = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)
        s = dict(state, counts=list(state["counts"]), own=list(state["own"]))
        for i, (proba, y) in enumerate(zip(cols["proba"], cols["label"].tolist())):
            forced = s["skipped"] == self.quiet
            gammas[i] = s["gamma"]
            if not forced and self.gain(s["counts"], proba) <= s["gamma"]:
                s["skipped"] += 1
                continue
            asked[i], y = True, int(y)
            s["counts"][y] += 1
            apart = self.divergence(proba, y)
            fall = self.ALPHA / self.kappa * (s["counts"][y] + 1) ** (1 / self.kappa - 1)
            if apart > self.LIMIT:
                s["gamma"] = max(s["gamma"] - fall, self.FLOOR)
            s["own"][y] = max(s["own"][y] - fall, self.FLOOR)
            if forced:
                refit[i] = True
                s["gamma"] = (1 - apart / 2) * s["own"][y] if s["gamma"] > self.FLOOR else self.FLOOR
                s["counts"], s["own"] = [0] * self.n_classes, [self.RESTART] * self.n_classes
            s["skipped"] = 0
        return s, {"row": np.arange(n), "is_queried": asked, "threshold": gammas, "is_refit": refit}


class Cognitive(Machine):
    """Budget, local density and uncertainty together, over a small forgetting memory.

    A memory point is recalled when the new row becomes its nearest neighbour; the density of a row is
    the number of points it recalls.  Strength is exp(-t / (recalls + 1)), t rows since the last
    recall; a full memory drops its weakest point.  A row is asked when recent spend is under
    ``budget``, its density is at least ``density``, and its top probability is under a threshold that
    moves by ``step`` with each decision (or stays with ``adaptive=False``).
    """

    inputs = ("features", "top")
    outputs = (("is_queried", "boolean"), ("threshold", "double"), ("density", "int"), ("spend", "double"))

    def __init__(self, budget: float = 0.25, density: int = 1, n_classes: int = 3, memory: int = 10, window: int = 200,
                 step: float = 0.01, adaptive: bool = True):
        self.budget, self.density, self.memory, self.window, self.step, self.adaptive = budget, density, memory, window, step, adaptive
        self.first = 1 / n_classes + budget * (1 - 1 / n_classes)

    def start(self):
        return dict(points=[], i=0, u=self.first, spend=0.0, recent=[])

    def feed(self, state, cols):
        s = dict(state, points=[list(p) for p in state["points"]], recent=list(state["recent"]))
        n = len(cols["top"])
        out = {"row": np.arange(n), "is_queried": np.zeros(n, bool), "threshold": np.zeros(n), "density": np.zeros(n, np.int32), "spend": np.zeros(n)}
        for i, (x, top) in enumerate(zip(cols["features"], cols["top"].tolist())):
            s["i"] += 1
            density = self._recall(s, np.asarray(x, dtype=float))
            ask = False
            out["threshold"][i], out["density"][i], out["spend"][i] = s["u"], density, s["spend"]
            if s["spend"] < self.budget and density >= self.density:
                ask = top < s["u"]
                if self.adaptive:
                    s["u"] *= 1 - self.step if ask else 1 + self.step
            s["recent"] = [*s["recent"], int(ask)][-self.window :]
            s["spend"] = (sum(s["recent"]) * (self.window - 1) / self.window + ask) / self.window
            out["is_queried"][i] = ask
        return s, out

    def _recall(self, s, x):
        """Update the memory with a new point; a point is [x, recalls, last recall, nearest distance]."""
        nearest, density = math.inf, 0
        for p in s["points"]:
            d = float(np.sqrt(((p[0] - x) ** 2).sum()))
            if d < p[3]:
                p[1:] = [p[1] + 1, s["i"], d]
                density += 1
            nearest = min(nearest, d)
        fresh = [x, 0, s["i"], nearest]
        if len(s["points"]) > self.memory:
            strength = [math.exp(-(s["i"] - p[2]) / (p[1] + 1)) for p in s["points"]]
            s["points"][int(np.argmin(strength))] = fresh
        else:
            s["points"].append(fresh)
        return density


def query_keyed(df: DataFrame, keys: list[str], order: str, rule: Machine, inputs: dict[str, Column], keep: tuple[str, ...] = (), **scan) -> DataFrame:
    """Run a remembering rule per key; ``inputs`` names the columns the rule reads."""
    return keyed_scan(df.withColumns(inputs), keys, order, rule, keep=keep, **scan)


def query_resumed(
    df: DataFrame, keys: list[str], order: str, rule: Machine, inputs: dict[str, Column], states: DataFrame | None, keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """``query_keyed`` over the next part of a stream: (rows, what the rule remembers of each key)."""
    return keyed_resume(df.withColumns(inputs), keys, order, rule, states, keep=keep)
