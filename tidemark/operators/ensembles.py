"""Ensembles whose members are keys (bagging) or chunks (weighted ensembles).

All bagged members of a key are one state of stacked arrays, so a key's rows are read once for all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.bayes import Sums, joint_of_row, shares
from tidemark.functions.hashing import hash_poisson
from tidemark.functions.numeric import splitmix_uniform
from tidemark.operators import naive_bayes as nb
from tidemark.operators.detect import Ddm
from tidemark.operators.resample import online_bagging_weights, underbag
from tidemark.plans.blocks import fold_blocks, stream_past, sum_arrays
from tidemark.plans.chunks import lagged_prefix, score_join
from tidemark.plans.keyed import Machine, keyed_scan


class DdmBank:
    """The error-rate detector of many members at once; a run of rows costs a few array operations."""

    def __init__(self, ddm: Ddm, members: int):
        self.ddm, self.members = ddm, members

    def start(self) -> np.ndarray:
        return np.tile(np.array(self.ddm.start(), float)[:, None], self.members)  # n, errors, lowest p + s, its p, its s

    def feed(self, state: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state, changed, warned) after the errors (members x rows)."""
        n0, err0, low, low_p, low_s = state
        n = n0[:, None] + np.arange(1, wrong.shape[1] + 1)
        p = (err0[:, None] + np.cumsum(wrong, axis=1)) / n
        s = np.sqrt(p * (1 - p) / n)
        level, ready = p + s, n + 1 >= self.ddm.min_n
        lowest = np.minimum(np.minimum.accumulate(np.where(ready, level, np.inf), axis=1), low[:, None])
        where = np.maximum.accumulate(np.where(ready & (level <= lowest), np.arange(wrong.shape[1]), -1), axis=1)
        at = np.maximum(where, 0)
        best_p = np.where(where >= 0, np.take_along_axis(p, at, axis=1), low_p[:, None])
        best_s = np.where(where >= 0, np.take_along_axis(s, at, axis=1), low_s[:, None])
        with np.errstate(invalid="ignore"):
            change = ready & (level > best_p + self.ddm.out * best_s)
            warn = ready & ~change & (level > best_p + self.ddm.warning * best_s)
        stop = (change if self.ddm.reset_on == "change" else warn).any(axis=1)
        state = np.stack([n[:, -1], err0 + wrong.sum(axis=1), lowest[:, -1], best_p[:, -1], best_s[:, -1]])
        changed, warned = change.any(axis=1), warn.any(axis=1)
        for m in np.flatnonzero(stop):  # a restart inside the run: this member goes row by row
            own, alarms = self.ddm.feed((int(n0[m]), *map(float, (err0[m], low[m], low_p[m], low_s[m]))), {"x": wrong[m]})
            state[:, m], changed[m], warned[m] = own, "change" in alarms["kind"], "warning" in alarms["kind"]
        return state, changed, warned


class MachineBank:
    """Any detector, one after the other."""

    def __init__(self, detector: Machine, members: int):
        self.detector, self.members = detector, members

    def start(self) -> list:
        return [self.detector.start() for _ in range(self.members)]

    def feed(self, state: list, wrong: np.ndarray):
        out = [self.detector.feed(s, {"x": w}) for s, w in zip(state, wrong)]
        kinds = [a["kind"] for _, a in out]
        return [s for s, _ in out], np.array(["change" in k for k in kinds]), np.array(["warning" in k for k in kinds])


class Bag(Machine):
    """All naive Bayes members of one key: they predict, learn at chunk ends, and swap models on drift.

    A warning starts a background model; a change replaces the live model by the background one (or an empty one)
    at the chunk end.  Votes weigh the accuracy since the last swap.  Members are the leading axis of every array.
    """

    inputs = ("features", "label", "weights")
    outputs = (("y_pred", "int"), ("swaps", "int"))

    def __init__(self, n_classes: int, members: int, chunk: int = 50, subspaces: dict[int, list[int]] | None = None, detector: Machine | None = None):
        self.n_classes, self.members, self.chunk, self.subspaces = n_classes, members, chunk, subspaces
        detector = detector or Ddm()
        self.bank = DdmBank(detector, members) if type(detector) is Ddm else MachineBank(detector, members)

    def start(self):
        none = np.zeros(self.members)
        return dict(live=None, model=None, watch=self.bank.start(), rows=0, hits=none, seen=none, swaps=none.astype(int), changed=none > 0, warned=none > 0, old=none > 0)

    def _model(self, live: np.ndarray, mask: np.ndarray):
        """Constants, means and variances (members x classes [x features]) of sums (3 x members x classes x features)."""
        count, total, square = live
        n, all_ = count[..., :1], count[..., 0].sum(axis=1)[:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(n > 0, total / n, 0.0)
            var = np.where(n > 0, np.maximum(square / n - mean * mean, 0.0), 1.0)
            whole = square.sum(axis=1) / all_[:, 0] - (total.sum(axis=1) / all_[:, 0]) ** 2
            eps = np.maximum(np.nan_to_num(np.where(mask, whole, -np.inf), nan=0.0).max(axis=1) * 1e-9, 1e-9)
            var = var + eps[:, None, None]
            const = np.log(n[..., 0] / all_[..., 0]) - 0.5 * (np.log(2 * np.pi * var) * mask[:, None]).sum(axis=2)
        return np.where(n[..., 0] > 0, const, -np.inf), mean, mask[:, None] / var

    def feed(self, state, cols):
        s = dict(state)
        x_all, y_all, w_all = np.stack(cols["features"]).astype(float), cols["label"].astype(int), np.stack(cols["weights"]).astype(float)
        n, d = len(y_all), x_all.shape[1]
        mask = np.ones((self.members, d))
        if self.subspaces:
            mask = np.array([np.isin(np.arange(d), self.subspaces[m]) for m in range(self.members)]).astype(float)
        if s["live"] is None:
            empty = np.zeros((3, self.members, self.n_classes, d))
            s.update(live=empty, pending=empty, background=empty, model=self._model(empty, mask))
        pred, swaps, at = np.zeros(n, np.int32), np.zeros(n, np.int32), 0
        while at < n:
            hi = min(n, at + self.chunk - s["rows"])
            x, y, w = x_all[at:hi], y_all[at:hi], w_all[at:hi].T
            const, mean, weight = s["model"]
            gap = x[None, :, None] - mean[:, None]
            guess = (const[:, None] - 0.5 * (gap * gap * weight[:, None]).sum(axis=3)).argmax(axis=2)
            vote = np.divide(s["hits"], s["seen"], out=np.ones(self.members), where=s["seen"] > 0)
            score = np.stack([vote @ (guess == c) for c in range(self.n_classes)])
            pred[at:hi], swaps[at:hi] = score.argmax(axis=0), s["swaps"].sum()
            wrong = guess != y
            s["watch"], changed, warned = self.bank.feed(s["watch"], wrong.astype(float))
            s["changed"], s["warned"] = s["changed"] | changed, s["warned"] | warned
            s["hits"], s["seen"] = s["hits"] + (~wrong).sum(axis=1), s["seen"] + len(y)
            hot = np.stack([w * (y == c) for c in range(self.n_classes)], axis=1)  # members x classes x rows
            s["pending"] = s["pending"] + np.stack([np.broadcast_to(hot.sum(axis=2)[..., None], (*hot.shape[:2], d)), hot @ x, hot @ (x * x)])
            s["rows"] += hi - at
            if s["rows"] == self.chunk:
                self._close(s, mask)
            at = hi
        return s, {"row": np.arange(n), "y_pred": pred, "swaps": swaps}

    def _close(self, s, mask):
        pick = lambda flag: flag[None, :, None, None]
        live, behind = s["live"] + s["pending"], s["background"] + s["pending"] * pick(s["old"])
        changed = s["changed"]
        begins = s["warned"] & ~changed & ~s["old"]
        live = np.where(pick(changed), behind * pick(s["old"]), live)
        behind = np.where(pick(begins), s["pending"], behind * pick(~changed))
        none = np.zeros(self.members)
        s.update(live=live, background=behind, old=(s["old"] & ~changed) | begins, hits=np.where(changed, 0, s["hits"]), seen=np.where(changed, 0, s["seen"]),
                 swaps=s["swaps"] + changed, pending=np.zeros_like(live), rows=0, changed=none > 0, warned=none > 0, model=self._model(live, mask))


def bagged_stream(
    df: DataFrame, keys: list[str], order: str, features: list[str], label: str, n_classes: int, *, members: int = 10, lam: float = 6.0,
    chunk: int = 50, subspaces: dict[int, list[int]] | None = None, detector: Machine | None = None, seed: int = 42, **scan,
) -> DataFrame:
    """Test-then-train predictions of a drift-aware bag; with ``subspaces`` each member sees its own features.

    Rows are shuffled once by key, with one short array of Poisson weights; the members vote where they predict.
    """
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in [*keys, order]])
    weights = F.array(*[hash_poisson(ident, F.lit(f"{seed}:bag{m}"), lam).cast("double") for m in range(members)])
    rows = df.select(*keys, order, F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.col(label).alias("label"), weights.alias("weights"))
    scored = keyed_scan(rows, keys, order, Bag(n_classes, members, chunk, subspaces, detector), keep=("label",), **scan)
    return scored.select(*keys, order, F.col("label").alias("y_true"), "y_pred", "swaps")


def bagged_nb(
    df: DataFrame, keys: list[str], chunk: str, ident: str, features: list[str], label: str, classes: list[int], *, members: int = 10,
    scheme: str = "online", order: str | None = None, seed: int = 42,
) -> DataFrame:
    """Chunk t predicted by the majority of members trained on Poisson-weighted earlier chunks.

    Everything is additive: member sums combine before the shuffle, and all members' models of a chunk
    sit in one row, so rows are neither copied nor shuffled to be scored.
    """
    d = len(features)
    weighted = online_bagging_weights(
        df.select(*dict.fromkeys([*keys, chunk, ident, *([order] if order else []), *features, label])), ident, members, scheme,
        label=label, keys=keys, order=order, seed=seed)
    stats = nb.nb_stats(weighted.filter("weight > 0"), [*keys, chunk, "member"], features, label, classes, weight="weight")
    sums = lagged_prefix(stats, [*keys, "member"], chunk, nb.stat_names(d, classes))
    params = nb.parameters(sums, d, classes)
    names = nb.parameter_names(d, classes)
    wide = params.groupBy(*keys, chunk).agg(*[
        F.expr(f"max(CASE WHEN member = {m} THEN `{n}` END) AS `m{m}_{n}`") for m in range(members) for n in names])
    out = score_join(df, wide, [*keys, chunk])
    for m in range(members):
        out = nb.apply(out, features, classes, prefix=f"m{m}_", pred=f"__p{m}")
    votes = ", ".join(" + ".join(f"int(__p{m} = {c})" for m in range(members)) for c in classes)
    ids = ", ".join(str(c) for c in classes)
    picked = out.selectExpr("*", f"array({votes}) AS __v").selectExpr("*", f"array({ids})[int(array_position(__v, array_max(__v))) - 1] AS y_pred")
    return picked.drop("__v", *[f"__p{m}" for m in range(members)])


# --- chunk-weighted ensemble ----------------------------------------------------------------------


def chunk_weighted_ensemble(
    df: DataFrame, chunk: str, ident: str, features: list[str], label: str, *, members: int = 10, theta: float = 0.1, bags: int = 11, seed: int = 42, salts: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, weights): each chunk adds an under-bagged naive Bayes member; later chunks weigh it.

    A member's weight starts at 1 and is multiplied by its G-mean on every chunk since its own; under
    ``theta`` it is out, as it is after ``members`` newer chunks.  A chunk is predicted by the sign of
    the weighted votes of the members before it.  Rows meet members by an equi-join on the member's
    chunk, one copy per possible age, and pass by the packed member instead of carrying it.  ``salts``
    splits chunks that are not of fixed size.
    """
    d = len(features)
    rows = df.select(F.col(chunk).cast("bigint").alias("__chunk"), F.col(ident).alias("__id"), F.array(*[F.col(f).cast("double") for f in features]).alias("__x"),
                     F.col(label).cast("int").alias("__y"))
    bagged = underbag(rows, ["__chunk"], "__y", "__id", bags=bags, auto=True, seed=seed)
    schema = T.StructType([T.StructField("__chunk", T.LongType()), T.StructField("bag", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def add(acc, part):
        return acc + Sums.of(np.stack(part["__x"].to_numpy()).astype(float), part["__y"].to_numpy(), 2)

    stats = fold_blocks(bagged.select("__chunk", "bag", "__x", "__y"), ["__chunk", "bag"], lambda: Sums.zeros(2, d), add,
                        lambda a: {"sums": np.concatenate([a.n, a.s.ravel(), a.q.ravel()])}, schema, salts=salts)
    if salts > 1:
        stats = sum_arrays(stats, ["__chunk", "bag"], ["sums"], [])
    packed = stats.groupBy("__chunk").agg(F.array_sort(F.collect_list(F.struct("bag", "sums"))).alias("b")).select(
        F.col("__chunk").alias("__member"), F.flatten(F.transform("b", lambda e: e["sums"])).alias("sums"))
    aged = rows.withColumn("__member", F.explode(F.sequence(F.col("__chunk") - members, F.col("__chunk"))))
    out = T.StructType([T.StructField("__chunk", T.LongType()), aged.schema["__id"], T.StructField("__y", T.IntegerType()),
                        T.StructField("__member", T.LongType()), T.StructField("__sign", T.IntegerType())])

    def votes(part: pd.DataFrame, side: dict | None) -> pd.DataFrame:
        if side is None:  # no such member
            return pd.DataFrame({c: pd.Series(dtype="object") for c in out.names})
        flat = np.asarray(side["sums"]).reshape(-1, 2 + 4 * d)
        bags_ = Sums(flat[:, :2], flat[:, 2 : 2 + 2 * d].reshape(-1, 2, d), flat[:, 2 + 2 * d :].reshape(-1, 2, d))
        share = bags_.predict(np.stack(part["__x"].to_numpy()).astype(float)).mean(axis=0)
        return part[["__chunk", "__id", "__y", "__member"]].assign(__sign=np.sign(2 * share - 1).astype(np.int32))

    scored = stream_past(aged, packed, ["__member"], ["sums"], votes, out, salts=salts)
    hit = lambda y: F.sum(((F.col("__y") == y) & (F.col("__sign") == (1 if y else -1))).cast("double"))
    all_ = lambda y: F.count_if(F.col("__y") == y)
    per = scored.groupBy("__chunk", "__member").agg(hit(1).alias("tp"), hit(0).alias("tn"), all_(1).alias("p"), all_(0).alias("q"))
    gm = F.when((F.col("p") == 0) | (F.col("q") == 0), 0.0).otherwise(F.sqrt(F.col("tp") / F.col("p") * F.col("tn") / F.col("q")))
    rates = per.select("__chunk", "__member", gm.alias("gm"))
    # weight in force at chunk t: product over the member's chunks before t, at most ``members`` rows each
    listed = rates.groupBy("__member").agg(F.array_sort(F.collect_list(F.struct("__chunk", "gm"))).alias("g"))
    ages = listed.withColumn("__chunk", F.explode(F.sequence(F.col("__member") + 1, F.col("__member") + members)))
    past = F.filter("g", lambda e: e["__chunk"] < F.col("__chunk"))
    product = F.aggregate(past, F.lit(1.0), lambda a, e: a * e["gm"])
    weights = ages.select(F.col("__chunk"), "__member", product.alias("weight")).filter(F.col("weight") >= theta)
    joined = scored.filter(F.col("__member") < F.col("__chunk")).join(weights, ["__chunk", "__member"])
    vote = joined.groupBy("__chunk", "__id", "__y").agg(F.sum(F.col("__sign") * F.col("weight")).alias("score"))
    pred = rows.select("__chunk", "__id", "__y").join(vote, ["__chunk", "__id", "__y"], "left")
    final = pred.select(F.col("__chunk").alias(chunk), F.col("__id").alias(ident), F.col("__y").alias("y_true"), F.when(F.col("score") > 0, 1).otherwise(0).alias("y_pred"))
    return final, weights.select(F.col("__chunk").alias(chunk), F.col("__member").alias("member"), "weight")


# --- stable plus dynamic members ------------------------------------------------------------------


class StableDynamic(Machine):
    """Active learning with one long-lived naive Bayes and up to ``d_max`` chunk-born ones, per key.

    Probability is 0.5 * stable + sum w * dynamic.  A row is asked when its top-two margin is at most
    theta, which then shrinks, or at random.  Every ``chunk`` rows a new member is fitted on a share
    ``ratio`` of them, all weights shrink by 1 - 1 / d_max and theta restarts at 2 theta / classes.

    ``reinforced`` keeps per-class buffers of recent answers, asks instead at random at a rate that grows
    for rare predicted classes, rewards or punishes members on rows of rare classes, and replaces the
    weakest member rather than the oldest.
    """

    inputs = ("features", "label", "draw")
    outputs = (("y_pred", "int"), ("is_queried", "boolean"), ("threshold", "double"), ("n_members", "int"))

    def __init__(self, n_classes: int, *, warm: int = 30, chunk: int = 150, ratio: float = 0.05, theta: float = 0.4, step: float = 0.01,
                 sigma: float = 0.01, d_max: int = 10, reinforced: bool = False, seeds: int = 3, second_shrink: bool = False, seed: int = 42):
        self.n_classes, self.warm, self.chunk, self.ratio, self.step, self.sigma = n_classes, warm, chunk, ratio, step, sigma
        self.first, self.d_max, self.reinforced, self.seeds, self.second_shrink, self.seed = 2 * theta / n_classes, d_max, reinforced, seeds, second_shrink, seed
        self.per_class = chunk * ratio / n_classes

    def start(self):
        return dict(held=[], stable=None, members=[], w=[], seen_by=[], theta=self.first, recent=[], buffers=[[] for _ in range(self.n_classes)],
                    share=[0.0] * self.n_classes, rate=[0.0] * self.n_classes, rows=0, born=0, model=None)

    def feed(self, state, cols):
        s = {k: (list(v) if isinstance(v, list) else v) for k, v in state.items()}
        s["buffers"] = [list(b) for b in s["buffers"]]
        n = len(cols["label"])
        out = {"row": [], "y_pred": [], "is_queried": [], "threshold": [], "n_members": []}
        for i in range(n):
            x, y, u = np.asarray(cols["features"][i], dtype=float), int(cols["label"][i]), float(cols["draw"][i])
            s["rows"] += 1
            if s["stable"] is None:
                self._warm(s, x, y)
                continue
            p = self._proba(s, x)
            top = np.sort(p)
            theta, pred = s["theta"], int(p.argmax())
            sure = top[-1] - top[-2] <= theta
            ask = sure or (u < s["rate"][pred] if self.reinforced else u <= self.sigma)
            if sure:
                s["theta"] *= 1 - self.step
            if ask:
                self._learn(s, x, y, sure)
            s["recent"].append((x, y, ask))
            if len(s["recent"]) == self.chunk:
                self._grow(s)
            for k, v in zip(out, (i, pred, bool(ask), theta, len(s["members"]))):
                out[k].append(v)
        return s, {**out, "row": np.asarray(out["row"], dtype=np.int64)}

    def _warm(self, s, x, y):
        s["held"].append((x, y))
        if len(s["held"]) < self.warm:
            return
        xs, ys = np.array([h[0] for h in s["held"]]), np.array([h[1] for h in s["held"]])
        first = Sums.of(xs, ys, self.n_classes)
        s.update(stable=first, members=[first], w=[1 / self.d_max], seen_by=[np.bincount(ys, minlength=self.n_classes)], held=[])
        for hx, hy in zip(xs, ys.tolist()):
            self._remember(s, hx, hy, newest=self.reinforced)

    def _remember(self, s, x, y, newest):
        """Buffers hold the newest answers of a class (reinforced) or its first few rows."""
        b = s["buffers"][y]
        if newest:
            b.append(x)
            if len(b) > self.per_class:
                b.pop(0)
        elif len(b) < self.seeds:
            b.append(x)

    def _joint(self, s, x):
        if s["model"] is None:  # parameters are kept until a model changes
            s["model"] = Sums.stack([s["stable"], *s["members"]]).model()
        return joint_of_row(s["model"], x)

    def _proba(self, s, x):
        p = shares(self._joint(s, x))
        return 0.5 * p[0] + np.asarray(s["w"]) @ p[1:]

    def _learn(self, s, x, y, sure):
        one = Sums.of(x[None], np.array([y]), self.n_classes)
        s.update(stable=s["stable"] + one, members=[m + one for m in s["members"]], model=None)
        if not self.reinforced:
            return
        self._remember(s, x, y, newest=True)
        right = int(self._proba(s, x).argmax()) == y
        if sure and right and self.second_shrink:
            s["theta"] *= 1 - self.step
        elif not sure and not right:
            self._reward(s, x, y)

    def _reward(self, s, x, y):
        if s["share"][y] < 1 / self.n_classes:
            hit = self._joint(s, x)[1:].argmax(axis=-1) == y
            s["w"] = [w * (1 + (1 if h else -1) / self.d_max) for w, h in zip(s["w"], hit)]

    def _grow(self, s):
        s["born"] += 1
        s["theta"] = self.first
        size = int(self.chunk * self.ratio)
        u = splitmix_uniform(s["rows"] - len(s["recent"]) + np.arange(len(s["recent"])), self.seed)
        sample = [s["recent"][i] for i in np.argsort(u, kind="stable")[:size]]
        counts = np.bincount([y for _, y, _ in sample], minlength=self.n_classes)
        if self.reinforced:
            for x, y, _ in sample:
                if int(self._proba(s, x).argmax()) == y:
                    s["theta"] *= 1 - self.step
                else:
                    self._reward(s, x, y)
        pool = [(x, y) for x, y, _ in sample]
        for c in range(self.n_classes):
            lack = int(self.per_class - counts[c]) if self.reinforced else self.seeds
            held = s["buffers"][c]
            pool += [(x, c) for x in (held[len(held) - lack :] if self.reinforced else held[:lack])] if lack > 0 else []
        fresh = Sums.of(np.array([p[0] for p in pool]), np.array([p[1] for p in pool]), self.n_classes)
        if self.reinforced:
            for x, y, _ in sample:
                self._remember(s, x, y, newest=True)
        s["model"] = None
        weakest = int(np.argmin(s["w"]))
        s["w"] = [w * (1 - 1 / self.d_max) for w in s["w"]]
        if self.reinforced and s["born"] > self.d_max:
            s["members"][weakest], s["w"][weakest], s["seen_by"][weakest] = fresh, 1 / self.d_max, counts
        else:
            s["members"].append(fresh)
            s["w"].append(1 / self.d_max)
            s["seen_by"].append(counts)
            if not self.reinforced and len(s["w"]) > self.d_max:
                for k in ("members", "w", "seen_by"):
                    s[k].pop(0)
        if self.reinforced:
            mass = np.asarray(s["w"]) @ np.array(s["seen_by"], dtype=float)
            share = mass / mass.sum()
            s["share"] = share.tolist()
            s["rate"] = [1.0 if v == 0 else max(self.sigma / v / self.n_classes, self.sigma) for v in share]
        s["recent"] = []


def stable_dynamic(df: DataFrame, keys: list[str], order: str, features: list[str], label: str, machine: StableDynamic, draw: Column, **scan) -> DataFrame:
    rows = df.select(*keys, order, F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.col(label).cast("int").alias("label"), draw.alias("draw"))
    return keyed_scan(rows, keys, order, machine, keep=("label",), **scan)


# --- expert selection near a query ----------------------------------------------------------------


class ExpertSelection(Machine):
    """Block ensemble for binary labels: the members best on a row's neighbours vote on it.

    Each full block is brought to class parity by interpolating its smaller class, updates every
    member and adds one (oldest out beyond ``members``).  A row looks at its nearest rows in the last
    full block - only those of the smaller class when both occur - and the members with the top
    score there vote.
    """

    inputs = ("features", "label")
    outputs = (("y_pred", "int"), ("n_experts", "int"))

    def __init__(self, block: int = 50, members: int = 10, near: int = 5, seed: int = 42):
        self.block, self.members, self.near, self.seed = block, members, near, seed

    def start(self):
        return dict(members=[], held=[], last=None, blocks=0)

    def feed(self, state, cols):
        s = dict(state, members=list(state["members"]), held=list(state["held"]))
        n = len(cols["label"])
        pred, experts = np.zeros(n, np.int32), np.zeros(n, np.int32)
        x_all, y_all = np.stack(cols["features"]).astype(float), cols["label"].astype(int)
        at = 0
        while at < n:
            hi = min(n, at + self.block - len(s["held"]))
            if s["members"]:
                pred[at:hi], experts[at:hi] = self._vote(s, x_all[at:hi])
            s["held"] += list(zip(x_all[at:hi], y_all[at:hi].tolist()))
            if len(s["held"]) == self.block:
                self._close(s)
            at = hi
        return s, {"row": np.arange(n), "y_pred": pred, "n_experts": experts}

    def _vote(self, s, x):
        bx, by = s["last"]
        minor = 0 if (by == 0).sum() < (by == 1).sum() else 1
        guess_block = Sums.stack(s["members"]).predict(bx)  # members x block rows
        near = np.argsort(((x[:, None] - bx[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, : self.near]
        mine = by[near]
        mixed = (mine.min(axis=1) == 0) & (mine.max(axis=1) == 1)
        use = np.where(mixed[:, None], mine == minor, True)
        right = (guess_block[:, near] == mine[None]) & use[None]
        score = right.sum(axis=2) / use.sum(axis=1)[None]
        expert = score == score.max(axis=0)[None]
        votes = (expert * Sums.stack(s["members"]).predict(x)).sum(axis=0) / expert.sum(axis=0)
        return (votes >= 0.5).astype(np.int32), expert.sum(axis=0).astype(np.int32)

    def _close(self, s):
        x, y = np.array([h[0] for h in s["held"]]), np.array([h[1] for h in s["held"]])
        rx, ry = (x, y) if s["last"] is None else self._balance(s, x, y)
        fresh = Sums.of(rx, ry, 2)
        kept = s["members"][-(self.members - 1) :] if self.members > 1 else []
        s.update(members=[*[m + fresh for m in kept], fresh], held=[], last=(x, y), blocks=s["blocks"] + 1)

    def _balance(self, s, x, y):
        ones = int(y.sum())
        minor, need = (1, len(y) - 2 * ones) if 2 * ones < len(y) else (0, 2 * ones - len(y))
        mine, (bx, by) = x[y == minor], s["last"]
        ref = bx[by == minor]
        if not need or not len(mine) or not len(ref):
            return x, y
        aim = np.sort(np.sqrt(((mine[:, None] - ref[None]) ** 2).sum(axis=2)), axis=1)[:, :5].mean(axis=1)
        d = np.sqrt(((mine[:, None] - x[None]) ** 2).sum(axis=2))
        d[np.arange(len(mine)), np.flatnonzero(y == minor)] = np.inf
        pairs = []
        for i in range(len(mine)):
            near = np.argsort(d[i], kind="stable")[:7]
            near = near[(y[near] == minor) & np.isfinite(d[i, near])]
            best = 0
            if len(near) and aim[i] > 0:
                gap = np.abs(np.cumsum(d[i, near]) / np.arange(1, len(near) + 1) / aim[i] - 1)
                best = int(gap.argmin()) + 1 if gap.min() < 1 else 0
            pairs += [(mine[i], x[j]) for j in near[:best]] or [(mine[i], mine[i])]
        u = splitmix_uniform(s["blocks"] * 2 * self.block + np.arange(2 * need), self.seed)
        new = [a + t * (b - a) for (a, b), t in zip((pairs[int(v * len(pairs))] for v in u[:need]), u[need:])]
        return np.vstack([x, new]), np.concatenate([y, np.full(need, minor)])


# --- varying feature sets -------------------------------------------------------------------------


class VaryingFeatures(Machine):
    """Passive-aggressive binary learner on rows whose feature set changes (MAP<INT, DOUBLE>).

    Known and new features are blended by the share of variance each part carries; the step is
    min(C, loss / norm), scaled by a class cost that follows the class balance.
    """

    inputs = ("features", "label")
    outputs = (("y_pred", "int"), ("score", "double"))

    def __init__(self, c: float = 0.01, theta: float = 8.0, keep_share: float = 1.0, radius: float = 30.0, sparse: bool = False):
        self.c, self.theta, self.keep_share, self.radius, self.sparse = c, theta, keep_share, radius, sparse

    def start(self):
        return dict(w={}, current=set(), moments={}, counts={0: 1, 1: 1})

    def feed(self, state, cols):
        s = dict(w=dict(state["w"]), current=set(state["current"]), moments=dict(state["moments"]), counts=dict(state["counts"]))
        pred, score = [], []
        for x, y in zip(cols["features"], cols["label"].tolist()):
            x, y = dict(x), int(y)
            for k, v in x.items():  # running count, mean, sum of squared gaps
                n, mean, m2 = s["moments"].get(k, (0, 0.0, 0.0))
                gap = v - mean
                mean += gap / (n + 1)
                s["moments"][k] = (n + 1, mean, m2 + gap * (v - mean))
            s["counts"][y] += 1
            known = [k for k in x if k in s["current"]]
            new = [k for k in x if k not in s["current"]]
            spread = lambda ks: sum(s["moments"][k][2] / s["moments"][k][0] for k in ks)
            a, b = spread(known), spread(new)
            p_known = a / (a + b) if a + b else 1.0
            p_new = 1 - p_known
            value = p_known * sum(x[k] * s["w"].get(k, 0.0) for k in known) + p_new * sum(x[k] * s["w"].get(k, 0.0) for k in new)
            pred.append(1 if value > 0 else 0)
            score.append(value)
            sign = 1 if y else -1
            loss = max(0.0, 1 - sign * value)
            if x and loss:
                norm = p_known**2 * sum(x[k] ** 2 for k in known) + p_new**2 * sum(x[k] ** 2 for k in new)
                ratio = s["counts"][1] / s["counts"][0]
                cost = 1 / (ratio + 1) if y else 1 / (1 + 1 / ratio)
                step = min(self.c, loss / norm if norm else loss) * sign * cost * self.theta
                for ks, part in ((known, p_known), (new, p_new)):
                    for k in ks:
                        s["w"][k] = s["w"].get(k, 0.0) + step * part * x[k]
            s["current"] = set(x)
            if self.sparse:
                self._sparsify(s)
        return s, {"row": np.arange(len(pred)), "y_pred": np.array(pred, np.int32), "score": np.array(score, float)}

    def _sparsify(self, s):
        keys = sorted(s["w"])
        w = np.array([s["w"][k] for k in keys])
        if not np.abs(w).sum():
            return
        var = np.array([s["moments"][k][2] / s["moments"][k][0] for k in keys])
        info = var / var.sum() if var.sum() else np.ones(len(keys))
        mass = np.abs(w * info).sum()
        w = w * (min(1.0, self.radius / mass) if mass else 1.0)
        if np.count_nonzero(w) > self.keep_share * len(keys):
            drop = len(keys) - max(1, int(self.keep_share * len(keys)))
            w[np.argsort(w, kind="stable")[:drop]] = 0.0
        s["w"] = dict(zip(keys, w.tolist()))


# --- split statistics -----------------------------------------------------------------------------


def hoeffding_split_stats(df: DataFrame, leaf: str, features: list[str], label: str, classes: list[int], *, bins: int = 10, delta: float = 1e-7) -> DataFrame:
    """Best split per leaf: information gain at ``bins`` - 1 equal-width cuts of every feature.

    Returns (leaf, n, feature, cut, gain, second_gain, epsilon, split): ``split`` when the best feature
    beats the second by more than sqrt(R^2 ln(1 / delta) / 2n), R = log2 of the class count.  Rows are
    aggregated to (leaf, feature, bin) counts before any prefix.
    """
    d = len(features)
    ends = df.groupBy(leaf).agg(*[F.min(f).cast("double").alias(f"__lo{i}") for i, f in enumerate(features)], *[F.max(f).cast("double").alias(f"__hi{i}") for i, f in enumerate(features)])

    def cell(i: int) -> Column:
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        at = F.when(hi > lo, F.least(F.floor((F.col(features[i]).cast("double") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int"))
        return F.struct(F.lit(features[i]).alias("feature"), lo.alias("__lo"), hi.alias("__hi"), at.alias("__bin"))

    # rows meet one small row per leaf before they are split by feature
    cells = df.select(leaf, F.col(label).alias("__y"), *features).join(ends, leaf).select(leaf, "__y", F.explode(F.array(*[cell(i) for i in range(d)])).alias("c"))
    counts = cells.select(leaf, "__y", "c.*").filter(F.col("__bin").isNotNull()).groupBy(leaf, "feature", "__lo", "__hi", "__bin").agg(
        *[F.count_if(F.col("__y") == c).alias(f"__n{c}") for c in classes])
    packed = counts.groupBy(leaf, "feature", "__lo", "__hi").agg(F.collect_list(F.struct("__bin", *[f"__n{c}" for c in classes])).alias("cells"))
    cut = packed.withColumn("__cut", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))))
    side = lambda c, low: F.aggregate(
        F.filter("cells", lambda e: (e["__bin"] < F.col("__cut")) if low else (e["__bin"] >= F.col("__cut"))),
        F.lit(0).cast("bigint"), lambda acc, e: acc + e[f"__n{c}"])
    cut = cut.select(leaf, "feature", "__lo", "__hi", "__cut", *[side(c, True).alias(f"__a{c}") for c in classes], *[side(c, False).alias(f"__b{c}") for c in classes])

    def entropy(names: list[str]) -> Column:
        total = sum((F.col(n) for n in names), F.lit(0))
        return sum((F.when(F.col(n) > 0, -F.col(n) / total * F.log2(F.col(n) / total)).otherwise(0.0) for n in names), F.lit(0.0))

    cut = cut.withColumns({f"__t{c}": F.col(f"__a{c}") + F.col(f"__b{c}") for c in classes})
    total = lambda k: sum((F.col(f"__{k}{c}") for c in classes), F.lit(0))
    names = lambda k: [f"__{k}{c}" for c in classes]
    gain = entropy(names("t")) - total("a") / total("t") * entropy(names("a")) - total("b") / total("t") * entropy(names("b"))
    gained = cut.select(leaf, "feature", total("t").alias("n"), (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__cut") / bins).alias("cut"), F.round(gain, 10).alias("gain"))
    best = gained.groupBy(leaf, "feature").agg(F.max("n").alias("n"), F.max(F.struct(F.col("gain"), -F.col("cut"))).alias("g"))
    ranked = best.groupBy(leaf).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("g")["gain"].alias("gain"), F.col("feature"), (-F.col("g")["col2"]).alias("cut"))), asc=False).alias("r"))
    top, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    spread = float(np.log2(len(classes)))
    eps = F.sqrt(F.lit(spread * spread * np.log(1 / delta)) / (2 * F.col("n")))
    return ranked.select(
        leaf, "n", top["feature"].alias("feature"), top["cut"].alias("cut"), top["gain"].alias("gain"),
        F.coalesce(second["gain"], F.lit(0.0)).alias("second_gain"), eps.alias("epsilon"),
        ((top["gain"] - F.coalesce(second["gain"], F.lit(0.0))) > eps).alias("split"))
