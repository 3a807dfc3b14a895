"""Chunks whose length follows the data: until predictions stop getting steadier, or until a change shows.

Both are per-key state machines; inside a task all stumps of a decision are trained as one array
operation.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import f_cdf, fisher_combine, splitmix_uniform
from tidemark.plans.blocks import map_blocks
from tidemark.plans.keyed import Machine, keyed_scan


def _picks(bags: int, size: int, k: int, seed: int) -> np.ndarray:
    """bags x k positions among ``size`` by hashed draw; those of short chunks, which come again, are kept."""
    return _few_picks(bags, size, k, seed) if size <= 400 else _drawn(bags, size, k, seed)


def _drawn(bags: int, size: int, k: int, seed: int) -> np.ndarray:
    u = splitmix_uniform(np.arange(bags * size), seed).reshape(bags, size)
    return np.argsort(u, axis=1, kind="stable")[:, :k]


@lru_cache(maxsize=4096)
def _few_picks(bags: int, size: int, k: int, seed: int) -> np.ndarray:
    return _drawn(bags, size, k, seed).astype(np.int16)


@lru_cache(maxsize=2)
def _teams(draws: int, bags: int, team: int, seed: int) -> np.ndarray:
    u = splitmix_uniform(np.arange(draws * bags), seed).reshape(draws, bags)
    return np.argpartition(u, team - 1, axis=1)[:, :team] if team < bags else np.tile(np.arange(bags), (draws, 1))


@lru_cache(maxsize=4096)
def _few_uniforms(n: int, seed: int) -> np.ndarray:
    return splitmix_uniform(np.arange(n), seed)


def _uniforms(n: int, seed: int) -> np.ndarray:
    return _few_uniforms(n, seed) if n <= 400 else splitmix_uniform(np.arange(n), seed)


class Stumps:
    """Depth-one trees, one per bag: every minority row and sqrt(n) majority rows by hashed draw."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bags: int, seed: int):
        minor = 1 if 2 * y.sum() < len(y) else 0
        few, many = np.flatnonzero(y == minor), np.flatnonzero(y != minor)
        k = min(int(np.sqrt(len(y))), len(many))
        self._ranked(x, y, np.hstack([np.tile(few, (bags, 1)), many[_picks(bags, len(many), k, seed)]]))

    @classmethod
    def of_bags(cls, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> "Stumps":
        """One for each line of ``rows`` (positions), with as many rows of each class in every line."""
        out = cls.__new__(cls)
        out._ranked(x, y, rows)
        return out

    def _ranked(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> None:
        """``_grow`` where every line has as many rows of each class.

        Values are replaced by their ranks, whose small numbers sort fast, and the impurity of a cut is looked up by
        its rows and ones on the left: the same cuts.
        """
        if len(x) > 1 << 13 or np.isnan(x).any():  # ranks must fit, and a missing value has none
            self._grow(x, y, rows)
            return
        bags, n = rows.shape
        total = int(y[rows[0]].sum()) if bags else 0
        left, ones = np.arange(1, n)[:, None], np.arange(total + 1)[None]
        pl, pr = ones / left, (total - ones) / (n - left)
        gini = left * pl * (1 - pl) + (n - left) * pr * (1 - pr)
        line = np.arange(bags)
        best = at = feature = low = high = gap = None
        for j in range(x.shape[1]):
            values, rank = np.unique(x[:, j], return_inverse=True)
            key = np.sort((rank * 2 + y).astype(np.int8 if len(values) < 64 else np.int16)[rows], axis=1)
            sum_ = np.cumsum(key & 1, axis=1, dtype=np.int16)[:, :-1]
            rank = key >> 1
            score = np.where(rank[:, 1:] > rank[:, :-1], gini[np.arange(n - 1)[None], sum_], np.inf)
            where = score.argmin(axis=1) if n > 1 else np.zeros(bags, int)
            if n < 2:
                score = np.full((bags, 1), np.inf)
            value = score[line, where]
            here = np.isfinite(value)
            one = sum_[line, where] if n > 1 else np.zeros(bags, int)
            cut = (values[rank[line, where]] + values[rank[line, np.minimum(where + 1, n - 1)]]) / 2
            found = [value, where, np.full(bags, j), pl[where, one] if n > 1 else value, pr[where, one] if n > 1 else value, np.where(here, cut, np.inf)]
            if best is None:
                best, at, feature, low, high, gap = found
                continue
            won = (found[0] < best) | ((found[0] == best) & (found[1] < at))
            best, at, feature, low, high, gap = (np.where(won, f, o) for f, o in zip(found, (best, at, feature, low, high, gap)))
        ok, base = np.isfinite(best), np.full(bags, total) / n
        self.feature, self.cut, self.low, self.high = feature, gap, np.where(ok, low, base), np.where(ok, high, base)

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> None:
        bx, by, bags = x[rows], y[rows], len(rows)  # bags x rows x features
        order = np.argsort(bx, axis=1, kind="stable")
        sx = np.take_along_axis(bx, order, 1)
        sy = np.take_along_axis(np.broadcast_to(by[:, :, None], bx.shape), order, 1)
        n = rows.shape[1]
        ones = np.cumsum(sy, axis=1)[:, :-1]
        left = np.arange(1, n)[None, :, None]
        total = by.sum(axis=1)[:, None, None]
        pl, pr = ones / left, (total - ones) / (n - left)
        gini = left * pl * (1 - pl) + (n - left) * pr * (1 - pr)
        gini = np.where(sx[:, 1:] > sx[:, :-1], gini, np.inf)  # cut only between different values
        flat = gini.reshape(bags, -1).argmin(axis=1) if n > 1 else np.zeros(bags, int)
        at, self.feature = np.unravel_index(flat, gini.shape[1:])
        b = np.arange(bags)
        cut_ok = np.isfinite(gini[b, at, self.feature])
        self.cut = np.where(cut_ok, (sx[b, at, self.feature] + sx[b, at + 1, self.feature]) / 2, np.inf)
        base = by.mean(axis=1)
        self.low = np.where(cut_ok, pl[b, at, self.feature], base)
        self.high = np.where(cut_ok, pr[b, at, self.feature], base)

    def proba(self, x: np.ndarray) -> np.ndarray:
        """bags x rows probability of class 1."""
        return np.where(x[:, self.feature].T <= self.cut[:, None], self.low[:, None], self.high[:, None])


def _g_mean(pred: np.ndarray, y: np.ndarray) -> float:
    pos, neg = y == 1, y == 0
    if not pos.any() or not neg.any():
        return 0.0
    return float(np.sqrt(pred[pos].mean() * (1 - pred[neg]).mean()))


class _Growing(Machine):
    """Feeds blocks of at least ``block`` rows with ``least`` rows of each class to ``decide``."""

    inputs = ("features", "label")
    outputs = (("chunk_id", "bigint"), ("n_rows", "bigint"), ("p_value", "double"))
    block, least, first = 100, 5, 100

    def start(self):
        return dict(store=[], block=[], counts=[0, 0], closed=0, extra=None)

    def feed(self, state, cols):
        s = dict(state, store=list(state["store"]), block=list(state["block"]), counts=list(state["counts"]))
        rows, ids, lengths, ps = [], [], [], []
        for i, (x, y) in enumerate(zip(cols["features"], cols["label"].tolist())):
            s["block"].append((np.asarray(x, dtype=float), int(y)))
            s["counts"][int(y)] += 1
            opening = s["closed"] == 0 and s["extra"] is None
            need, each = (self.first, 1) if opening else (self.block, self.least)
            if len(s["block"]) < need or min(s["counts"]) < each:
                continue
            s["counts"] = [0, 0]
            length, p = self.decide(s)
            if length:
                rows.append(i)
                ids.append(s["closed"])
                lengths.append(length)
                ps.append(p)
                s["closed"] += 1
        return s, {"row": np.asarray(rows, dtype=np.int64), "chunk_id": ids, "n_rows": lengths, "p_value": ps}

    @staticmethod
    def arrays(pairs):
        return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def decide(self, s):
        raise NotImplementedError


class VarianceChunks(_Growing):
    """Grows a chunk while adding a block still lowers the variance of sub-sampled predictions.

    ``bags`` stumps are trained on the chunk; ``draws`` averages of ``team`` of them predict ``probes`` test
    rows.  F-tests on the probe variances with and without the newest block are combined by Fisher's
    method; a combined p-value of at least ``delta`` closes the chunk before that block. A chunk
    also closes at ``max_rows`` where one is given.
    """

    def __init__(self, *, bags: int = 1000, team: int = 100, draws: int = 250, probes: int = 10, delta: float = 0.05, block: int = 100,
                 max_rows: int | None = None, seed: int = 42):
        self.bags, self.team, self.draws, self.probes, self.delta, self.seed = bags, team, draws, probes, delta, seed
        self.block = self.first = block
        self.max_rows = max_rows

    def spread(self, pairs, probes):
        x, y = self.arrays(pairs)
        p = Stumps(x, y, self.bags, self.seed).proba(np.array(probes))
        return p[_teams(self.draws, self.bags, self.team, self.seed + 1)].mean(axis=1).var(axis=0)

    def decide(self, s):
        block, s["block"] = s["block"], []
        if s["extra"] is None:  # the opening chunk also gives the first probes
            u = splitmix_uniform(np.arange(len(block)), self.seed)
            s["extra"] = dict(probes=[block[i][0] for i in np.argsort(u, kind="stable")[: self.probes]], var=None)
            s["store"] = []
            return len(block), None
        e = dict(s["extra"])
        s["extra"] = e
        probes = e["probes"][-self.probes :]
        if e["var"] is None:
            e["var"], s["store"] = self.spread(block, probes), block
            return 0, None
        both = s["store"] + block
        var = self.spread(both, probes)
        tests = [1 - f_cdf(a / b, 99, 99) for a, b in zip(e["var"], var) if b]
        tests = [t for t in tests if t > 0]
        p = fisher_combine(tests) if tests else 1.0
        if p < self.delta and (self.max_rows is None or len(both) < self.max_rows):
            e["var"], s["store"] = var, both
            return 0, None
        x, y = self.arrays(s["store"])
        minor = 1 if 2 * y.sum() <= len(y) else 0
        e["probes"] = (e["probes"] + list(x[y == minor]))[-self.probes :]
        closed, s["store"], e["var"] = len(s["store"]), block, self.spread(block, e["probes"])
        return closed, p


class PermutationChunks(_Growing):
    """Closes a chunk when its stumps lose more G-mean on the next block than on shuffled splits.

    The loss on the newest block is ranked among losses on ``perms`` class-stratified re-splits of chunk and
    block; a share below ``delta`` is a change.  A chunk also closes at ``max_rows`` where one
    is given.
    """

    least = 2

    def __init__(self, *, perms: int = 100, bags: int = 100, delta: float = 0.05, block: int = 100, max_rows: int | None = None, seed: int = 42):
        self.perms, self.bags, self.delta, self.max_rows, self.seed = perms, bags, delta, max_rows, seed
        self.block = self.first = block

    def loss(self, train, test, salt):
        p = Stumps(*train, self.bags, self.seed + salt).proba(test[0]).mean(axis=0)
        return 1 - _g_mean((p > 0.5).astype(float), test[1])

    def shuffled(self, x: np.ndarray, y: np.ndarray, length: int, held: int = 1 << 19) -> np.ndarray:
        """The loss on each re-split of the rows, ``length`` of them for testing; the stumps of many splits are grown at once."""
        parts = []
        for c in (0, 1):  # keep class shares in both parts
            mine = np.flatnonzero(y == c)
            size = min(max(round(len(mine) * length / len(y)), 1), len(mine) - 1)
            parts.append((mine, max(size, 0) if size >= 0 else max(len(mine) + size, 0)))
        kept = [len(mine) - size for mine, size in parts]
        minor = 1 if 2 * kept[1] < sum(kept) else 0
        k = min(int(np.sqrt(sum(kept))), kept[1 - minor])
        at_once = max(1, held // max(1, self.bags * (kept[minor] + k) * x.shape[1]))
        out = []
        for lo in range(0, self.perms, at_once):
            which = range(lo, min(self.perms, lo + at_once))
            u = np.stack([_uniforms(len(y), self.seed + 1000 + i) for i in which])
            order = [mine[np.argsort(u[:, mine], axis=1, kind="stable")] for mine, _ in parts]
            test = [o[:, :size] for o, (_, size) in zip(order, parts)]
            train = [np.sort(o[:, size:], axis=1) for o, (_, size) in zip(order, parts)]
            few = np.repeat(train[minor], self.bags, axis=0)
            drawn = [many[_picks(self.bags, len(many), k, self.seed + 1 + i)] for i, many in zip(which, train[1 - minor])]
            p = Stumps.of_bags(x, y, np.hstack([few, np.concatenate(drawn)])).proba(x)
            p = (p.reshape(len(which), self.bags, len(y)).mean(axis=1) > 0.5).astype(float)
            neg, pos = (np.take_along_axis(p, t, 1) for t in test)
            if not pos.shape[1] or not neg.shape[1]:
                out.append(np.ones(len(which)))
            else:
                out.append(1 - np.sqrt(pos.mean(axis=1) * (1 - neg).mean(axis=1)))
        return np.concatenate(out) if out else np.zeros(0)

    def decide(self, s):
        block, s["block"] = s["block"], []
        if s["extra"] is None:
            s["extra"], s["store"] = {}, []
            return len(block), None
        if not s["store"]:
            s["store"] = block
            return 0, None
        old, new = self.arrays(s["store"]), self.arrays(block)
        x, y = np.vstack([old[0], new[0]]), np.concatenate([old[1], new[1]])
        worse = int((self.loss(old, new, 0) < self.shuffled(x, y, len(block))).sum())
        p = (1 + worse) / (self.perms + 1)
        if p < self.delta or (self.max_rows is not None and len(s["store"]) >= self.max_rows):
            closed, s["store"] = len(s["store"]), block
            return closed, p
        s["store"] = s["store"] + block
        return 0, None


def growing_chunks(df: DataFrame, keys: list[str], order: str, features: list[str], label: str, machine: Machine, **scan) -> DataFrame:
    """Rows at which a chunk is found complete: (keys, order, chunk_id, n_rows, p_value)."""
    rows = df.select(*keys, order, F.array(*[F.col(f).cast("double") for f in features]).alias("features"), F.col(label).cast("int").alias("label"))
    return keyed_scan(rows, keys, order, machine, **scan)


def f_ratios(pairs: DataFrame) -> DataFrame:
    """The usable pairs with their F statistic and degrees of freedom."""
    usable = pairs.filter((F.col("n") > 1) & (F.col("n2") > 1) & (F.col("v2") > 0))
    return usable.withColumns({"f": F.col("v") / F.col("v2"), "df1": F.col("n") - 1, "df2": F.col("n2") - 1})


def combine_f_tests(pairs: DataFrame, by: list[str], order: str, *, max_rows: int) -> DataFrame:
    """Fisher-combined p-value per group of one-sided F-tests n, v (variance) against n2, v2.

    Groups hold one small row per test point, at most ``max_rows``.
    """
    usable = f_ratios(pairs).select(*by, order, "n", "v", "n2", "v2")
    schema = T.StructType([*[pairs.schema[c] for c in by], T.StructField("n_tests", T.LongType()), T.StructField("p_value", T.DoubleType())])

    def combine(block: pd.DataFrame) -> pd.DataFrame:
        p = [1 - f_cdf(v / w, n - 1, m - 1) for v, w, n, m in zip(block["v"], block["v2"], block["n"], block["n2"])]
        return block[by].head(1).assign(n_tests=len(p), p_value=fisher_combine([x for x in p if x > 0]))

    return map_blocks(usable, by, [order], combine, schema, max_rows=max_rows)
