"""Trees that grow along a stream of chunks, for classes and for numbers, alone or in a bag.

A node decides by the statistics of the rows that reached it since its birth, so all chunks of a level are read in one
pass: rows are routed through the levels known so far, counted per (node, chunk, feature, bin), and the small
counts are folded in the order of the chunks until a split is sure.  The nodes of the next level see the rows of
later chunks.  A tree sees a row by its chunk and bins only, so the rows are read once, into sums per (chunk, bins), and the
passes of the levels are over those; rows are never copied or shuffled by themselves.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_poisson
from tidemark.plans.chunks import lagged_prefix, score_join
from tidemark.plans.keyed import Machine, keyed_scan
from tidemark.session import materialize


@dataclasses.dataclass
class Classes:
    """Leaves count classes; a split is judged by its information gain."""

    classes: list[int]

    @property
    def width(self) -> int:
        return len(self.classes)

    @property
    def spread(self) -> float:
        return float(np.log2(max(2, len(self.classes))))

    def terms(self, weight: str) -> list[str]:
        return [f"sum(CASE WHEN __y = {c} THEN {weight} ELSE 0.0D END)" for c in self.classes]

    def n(self, s: np.ndarray) -> np.ndarray:
        return s.sum(axis=-1)

    def gains(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray) -> np.ndarray:
        def entropy(s):
            with np.errstate(divide="ignore", invalid="ignore"):
                p = s / s.sum(axis=-1, keepdims=True)
                return -np.where(p > 0, p * np.log2(p), 0.0).sum(axis=-1)

        n, a, b = self.n(whole), self.n(left), self.n(right)
        return entropy(whole) - a / n * entropy(left) - b / n * entropy(right)

    def answer(self, stats: str) -> str:
        """SQL: the class of most rows, the first of equals."""
        return f"array({', '.join(map(str, self.classes))})[int(array_position({stats}, array_max({stats}))) - 1]"

    kind = "int"


@dataclasses.dataclass
class Numbers:
    """Leaves keep count, sum and sum of squares; a split is judged by the share of variance it removes."""

    width: int = 3
    spread: float = 1.0
    kind: str = "double"

    def terms(self, weight: str) -> list[str]:
        return [f"sum({weight})", f"sum({weight} * __y)", f"sum({weight} * __y * __y)"]

    def n(self, s: np.ndarray) -> np.ndarray:
        return s[..., 0]

    def gains(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray) -> np.ndarray:
        def scatter(s):
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(s[..., 0] > 0, np.maximum(s[..., 2] - s[..., 1] ** 2 / s[..., 0], 0.0), 0.0)

        all_ = scatter(whole)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(all_ > 0, 1 - (scatter(left) + scatter(right)) / all_, 0.0)

    def answer(self, stats: str) -> str:
        return f"CASE WHEN {stats}[0] > 0 THEN {stats}[1] / {stats}[0] ELSE 0.0D END"


class Split(Machine):
    """The first sure split of a node: statistics per (feature, bin), one chunk at a time."""

    inputs = ("cells",)
    outputs = (("feature", "int"), ("bin", "int"), ("low", "array<double>"), ("high", "array<double>"))

    def __init__(self, goal, features: int, bins: int, delta: float, tie: float):
        self.goal, self.shape, self.delta, self.tie = goal, (features, bins, goal.width), delta, tie

    def start(self):
        return np.zeros(self.shape)

    def feed(self, state, cols):
        for i, cells in enumerate(cols["cells"]):
            if state is None:
                break
            state = state.copy()
            for c in cells:
                state[c["feature"], c["bin"]] += c["stats"]
            if (found := self._sure(state)) is not None:
                return None, {"row": np.array([i]), **{k: [v] for k, v in found.items()}}
        return state, {"row": np.zeros(0, int), "feature": [], "bin": [], "low": [], "high": []}

    def _sure(self, state: np.ndarray) -> dict | None:
        low = state.cumsum(axis=1)
        whole, low = low[:, -1:], low[:, :-1]
        high = whole - low
        n = float(self.goal.n(whole[0, 0]))
        gain = self.goal.gains(low, high, np.broadcast_to(whole, low.shape)) if n > 0 else np.zeros(low.shape[:2])
        gain = np.round(np.where((self.goal.n(low) > 0) & (self.goal.n(high) > 0), gain, 0.0), 10)
        at = gain.argmax(axis=1)
        best = gain.max(axis=1)
        first = int(best.argmax())
        second = float(np.delete(best, first).max(initial=0.0))
        limit = np.sqrt(self.goal.spread**2 * np.log(1 / self.delta) / (2 * n)) if n > 0 else np.inf
        if best[first] <= 0 or not (best[first] - second > limit or limit < self.tie):
            return None
        return {"feature": first, "bin": int(at[first]) + 1, "low": low[first, at[first]].tolist(), "high": high[first, at[first]].tolist()}


def stream_forest(
    df: DataFrame, keys: list[str], chunk: str, features: list[str], target: str, goal, *, members: int = 1, ident: str | None = None, lam: float = 6.0,
    bins: int = 10, depth: int = 4, delta: float = 1e-3, tie: float = 0.05,
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``answers``, trees): each chunk is answered by the trees grown on the chunks before it.

    A node splits at the end of the first chunk after which the best feature beats the second by more than
    sqrt(R^2 ln(1 / delta) / 2n), or that bound is under ``tie``; its children start with its statistics on their
    side of the cut and see later chunks only.  Features are cut into ``bins`` of equal width between their
    least and largest value in the first chunk of all; values beyond fall into the end bins.  Trees end at ``depth``.  With several ``members`` a row
    counts Poisson(``lam``) times in each, drawn from ``ident``.  Rows with a missing feature are not answered, and
    like those without a target not learned.  ``trees`` has a row per split.
    """
    if not keys:
        rows, trees = stream_forest(
            df.withColumn("__one", F.lit(0)), ["__one"], chunk, features, target, goal, members=members, ident=ident, lam=lam, bins=bins, depth=depth, delta=delta, tie=tie)
        return rows.drop("__one"), trees.drop("__one")
    d = len(features)
    usable = " AND ".join(f"`{f}` IS NOT NULL" for f in features)
    start = df.agg(F.min(chunk)).first()[0]
    ends = df.filter(F.col(chunk) == F.lit(start)).agg(*[g(F.col(f).cast("double")) for f in features for g in (F.min, F.max)]).first()
    ends = [(ends[2 * j], ends[2 * j + 1]) if ends[2 * j] is not None and ends[2 * j + 1] > ends[2 * j] else (ends[2 * j] or 0.0, (ends[2 * j] or 0.0) + 1.0) for j in range(d)]
    place = [f"cast(least(greatest(floor((cast(`{f}` as double) - {lo!r}D) / {hi - lo!r}D * {bins}), 0), {bins - 1}) as int)" for f, (lo, hi) in zip(features, ends)]
    binned = df.withColumn("__bins", F.expr(f"CASE WHEN {usable} THEN array({', '.join(place)}) END"))
    weights: Column = F.array(F.lit(1.0)) if members == 1 else F.array(*[hash_poisson(F.col(ident), F.lit(f"tree{m}"), lam).cast("double") for m in range(members)])
    learn = binned.filter(F.col("__bins").isNotNull() & F.col(target).isNotNull()).select(*keys, chunk, "__bins", F.col(target).alias("__y"), weights.alias("__weights"))
    learn = materialize(_cells(learn, [*keys, chunk, "__bins"], goal, members), "tree-cells")
    forest, splits = None, None

    def routed(rows: DataFrame) -> DataFrame:
        """``__nodes``: the node of each member's tree that a row reaches; nodes are numbered like a heap."""
        if forest is None:
            return rows.withColumn("__nodes", F.array_repeat(F.lit(1), members))
        rows = rows.join(F.broadcast(forest) if keys == ["__one"] else forest, keys, "left")  # one stream: one row of at most members * 2^depth splits
        step = f"CASE WHEN tree[node] IS NOT NULL AND tree[node].at < `{chunk}` THEN node * 2 + CASE WHEN __bins[tree[node].feature] >= tree[node].bin THEN 1 ELSE 0 END ELSE node END"
        walk = f"aggregate(sequence(1, {depth}), 1, (node, i) -> {step})"
        return rows.withColumn("__nodes", F.expr(f"CASE WHEN __forest IS NULL THEN array_repeat(1, {members}) ELSE transform(__forest, tree -> {walk}) END")).drop("__forest")

    def each(rows: DataFrame) -> DataFrame:
        pairs = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(members - 1)).alias("member"), F.col("__nodes").alias("node"), F.col("__sums").alias("s")))
        return rows.select(*keys, chunk, "__bins", pairs.alias("p")).select(
            *keys, chunk, "__bins", F.col("p.member").alias("__member"), F.col("p.node").alias("__node"), F.col("p.s").alias("__s")).filter("__s.w > 0")

    stats = [F.sum(F.col("__s.terms")[i]).alias(f"__s{i}") for i in range(goal.width)]
    packed = F.array(*[F.col(f"__s{i}") for i in range(goal.width)]).alias("stats")
    node = [*keys, "__member", "__node"]
    for level in range(depth):
        open_ = each(routed(learn)).filter(F.col("__node") >= 2**level)
        cells = open_.select(*node, chunk, "__s", F.posexplode("__bins").alias("feature", "bin")).groupBy(*node, chunk, "feature", "bin").agg(*stats)
        held = cells.groupBy(*node, chunk).agg(F.collect_list(F.struct("feature", "bin", packed)).alias("cells"))
        found = keyed_scan(held, node, chunk, Split(goal, d, bins, delta, tie)).withColumn("at", F.col(chunk).cast("bigint")).drop(chunk)
        splits = materialize(found if splits is None else splits.unionByName(found), "tree-splits")
        if not splits.filter(F.col("__node") >= 2**level).head(1):
            break
        by = splits.groupBy(*keys, "__member").agg(F.map_from_entries(F.collect_list(F.struct("__node", F.struct("feature", "bin", "at")))).alias("m"))
        tree = F.transform(F.sequence(F.lit(0), F.lit(2**depth - 1)), lambda i: F.try_element_at("m", i))
        by = by.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__member", tree.alias("t")))).alias("f"))
        forest = materialize(by.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda i: F.coalesce(F.try_element_at("f", i), _no_tree(depth))).alias("__forest")), "forest")

    total = each(routed(learn)).groupBy(*node, chunk).agg(*stats)
    names = [f"__s{i}" for i in range(goal.width)]
    seen = materialize(binned.filter("__bins IS NOT NULL").select(*keys, chunk, "__bins").distinct(), "tree-bins")  # also of rows without a target
    spine = routed(seen).select(*keys, chunk, F.posexplode("__nodes").alias("__member", "__node")).distinct()
    total = spine.join(total, [*node, chunk], "left").na.fill(0.0, names)
    past = lagged_prefix(total, node, chunk, names)
    sides = F.explode(F.array(F.struct((F.col("__node") * 2).alias("__node"), F.col("low").alias("from")), F.struct((F.col("__node") * 2 + 1).alias("__node"), F.col("high").alias("from"))))
    born = splits.select(*keys, "__member", sides.alias("c")).select(*keys, "__member", "c.*")
    have = past.join(born, node, "left").withColumn("__have", F.array(*[F.col(n) + F.coalesce(F.get("from", F.lit(i)), F.lit(0.0)) for i, n in enumerate(names)]))
    have = have.withColumn("__answer", F.expr(goal.answer("__have")).cast(goal.kind))
    known = have.groupBy(*keys, chunk).agg(F.map_from_entries(F.collect_list(F.struct((F.col("__member") * 2 ** (depth + 1) + F.col("__node")).alias("k"), "__answer"))).alias("__leaves"))
    answers = f"transform(__nodes, (n, m) -> try_element_at(__leaves, m * {2 ** (depth + 1)} + n))"
    told = score_join(routed(seen), known, [*keys, chunk]).select(*keys, chunk, "__bins", F.expr(answers).alias("answers"))
    rows = score_join(binned, materialize(told, "tree-answers"), [*keys, chunk, "__bins"])
    cut = F.element_at(F.array(*[F.lit(float(lo)) for lo, _ in ends]), F.col("feature") + 1) + F.col("bin") / F.lit(float(bins)) * F.element_at(
        F.array(*[F.lit(float(hi - lo)) for lo, hi in ends]), F.col("feature") + 1)
    shown = splits.select(*keys, F.col("__member").alias("member"), F.col("__node").alias("node"), F.col("at").alias(chunk),
                          F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1).alias("feature"), cut.alias("cut"))
    return rows.select(*df.columns, "answers"), shown


def _cells(learn: DataFrame, by: list[str], goal, members: int) -> DataFrame:
    """One row per ``by``: ``__sums`` has the weight and the additive terms of the rows for each member."""
    each = [(m, F.expr(f"sum(__w{m})").alias(f"__w{m}"), [F.expr(f"{t} AS __t{m}_{i}") for i, t in enumerate(goal.terms(f"__w{m}"))]) for m in range(members)]
    wide = learn.select(*by, F.col("__y"), *[F.col("__weights")[m].alias(f"__w{m}") for m in range(members)])
    sums = wide.groupBy(*by).agg(*[c for _, w, terms in each for c in (w, *terms)])
    packed = [F.struct(F.col(f"__w{m}").alias("w"), F.array(*[F.col(f"__t{m}_{i}") for i in range(goal.width)]).alias("terms")) for m in range(members)]
    return sums.select(*by, F.array(*packed).alias("__sums"))


def _no_tree(depth: int) -> Column:
    return F.array_repeat(F.lit(None).cast("struct<feature:int,bin:int,at:bigint>"), 2**depth)


def hoeffding_tree(df: DataFrame, keys: list[str], chunk: str, features: list[str], label: str, classes: list[int], **options) -> DataFrame:
    """Test-then-train classes (``y_pred``) of one tree per key; options as for ``stream_forest``."""
    rows, _ = stream_forest(df, keys, chunk, features, label, Classes(classes), **options)
    return rows.withColumn("y_pred", F.get("answers", F.lit(0))).drop("answers")


def tree_regressor(df: DataFrame, keys: list[str], chunk: str, features: list[str], target: str, **options) -> DataFrame:
    """Test-then-train numbers (``y_pred``): the leaf's mean, or the mean over the ``members`` of a bag."""
    rows, _ = stream_forest(df, keys, chunk, features, target, Numbers(), **options)
    mean = F.aggregate("answers", F.lit(0.0), lambda a, x: a + x) / F.size("answers")
    return rows.withColumn("y_pred", mean).drop("answers")
