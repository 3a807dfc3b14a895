"""Random-feature ridge learners whose whole state is a sum: AtA and AtY per chunk.

The recursive inverse update of such models equals a ridge solve on the accumulated sums, so chunks
are reduced in parallel, added up by a two-level prefix, solved per chunk, and joined back to the
chunk they score (test, then train).
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.blocks import fold_blocks, partial_blocks, stream_past, sum_arrays
from tidemark.session import materialize

_ACT = {
    "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)),
    "linear": lambda x: x,
    "tanh": np.tanh,
    "relu": lambda x: np.maximum(x, 0.0),
    "tansig": lambda x: 2.0 / (1.0 + np.exp(-2.0 * x)) - 1.0,
}


def _orthonormal(w: np.ndarray) -> np.ndarray:
    """Columns (or rows, when wider than tall) made orthonormal."""
    tall = w if w.shape[0] >= w.shape[1] else w.T
    q = np.linalg.qr(tall)[0]
    return q if w.shape[0] >= w.shape[1] else q.T


@dataclasses.dataclass
class NodeMap:
    """Seeded random nodes: ``groups`` of mapped features, then enhancement nodes on top of them.

    ``extra`` adds (chunk, mapped, enhanced) groups that stay zero before their chunk.
    """

    n_inputs: int
    nf: int = 10
    n1: int = 10
    ne: int = 10
    n2: int = 10
    map_function: str = "sigmoid"
    enhance_function: str = "sigmoid"
    mapping: bool = True
    whiten: bool = True
    seed: int = 42
    mean: tuple = ()
    std: tuple = ()
    extra: tuple = ()

    def __post_init__(self):
        for f in (self.map_function, self.enhance_function):
            if f not in _ACT:
                raise ValueError(f"unknown activation {f!r}")
        rng = np.random.default_rng(self.seed)
        draw = lambda rows, cols: (2 * rng.random((rows, cols)) - 1, 2 * rng.random() - 1)
        self._map = [draw(self.n_inputs, self.n1) for _ in range(self.nf)] if self.mapping else []
        width = self.nf * self.n1 if self.mapping else self.n_inputs
        self._enhance = [draw(width, self.n2) for _ in range(self.ne)]
        if self.whiten:
            self._enhance = [(_orthonormal(w), b) for w, b in self._enhance]
        self._extra = [
            (chunk, [draw(self.n_inputs, self.n1) for _ in range(m)], [draw(width, self.n2) for _ in range(e)]) for chunk, m, e in self.extra]

    @property
    def width(self) -> int:
        base = (self.nf * self.n1 if self.mapping else 0) + self.ne * self.n2
        return base + sum(m * self.n1 + e * self.n2 for _, m, e in self.extra)

    def __call__(self, x: np.ndarray, chunk: np.ndarray | None = None) -> np.ndarray:
        if self.mean:
            x = (x - np.asarray(self.mean)) / (np.asarray(self.std) + 1e-6)
        z = np.hstack([_ACT[self.map_function](x @ w + b) for w, b in self._map]) if self.mapping else x
        parts = ([z] if self.mapping else []) + [_ACT[self.enhance_function](z @ w + b) for w, b in self._enhance]
        for start, mapped, enhanced in self._extra:
            on = np.ones((len(x), 1)) if chunk is None else (chunk >= start).astype(float)[:, None]
            parts += [_ACT[self.map_function](x @ w + b) * on for w, b in mapped]
            parts += [_ACT[self.enhance_function](z @ w + b) * on for w, b in enhanced]
        return np.hstack(parts)

    @classmethod
    def fitted(cls, warm: DataFrame, features: str, n_inputs: int, **options) -> "NodeMap":
        """Freeze the input scale from warm-up rows (one small aggregate row)."""
        at = [F.get(F.col(features), F.lit(i)) for i in range(n_inputs)]
        row = warm.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
        return cls(n_inputs, mean=tuple(row[:n_inputs]), std=tuple(row[n_inputs:]), **options)


def random_nodes(df: DataFrame, features: str, nodes: NodeMap, name: str = "nodes") -> DataFrame:
    """Node values of each row as ARRAY<DOUBLE>: one matrix product per Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(frames):
        for f in frames:
            if len(f):
                yield f.assign(**{name: list(nodes(np.stack(f[features].to_numpy()).astype(float)))})

    return df.mapInPandas(run, schema)


@dataclasses.dataclass
class BroadLearner:
    """Ridge on random nodes; ``mode`` adds a smoothness term in which unlabelled rows count too.

    plain:  AtA + reg I
    anchor: + gamma (A - SK)t (A - SK), S the similarity to fixed anchors with nodes K
    graph:  + gamma At L A, L the Laplacian of the nearest-neighbour graph inside a chunk
    """

    nodes: NodeMap
    n_classes: int
    reg: float = 0.001
    mode: str = "plain"
    gamma: float = 0.005
    anchors: np.ndarray | None = None
    sigma: float = 5.0
    anchor_k: int = 5
    graph_k: int = 10

    def __post_init__(self):
        if self.mode not in ("plain", "anchor", "graph"):
            raise ValueError("mode must be 'plain', 'anchor' or 'graph'")
        if self.mode == "anchor" and self.anchors is None:
            raise ValueError("anchor mode needs anchors")

    # one chunk's contribution -------------------------------------------------------------------

    def similarity(self, x: np.ndarray) -> np.ndarray:
        d = ((x[:, None, :] - self.anchors[None]) ** 2).sum(axis=2)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.anchor_k]
        s = np.zeros_like(d)
        np.put_along_axis(s, near, np.exp(-np.take_along_axis(d, near, 1) / (2 * self.sigma**2)), axis=1)
        return s / (s.sum(axis=1, keepdims=True) + 1e-10)

    def graph_edges(self, x: np.ndarray, held: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Ends (i < j) of the undirected nearest-neighbour graph; at most about ``held`` differences are in memory."""
        k, n = min(self.graph_k, len(x) - 1), len(x)
        block = max(1, held // max(1, x.size))
        found = [np.zeros(0, np.int64)]
        for at in range(0, n if k > 0 else 0, block):
            rows = np.arange(at, min(n, at + block))
            d = ((x[rows, None, :] - x[None]) ** 2).sum(axis=2)
            d[np.arange(len(rows)), rows] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k].ravel()
            own = np.repeat(rows, k)
            found.append(np.minimum(own, near) * n + np.maximum(own, near))
        both = np.unique(np.concatenate(found))
        return both // n, both % n

    def add(self, gram: np.ndarray, xty: np.ndarray, x: np.ndarray, y: np.ndarray, chunk: np.ndarray | None) -> None:
        """Add rows to the sums in place; a negative label means unlabelled."""
        a = self.nodes(x, chunk)
        known = y >= 0
        al = a[known]
        gram += al.T @ al
        np.add.at(xty.T, y[known], al)
        if self.mode == "anchor":
            gap = a - self.similarity(x) @ self.nodes(self.anchors)
            gram += self.gamma * gap.T @ gap
        elif self.mode == "graph":
            scaled = (x - np.asarray(self.nodes.mean)) / (np.asarray(self.nodes.std) + 1e-6) if self.nodes.mean else x
            i, j = self.graph_edges(scaled)
            for at in range(0, len(i), 1 << 14):  # At L A is the sum over edges of the outer products of differences
                gap = a[i[at : at + (1 << 14)]] - a[j[at : at + (1 << 14)]]
                gram += self.gamma * gap.T @ gap

    def solve(self, gram: np.ndarray, xty: np.ndarray) -> np.ndarray:
        return np.linalg.solve(gram + self.reg * np.eye(len(gram)), xty)

    # distributed plan ---------------------------------------------------------------------------

    def stats(self, df: DataFrame, by: list[str], chunk: str, features: str, label: str, salts: int = 1, group: str | None = None) -> DataFrame:
        """(by*, chunk, n, gram, xty) per chunk, from partial sums of the partitions as they are: rows are not shuffled.

        ``group`` names a column of several chunks each to sum by instead (not for graphs).  Only a chunk's graph needs its rows together; the chunk length, a parameter of the run, bounds them.
        """
        d, c = self.nodes.width, self.n_classes
        keys = [*by, group or chunk]
        rows = df.select(*dict.fromkeys([*keys, chunk]), F.col(features).alias("__x"), F.coalesce(F.col(label), F.lit(-1)).cast("int").alias("__y")).filter(
            F.col("__x").isNotNull())
        schema = T.StructType([rows.schema[k] for k in keys] + [
            T.StructField("n", T.LongType()), T.StructField("gram", T.ArrayType(T.DoubleType())), T.StructField("xty", T.ArrayType(T.DoubleType()))])

        def start():
            return [0, np.zeros((d, d)), np.zeros((d, c)), []]

        def add(acc, part: pd.DataFrame):
            acc[0] += len(part)
            if self.mode == "graph":
                acc[3].append(part)
            else:
                self._add_frame(acc, part, chunk)
            return acc

        def finish(acc):
            if acc[3]:
                self._add_frame(acc, pd.concat(acc[3], ignore_index=True), chunk)
            return {"n": acc[0], "gram": acc[1].ravel(), "xty": acc[2].ravel()}

        if self.mode == "graph":
            return fold_blocks(rows, keys, start, add, finish, schema)
        hold = max(1, (64 << 20) // (8 * d * (d + c)))  # 64 MB of sums in a task
        return sum_arrays(partial_blocks(rows, keys, start, add, finish, schema, hold=hold), keys, ["gram", "xty"], ["n"])

    def _add_frame(self, acc, part: pd.DataFrame, chunk: str) -> None:
        x = np.stack(part["__x"].to_numpy()).astype(float)
        self.add(acc[1], acc[2], x, part["__y"].to_numpy(), part[chunk].to_numpy())

    def models(self, stats: DataFrame, by: list[str], chunk: str, *, span: int = 64) -> DataFrame:
        """(by*, chunk, w): the solved weights of all strictly earlier chunks.

        Runs of ``span`` chunks are scanned in parallel, each starting from the summed blocks before
        it; those block sums are prefixed per array position, so no task adds up the whole stream.
        """
        d, c = self.nodes.width, self.n_classes
        fixed = materialize(stats.withColumn("__block", F.expr(f"cast(`{chunk}` as bigint) div {span}")), "chunk-stats")
        offsets = self._offsets(sum_arrays(fixed, [*by, "__block"], ["gram", "xty"], ["n"]), by)
        rows = fixed.select(*by, "__block", chunk, "gram", "xty")
        schema = T.StructType([rows.schema[k] for k in [*by, chunk]] + [T.StructField("w", T.ArrayType(T.DoubleType()))])
        state = {}

        def scan(part: pd.DataFrame, side: dict | None):
            # a block's chunks may arrive in several batches: carry the running sums between them
            key = tuple(part[k].iloc[0] for k in [*by, "__block"])
            if state.get("key") != key:
                both = np.asarray(side["both"])
                state.update(key=key, gram=both[: d * d].reshape(d, d).copy(), xty=both[d * d :].reshape(d, c).copy())
            ws = []
            for g, t in zip(part["gram"], part["xty"]):
                ws.append(self.solve(state["gram"], state["xty"]).ravel())
                state["gram"] = state["gram"] + np.asarray(g).reshape(d, d)
                state["xty"] = state["xty"] + np.asarray(t).reshape(d, c)
            return part[[*by, chunk]].assign(w=ws)

        return stream_past(rows, offsets, [*by, "__block"], ["both"], scan, schema, order=[chunk])

    def _offsets(self, totals: DataFrame, by: list[str]) -> DataFrame:
        """(by*, __block, both): the sums of all strictly earlier blocks, AtA then AtY."""
        cells = totals.select(*by, "__block", F.posexplode(F.concat("gram", "xty")).alias("pos", "v"))
        before = Window.partitionBy(*by, "pos").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        prefixed = cells.withColumn("v", F.coalesce(F.sum("v").over(before), F.lit(0.0)))
        packed = prefixed.groupBy(*by, "__block").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
        return packed.select(*by, "__block", F.transform("p", lambda e: e["v"]).alias("both"))

    def score(self, df: DataFrame, models: DataFrame, on: list[str], chunk: str, features: str, *, salts: int = 1, small: int = 64 << 20) -> DataFrame:
        """Add ``y_pred`` and ``proba`` (softmax); a chunk without a model gets class 0.

        The models are written and their size is taken: up to ``small`` bytes go to every task, and rows are scored
        where they are read; beyond that, rows and models meet by a shuffle on ``on``.
        """
        d, c = self.nodes.width, self.n_classes
        schema = T.StructType([*df.schema.fields, T.StructField("y_pred", T.IntegerType()), T.StructField("proba", T.ArrayType(T.DoubleType()))])
        models = materialize(models, "broad-models")
        scored = lambda part, w: self._answered(part, w, chunk, features)
        usable = df.filter(F.col(features).isNotNull())
        if models.count() * d * c * 8 <= small:
            key = lambda values: tuple(None if pd.isna(v) else v for v in values)
            known = {key(r[k] for k in on): np.asarray(r["w"]).reshape(d, c) for r in models.select(*on, "w").collect()}
            sent, none = df.sparkSession.sparkContext.broadcast(known), np.zeros((d, c))

            def local(frames):
                for f in frames:
                    if len(f):
                        for values, part in f.groupby(on, sort=False, dropna=False):
                            yield scored(part.reset_index(drop=True), sent.value.get(key(values), none))

            return usable.mapInPandas(local, schema)

        def run(part: pd.DataFrame, side: dict | None):
            return scored(part, np.asarray(side["w"]).reshape(d, c) if side else np.zeros((d, c)))

        return stream_past(usable, models, on, ["w"], run, schema, salts=salts)

    def _answered(self, part: pd.DataFrame, w: np.ndarray, chunk: str, features: str) -> pd.DataFrame:
        x = np.stack(part[features].to_numpy()).astype(float)
        logit = self.nodes(x, part[chunk].to_numpy()) @ w
        e = np.exp(logit - logit.max(axis=1, keepdims=True))
        return part.assign(y_pred=logit.argmax(axis=1).astype(np.int32), proba=list(e / e.sum(axis=1, keepdims=True)))

    def _streamed(self, learn: DataFrame, out: list[T.StructField], by: list[str], chunk: str, features: str, label: str, span: int) -> DataFrame:
        """``prequential`` of small chunks: a block of ``span`` chunks passes a task row by row, from the sums of the blocks before it.

        No sums or weights of single chunks are kept: a task holds one pair of sums and a batch of rows.  Rows without a chunk
        get class 0 and are not learned.
        """
        d, c = self.nodes.width, self.n_classes
        blocked = learn.filter(F.col(features).isNotNull()).withColumn("__block", F.expr(f"cast(`{chunk}` as bigint) div {span}"))
        totals = materialize(self.stats(blocked.filter("__block IS NOT NULL"), by, chunk, features, label, group="__block"), "block-stats")
        schema = T.StructType([*out, T.StructField("y_pred", T.IntegerType()), T.StructField("proba", T.ArrayType(T.DoubleType()))])
        names = [f.name for f in schema]
        rows = blocked.withColumn("__y", F.coalesce(F.col(label), F.lit(-1)).cast("int"))
        state = {}

        def scan(part: pd.DataFrame, side: dict | None) -> pd.DataFrame:
            if side is None:  # rows without a chunk
                return self._answered(part, np.zeros((d, c)), chunk, features)[names]
            key = tuple(part[k].iloc[0] for k in [*by, "__block"])
            if state.get("key") != key:
                both = np.asarray(side["both"])
                state.update(key=key, chunk=None, gram=both[: d * d].reshape(d, d).copy(), xty=both[d * d :].reshape(d, c).copy())
            answered = []
            at = part[chunk].to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if state["chunk"] is None or state["chunk"] != at[lo]:  # a chunk that goes on in the next batch keeps its weights
                    state.update(chunk=at[lo], w=self.solve(state["gram"], state["xty"]))
                rows = part.iloc[lo:hi]
                answered.append(self._answered(rows, state["w"], chunk, features)[names])
                self.add(state["gram"], state["xty"], np.stack(rows[features].to_numpy()).astype(float), rows["__y"].to_numpy(), at[lo:hi])
            return pd.concat(answered, ignore_index=True)

        return stream_past(rows, self._offsets(totals, by), [*by, "__block"], ["both"], scan, schema, order=[chunk])

    def prequential(self, df: DataFrame, by: list[str], chunk: str, features: str, label: str, *, train_label: Column | None = None, salts: int = 1,
                    span: int = 64) -> DataFrame:
        """Chunk t scored by the model of the chunks before it.  ``train_label`` (null = unlabelled) may
        hide labels from training.

        A chunk's sums take the square of the nodes, whatever its rows.  Where no chunk has over eight rows a node, and no
        graph needs a chunk's rows together, rows are shuffled in blocks of ``span`` chunks and only blocks have sums.
        """
        learn = df if train_label is None else df.withColumn("__train", train_label)
        if self.mode != "graph":
            most = df.groupBy(*by, chunk).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            if most is not None and most <= 8 * self.nodes.width:
                return self._streamed(learn, list(df.schema.fields), by, chunk, features, label if train_label is None else "__train", span)
        stats = self.stats(learn, by, chunk, features, label if train_label is None else "__train", salts)
        return self.score(df, self.models(stats, by, chunk), [*by, chunk], chunk, features, salts=salts)


def gram_columns(df: DataFrame, by: list[str], features: list[str], targets: list[str], weight: Column | None = None) -> DataFrame:
    """Sums of products x_i x_j (upper triangle) and x_i y_k per group, as plain columns."""
    w = F.lit(1.0) if weight is None else weight
    aggs = [F.count("*").alias("n")]
    for i, a in enumerate(features):
        aggs += [F.sum(w * F.col(a) * F.col(b)).alias(f"g{i}_{j}") for j, b in enumerate(features) if j >= i]
        aggs += [F.sum(w * F.col(a) * F.col(t)).alias(f"t{i}_{k}") for k, t in enumerate(targets)]
    return df.groupBy(*by).agg(*aggs)


def mvn_oas(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Mean and OAS-shrunk covariance per group: (by*, n, mean ARRAY, cov ARRAY row-major).

    Shrinkage towards trace/p times the identity, intensity
    ((1 - 2/p) tr(S^2) + tr(S)^2) / ((n + 1 - 2/p) (tr(S^2) - tr(S)^2 / p)), at most 1.
    """
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    aggs = [F.count("*").alias("n")] + [F.avg(f).alias(f"__m{i}") for i, f in enumerate(features)]
    aggs += [F.covar_pop(features[i], features[j]).alias(f"__c{i}_{j}") for i, j in pairs]
    g = df.groupBy(*by).agg(*aggs)
    cov = lambda i, j: F.col(f"__c{min(i, j)}_{max(i, j)}")
    trace = sum((cov(i, i) for i in range(p)), F.lit(0.0))
    square = sum((cov(i, j) * cov(i, j) for i in range(p) for j in range(p)), F.lit(0.0))
    g = g.withColumn("__tr", trace).withColumn("__sq", square)
    top = (1 - 2.0 / p) * F.col("__sq") + F.col("__tr") * F.col("__tr")
    low = (F.col("n") + 1 - 2.0 / p) * (F.col("__sq") - F.col("__tr") * F.col("__tr") / p)
    g = g.withColumn("shrinkage", F.when(low == 0, 1.0).otherwise(F.least(F.lit(1.0), top / low)))
    shrunk = [
        (1 - F.col("shrinkage")) * cov(i, j) + (F.col("shrinkage") * F.col("__tr") / p if i == j else F.lit(0.0))
        for i in range(p) for j in range(p)]
    return g.select(*by, "n", F.array(*[F.col(f"__m{i}") for i in range(p)]).alias("mean"), F.array(*shrunk).alias("cov"), "shrinkage")
