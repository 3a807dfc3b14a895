"""Whole runs: test-then-train over chunks, with label selection, and experiment grids."""

from __future__ import annotations

import dataclasses
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.bayes import Sums
from tidemark.operators import naive_bayes as nb
from tidemark.operators.broad import BroadLearner, NodeMap
from tidemark.plans.blocks import sum_arrays
from tidemark.plans.scan import running
from tidemark.session import scratch_path


def experiment_grid(df: DataFrame, cells: list[dict]) -> DataFrame:
    """Every row once per experiment cell; the cell's settings become key columns, so the whole
    grid is one job."""
    if not cells:
        raise ValueError("the grid has no cells")
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in cell.items()]) for cell in cells]
    spread = df.withColumn("__cell", F.explode(F.array(*structs)))
    return spread.select(*df.columns, *[F.col(f"__cell.{k}").alias(k) for k in cells[0]])


@dataclasses.dataclass
class BayesModel:
    """Naive Bayes kept as sums on the driver: classes x features numbers."""

    features: list[str]
    label: str
    classes: list[int]
    sums: dict | None = None

    def score(self, df: DataFrame) -> DataFrame:
        names = nb.stat_names(len(self.features), self.classes)
        sums = self.sums or dict.fromkeys(names, 0.0)
        spark = df.sparkSession
        one = spark.createDataFrame([[float(sums[n]) for n in names]], ", ".join(f"{n} double" for n in names))
        params = nb.parameters(one, len(self.features), self.classes).first().asDict()
        return nb.predict_nb(df, params, self.features, self.classes, proba="proba")

    def learn(self, rows: DataFrame) -> "BayesModel":
        row = nb.nb_stats(rows, [], self.features, self.label, self.classes).first().asDict()
        old = self.sums or dict.fromkeys(row, 0.0)
        return dataclasses.replace(self, sums={k: old[k] + (v or 0.0) for k, v in row.items()})

    def score_held(self, f: pd.DataFrame) -> pd.DataFrame:
        """``score`` of a chunk that a task holds."""
        sums, d = self.sums or dict.fromkeys(nb.stat_names(len(self.features), self.classes), 0.0), len(self.features)
        of = lambda kind: np.array([[sums[f"{kind}{c}_{j}"] for j in range(d)] for c in self.classes])
        x = f[self.features].to_numpy(dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = Sums(np.array([sums[f"n{c}"] for c in self.classes]), of("s"), of("q")).log_joint(x)
            top = logs.max(axis=1, keepdims=True)
            e = np.where(np.isneginf(top), 1.0, np.exp(logs - top))
        gap = np.isnan(x).any(axis=1)
        e[gap] = np.nan
        pred = pd.array(np.asarray(self.classes)[np.where(gap, 0, logs.argmax(axis=1))], dtype="Int32")
        pred[gap] = pd.NA
        return f.assign(y_pred=pred, proba=list(e / e.sum(axis=1, keepdims=True)))

    def learn_held(self, f: pd.DataFrame, known: np.ndarray) -> "BayesModel":
        """``learn`` of a chunk that a task holds, from the labels where ``known``."""
        x, y = f[self.features].to_numpy(dtype=float), f[self.label].to_numpy(dtype=float)
        usable = known & ~np.isnan(x).any(axis=1)
        sums = dict(self.sums or dict.fromkeys(nb.stat_names(len(self.features), self.classes), 0.0))
        for c in self.classes:
            own = x[usable & (y == c)]
            sums[f"n{c}"] += float(len(own))
            for j, (s, q) in enumerate(zip(own.sum(axis=0), (own * own).sum(axis=0))):
                sums[f"s{c}_{j}"] += float(s)
                sums[f"q{c}_{j}"] += float(q)
        return dataclasses.replace(self, sums=sums)


@dataclasses.dataclass
class BroadModel:
    """Random-feature ridge kept as its two sums on the driver (nodes x nodes numbers); rows that were
    not asked still reach it, unlabelled."""

    learner: BroadLearner
    features: str
    label: str
    chunk: str
    gram: np.ndarray | None = None
    xty: np.ndarray | None = None
    salts: int = 8

    def score(self, df: DataFrame) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("y_pred", T.IntegerType()), T.StructField("proba", T.ArrayType(T.DoubleType()))])
        w = self._weights()

        def run(frames):
            for f in frames:
                if len(f):
                    yield self._scored(f, w)

        return df.mapInPandas(run, schema)

    def _weights(self) -> np.ndarray:
        d, c = self.learner.nodes.width, self.learner.n_classes
        return np.zeros((d, c)) if self.gram is None else self.learner.solve(self.gram, self.xty)

    def _scored(self, f: pd.DataFrame, w: np.ndarray) -> pd.DataFrame:
        logit = self.learner.nodes(np.stack(f[self.features].to_numpy()).astype(float), f[self.chunk].to_numpy()) @ w
        e = np.exp(logit - logit.max(axis=1, keepdims=True))
        return f.assign(y_pred=logit.argmax(axis=1).astype(np.int32), proba=list(e / e.sum(axis=1, keepdims=True)))

    def score_held(self, f: pd.DataFrame) -> pd.DataFrame:
        """``score`` of a chunk that a task holds."""
        return self._scored(f, self._weights())

    def learn_held(self, f: pd.DataFrame, known: np.ndarray) -> "BroadModel":
        """``learn`` of a chunk that a task holds, from the labels where ``known``; the other rows are unlabelled."""
        d, c = self.learner.nodes.width, self.learner.n_classes
        gram, xty = (np.zeros((d, d)), np.zeros((d, c))) if self.gram is None else (self.gram.copy(), self.xty.copy())
        there = f[self.features].notna().to_numpy()
        if there.any():
            y = f[self.label].to_numpy(dtype=float)
            y = np.where(known & ~np.isnan(y), y, -1)[there].astype(np.int64)
            self.learner.add(gram, xty, np.stack(f[self.features].to_numpy()[there]).astype(float), y, f[self.chunk].to_numpy()[there])
        return dataclasses.replace(self, gram=gram, xty=xty)

    def learn(self, rows: DataFrame) -> "BroadModel":
        d, c = self.learner.nodes.width, self.learner.n_classes
        stats = self.learner.stats(rows, [], self.chunk, self.features, self.label, self.salts).withColumn("__all", F.lit(0))
        total = sum_arrays(stats, ["__all"], ["gram", "xty"], ["n"]).first()
        if total is None:
            return self
        gram, xty = np.array(total["gram"]).reshape(d, d), np.array(total["xty"]).reshape(d, c)
        old = (0.0, 0.0) if self.gram is None else (self.gram, self.xty)
        return dataclasses.replace(self, gram=old[0] + gram, xty=old[1] + xty)


HELD_ROWS, SEGMENT_ROWS = 100_000, 500_000


class _Held:
    """A run over chunks that come one after the other in a task: the model, what the selector remembers, and counts."""

    def __init__(self, model, selector: Callable, chunk: str, order: str, warm: int, semi: bool, budget: float | None):
        self.model, self.selector, self.chunk, self.order, self.semi, self.budget = model, selector, chunk, order, semi, budget
        self.warm, self.seen, self.asked, self.memory = warm, 0, 0, {}

    def step(self, rows: pa.Table) -> pa.Table | None:
        frame = rows.to_pandas()
        if self.warm:
            self.warm -= 1
            self.model = self.model.learn_held(frame, np.ones(len(frame), bool))
            return None
        chosen = self.selector(self.model.score_held(frame), self.memory)
        wanted = chosen["is_queried"].astype("boolean")
        if self.budget is not None:
            allowed = max(int(self.budget * (self.seen + len(chosen))) - self.asked, 0)
            at = chosen[self.order].reset_index(drop=True).sort_values(kind="stable", na_position="first").index.to_numpy()
            before = np.empty(len(chosen), np.int64)
            before[at] = np.cumsum(wanted.fillna(False).to_numpy(dtype=bool)[at])
            wanted = wanted & pd.array(before <= allowed, dtype="boolean")
        asked = wanted.fillna(False).to_numpy(dtype=bool)
        learn = chosen if self.semi else chosen[asked]
        self.model = self.model.learn_held(learn, asked if self.semi else np.ones(len(learn), bool))
        self.seen, self.asked = self.seen + len(chosen), self.asked + int(asked.sum())
        proba = [None if p is None else [None if np.isnan(v) else v for v in p] for p in chosen["proba"]]
        out = rows.take(pa.array(chosen.index.to_numpy(dtype=np.int64)))
        out = out.append_column("y_pred", pa.array(chosen["y_pred"].astype("Int32"), pa.int32()))
        out = out.append_column("proba", pa.array(proba, pa.list_(pa.float64())))
        return out.append_column("is_queried", pa.array(wanted, pa.bool_()))

    def pieces(self) -> Iterator[bytes]:
        """What a later task needs to go on; the memory of many keys in several pieces."""
        yield pickle.dumps((self.model, self.warm, self.seen, self.asked))
        items = list(self.memory.items())
        for at in range(0, len(items), 50_000):
            yield pickle.dumps(items[at : at + 50_000])

    def resume(self, pieces: list[bytes]) -> None:
        for piece in pieces:
            found = pickle.loads(piece)  # written by ``pieces`` in an earlier task of this run
            if isinstance(found, tuple):
                self.model, self.warm, self.seen, self.asked = found
            else:
                self.memory.update(found)


def _held_run(df: DataFrame, chunk: str, order: str, counts: list[tuple], run: _Held) -> DataFrame:
    """``run`` over all chunks, in segments of about ``SEGMENT_ROWS`` rows: one task each, which begins with the state that the last one wrote."""
    spark = df.sparkSession
    root = scratch_path(spark, "active-run")
    firsts, size = [], 0
    for value, n in counts:
        if not firsts or size + n > SEGMENT_ROWS:
            firsts, size = [*firsts, value], 0
        size += n
    out = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema], T.StructField("y_pred", T.IntegerType()),
                        T.StructField("proba", T.ArrayType(T.DoubleType())), T.StructField("is_queried", T.BooleanType()), T.StructField("__state", T.BinaryType())])
    if not firsts:
        return spark.createDataFrame([], T.StructType(out.fields[:-1]))
    segment = F.size(F.filter(F.array(*[F.lit(v) for v in firsts]), lambda v: v <= F.col(chunk)))
    parted = df.filter(F.col(chunk).isNotNull()).withColumn("__part", segment)
    parted.write.partitionBy("__part").parquet(f"{root}/source")
    source = spark.read.schema(parted.schema).parquet(f"{root}/source")
    names = df.columns

    def go(batches):
        held, parts, key, states = run, [], None, []

        def close():
            done = held.step(pa.Table.from_batches(parts).combine_chunks())
            if done is not None and done.num_rows:
                for batch in done.append_column("__state", pa.nulls(done.num_rows, pa.binary())).to_batches():
                    yield batch.select([f.name for f in out])

        for batch in batches:
            if not batch.num_rows:
                continue
            saved = batch.column("__state")
            n = batch.num_rows - saved.null_count  # states come first
            states += saved.slice(0, n).to_pylist()
            batch = batch.slice(n).select(names)
            if not batch.num_rows:
                continue
            if states:
                held.resume(states)
                states = []
            at = batch.column(chunk).to_pandas().reset_index(drop=True)
            edges = [0, *np.flatnonzero((at != at.shift()).to_numpy())[1:].tolist(), len(at)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if parts and at[lo] != key:
                    yield from close()
                    parts = []
                key = at[lo]
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from close()
        left = list(held.pieces())
        blank = [pa.nulls(len(left), t.type) for t in pa_schema(out)[:-1]]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(left, pa.binary())], [f.name for f in out])

    done = []
    for i in range(len(firsts)):
        now = source.filter(F.col("__part") == F.lit(i + 1)).select(*names).withColumn("__state", F.lit(None).cast("binary"))
        if done:
            now = now.unionByName(spark.read.schema(out).parquet(done[-1]).filter("__state IS NOT NULL").select("__state"), allowMissingColumns=True)
        place = [F.col("__state").isNull(), F.col(chunk), *([F.col(order)] if order in names else [])]
        path = f"{root}/segment-{i}"
        now.coalesce(1).sortWithinPartitions(*place).mapInArrow(go, out).write.parquet(path)
        done.append(path)
    return spark.read.schema(out).parquet(*done).filter("__state IS NULL").drop("__state")


def pa_schema(schema: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def prequential_active(
    df: DataFrame, model, chunk: str, label: str, selector: Callable[[DataFrame], DataFrame], *, warm_chunks: int = 1, semi: bool = False,
    budget: float | None = None, order: str = "seq", held: Callable | None = None,
) -> DataFrame:
    """Score a chunk, choose the rows to label, learn from them, go on.

    The choice depends on the model and the model on the choice, so chunks run one after the other; inside
    a chunk everything is parallel.  The source is written once by chunk, so a step reads its own chunk only; each
    scored chunk is a written table, and only the model's sums pass through the driver.  ``selector`` adds
    ``is_queried``; with ``semi`` rows that were not asked are learned without their label.  ``budget`` limits the
    share of labelled rows so far: a chunk that would exceed it keeps its first wanted rows in ``order``, found
    by a prefix count.  Rows without a chunk take no part.

    ``held`` is the selector of a chunk that a task holds: ``held(frame, memory)`` with a dict that is kept from chunk to
    chunk.  Where it is given and no chunk has over ``HELD_ROWS`` rows, a step would take longer to plan than to run,
    and the chunks pass one after the other through a task, in segments of bounded size.
    """
    spark = df.sparkSession
    if held is not None:
        sizes = df.filter(F.col(chunk).isNotNull()).groupBy(chunk).agg(F.count(F.lit(1)).alias("n"))
        counts = [(r[0], r[1]) for r in sizes.orderBy(chunk).collect()]  # a row per chunk
        if max((n for _, n in counts), default=0) <= HELD_ROWS:
            return _held_run(df, chunk, order, counts, _Held(model, held, chunk, order, warm_chunks, semi, budget))
    root = scratch_path(spark, "active-run")
    parted = df.filter(F.col(chunk).isNotNull()).withColumn("__part", F.col(chunk))
    parted.write.partitionBy("__part").parquet(f"{root}/source")
    source = spark.read.schema(parted.schema).parquet(f"{root}/source")
    chunks = [r[0] for r in source.select("__part").distinct().orderBy("__part").collect()]  # from the names of the folders
    seen = asked = 0
    done = []
    for i, c in enumerate(chunks):
        now = source.filter(F.col("__part") == F.lit(c)).select(*df.columns)  # reads one folder
        if i < warm_chunks:
            model = model.learn(now)
            continue
        chosen = selector(model.score(now))
        path = f"{root}/chunk-{i}"
        if budget is not None:
            chosen.write.parquet(f"{path}-wanted")
            wanted = spark.read.parquet(f"{path}-wanted")
            allowed = max(int(budget * (seen + wanted.count())) - asked, 0)
            counted = running(wanted, [], order, {"__wanted": ("sum", "cast(is_queried as bigint)")})
            chosen = counted.withColumn("is_queried", F.col("is_queried") & (F.col("__wanted") <= F.lit(allowed))).select(*wanted.columns)
        chosen.write.parquet(path)
        done.append(path)
        scored = spark.read.parquet(path)
        if semi:
            model = model.learn(scored.withColumn(label, F.when(F.col("is_queried"), F.col(label))))
        else:
            model = model.learn(scored.filter("is_queried"))
        counts = scored.agg(F.count("*").alias("n"), F.count_if("is_queried").alias("q")).first()
        seen, asked = seen + counts["n"], asked + counts["q"]
    if not done:  # no chunk is left after the warm-up
        return selector(model.score(df.limit(0)))
    return spark.read.parquet(*done)


def active_by_name(
    df: DataFrame, learner: str, selector: str, *, chunk: str, order: str, features: list[str], label: str, n_classes: int,
    keys: list[str] | None = None, warm_chunks: int = 1, budget: float | None = None,
) -> DataFrame:
    """An active run of a learner (``naive_bayes`` or ``broad``) and a selector of the registry, by their names.

    Selectors that remember earlier answers go on from chunk to chunk: they see one stream per key.
    """
    from tidemark.registry import SELECTORS, names_of

    choose = SELECTORS[names_of(selector, SELECTORS)[0]]
    memory: dict = {}
    ask = lambda scored: choose(scored, keys or [], order, features, label, n_classes, memory)
    held = lambda frame, known: choose(frame, keys or [], order, features, label, n_classes, known)
    if learner == "naive_bayes":
        model, rows = BayesModel(features, label, list(range(n_classes))), df
    elif learner == "broad":
        rows = df.withColumn("__x", F.array(*[F.col(f).cast("double") for f in features]))
        first = rows.agg(F.min(chunk)).first()[0]
        nodes = NodeMap.fitted(rows.filter(F.col(chunk) == F.lit(first)), "__x", len(features))
        model = BroadModel(BroadLearner(nodes, n_classes), "__x", label, chunk)
    else:
        raise ValueError("an active run learns by sums: choose 'naive_bayes' or 'broad'")
    return prequential_active(rows, model, chunk, label, ask, warm_chunks=warm_chunks, budget=budget, order=order, held=held)


def annotation_rate(scored: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows whose label was asked."""
    return scored.groupBy(*by).agg(F.avg(F.col("is_queried").cast("int")).alias("annotation_rate"))


def replay_refit(
    labelled: DataFrame, keys: list[str], order: str, features: list[str], label: str, classes: list[int], *, capacity: int = 100,
    proba: str | None = None, residual: float = 0.3,
) -> DataFrame:
    """Naive Bayes sums over the newest ``capacity`` labelled rows per key.

    With ``proba`` only keys whose newest row was predicted well - the distance between its normalised
    probabilities and its one-hot label is at most ``residual`` - are refitted.
    """
    from tidemark.functions.arrays import minmax_sum_normalize, one_hot
    from tidemark.operators.select import recent_per_class

    newest = recent_per_class(labelled.withColumn("__all", F.lit(0)), keys, "__all", order, capacity)
    if proba:
        gap: Column = F.sqrt(F.aggregate(
            F.zip_with(minmax_sum_normalize(F.col(proba)), one_hot(F.col(label), len(classes)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        good = newest.filter(F.col("age") == 1).withColumn("__gap", gap).filter(F.col("__gap") <= residual).select(*keys)
        newest = newest.join(good, keys, "left_semi")
    return nb.nb_stats(newest, keys, features, label, classes)
