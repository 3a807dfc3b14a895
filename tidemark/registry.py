"""Learners, selectors, regressors and detectors by name, and the run that compares several of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import range_margin, top2_margin
from tidemark.functions.hashing import hash_uniform
from tidemark.operators import broad as br
from tidemark.operators import boosting, detect, ensembles, naive_bayes, regress, trees
from tidemark.operators import select as sel
from tidemark.operators.neighbors import window_knn_regress
from tidemark.plans.keyed import keyed_scan


def _broad(mode: str = "plain", mapping: bool = True, extra: tuple = (), whiten: bool = True) -> Callable:
    def run(df, keys, order, chunk, features, label, n_classes):
        packed = df.withColumn("features", F.array(*[F.col(f).cast("double") for f in features]))
        first = df.agg(F.min(chunk)).first()[0]
        warm = packed.filter(F.col(chunk) == F.lit(first))
        nodes = br.NodeMap.fitted(warm, "features", len(features), mapping=mapping, extra=extra, whiten=whiten)
        options = {}
        if mode == "anchor":
            import numpy as np

            options["anchors"] = np.array([r["features"] for r in warm.orderBy(order).limit(20).select("features").collect()])
        learner = br.BroadLearner(nodes, n_classes, mode=mode, **options)
        return learner.prequential(packed, keys, chunk, "features", label).drop("features", "proba")

    return run


def _nb(df, keys, order, chunk, features, label, n_classes):
    return naive_bayes.chunked_nb(df, keys, chunk, features, label, list(range(n_classes)))


def _bag(scheme: str) -> Callable:
    def run(df, keys, order, chunk, features, label, n_classes):
        return ensembles.bagged_nb(df, keys, chunk, order, features, label, list(range(n_classes)), scheme=scheme, order=order)

    return run


def _adaptive_bag(members: int, patches: bool, detector: detect.Machine | None = None) -> Callable:
    def run(df, keys, order, chunk, features, label, n_classes):
        spaces = None
        if patches:
            from tidemark.operators.features import subspaces

            spaces = {r["member"]: list(r["features"]) for r in subspaces(df.sparkSession, len(features), members).collect()}
        out = ensembles.bagged_stream(df, keys, order, features, label, n_classes, members=members, subspaces=spaces, detector=detector)
        return out.withColumnRenamed("y_true", label)

    return run


def _machine(make: Callable, as_map: bool = False) -> Callable:
    def run(df, keys, order, chunk, features, label, n_classes):
        from tidemark.functions.maps import to_sparse_map

        vec = F.array(*[F.col(f).cast("double") for f in features])
        rows = df.select(*keys, order, (to_sparse_map(vec) if as_map else vec).alias("features"), F.col(label).cast("int").alias("label"),
                         hash_uniform(F.col(order), "draw").alias("draw"))
        return keyed_scan(rows, keys, order, make(n_classes), keep=("label",)).withColumnRenamed("label", label)

    return run


def _chunk_ensemble(df, keys, order, chunk, features, label, n_classes):
    return ensembles.chunk_weighted_ensemble(df, chunk, order, features, label)[0].withColumnRenamed("y_true", label)


def _majority(df, keys, order, chunk, features, label, n_classes):
    return boosting.dynamic_majority(df, keys, chunk, features, label, list(range(n_classes)))[0]


def _boost(df, keys, order, chunk, features, label, n_classes):
    return boosting.cost_boost(df, keys, chunk, features, label, list(range(n_classes)))


def _tree(df, keys, order, chunk, features, label, n_classes):
    return trees.hoeffding_tree(df, keys, chunk, features, label, list(range(n_classes)))


# every learner is run(df, keys, order, chunk, features, label, n_classes) -> rows with ``label`` and ``y_pred``
CLASSIFIERS: dict[str, Callable] = {
    "naive_bayes": _nb,
    "broad": _broad(),
    "broad_growth": _broad(extra=((2, 1, 1),)),
    "semi_broad_anchor": _broad("anchor"),
    "semi_broad_graph": _broad("graph", whiten=False),
    "semi_enhance_graph": _broad("graph", mapping=False, whiten=False),
    "bagging": _bag("online"),
    "leveraging_bagging": _bag("leveraging"),
    "oversampling_bagging": _bag("oversampling"),
    "adaptive_bagging": _adaptive_bag(10, patches=False),
    "random_patches": _adaptive_bag(3, patches=True),
    "adwin_bagging": _adaptive_bag(10, patches=False, detector=detect.Adwin(change=1e-3, warning=1e-2)),
    "adwin_random_patches": _adaptive_bag(3, patches=True, detector=detect.Adwin(change=1e-5, warning=1e-4)),
    "chunk_ensemble": _chunk_ensemble,
    "expert_selection": _machine(lambda n: ensembles.ExpertSelection()),
    "stable_dynamic": _machine(lambda n: ensembles.StableDynamic(n)),
    "stable_dynamic_reinforced": _machine(lambda n: ensembles.StableDynamic(n, reinforced=True, theta=0.5)),
    "varying_features": _machine(lambda n: ensembles.VaryingFeatures(), as_map=True),
    "dynamic_weights": _majority,
    "cost_boost": _boost,
    "hoeffding_tree": _tree,
}

NEED_KEYS = {"adwin_bagging", "adwin_random_patches", "adaptive_bagging", "random_patches", "expert_selection", "stable_dynamic", "stable_dynamic_reinforced", "varying_features"}
BINARY = {"oversampling_bagging", "chunk_ensemble", "expert_selection", "varying_features"}

def _remembering(make: Callable, inputs: Callable, held_inputs: Callable) -> Callable:
    """A rule with memory as a selector, per key in ``order``.

    With ``memory`` (a dict that the caller keeps) it goes on where its last call ended, else it starts anew.  Of a chunk
    that a task holds (a pandas frame), ``held_inputs`` gives the rule's columns, and ``memory`` has a state per key.
    """

    def select(scored, keys, order, features, label, n_classes, memory=None):
        if not keys:
            raise ValueError("a rule that remembers earlier answers needs key columns")
        held = {} if memory is None else memory
        if isinstance(scored, pd.DataFrame):
            return _remembered(scored, keys, order, make(n_classes), held_inputs(scored, order, features, label), held)
        rows = scored.select(*keys, order, *[c for c in ("proba", label, *features) if c in scored.columns])
        asked, held["states"] = sel.query_resumed(rows, keys, order, make(n_classes), inputs(order, features, label), held.get("states"))
        answers = asked.select(*[F.col(c).alias(f"__{c}") for c in [*keys, order]], "is_queried")
        same = F.lit(True)
        for c in [*keys, order]:  # a null key is a key
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return scored.join(answers, same).drop(*[f"__{c}" for c in [*keys, order]])

    return select


def _remembered(frame: pd.DataFrame, keys: list[str], order: str, machine, inputs: dict, states: dict) -> pd.DataFrame:
    """The rows of ``frame`` with ``is_queried``; ``states`` (per key) goes on."""
    at = frame[order].reset_index(drop=True).sort_values(kind="stable", na_position="first").index.to_numpy()
    code = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()[at]
    at = at[np.argsort(code, kind="stable")]
    edges = [0, *(np.flatnonzero(np.diff(np.sort(code, kind="stable"))) + 1).tolist(), len(at)]
    values = [frame[k].to_numpy() for k in keys]
    rows, asked = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        if lo == hi:
            continue
        mine = at[lo:hi]
        key = tuple(None if pd.isna(v[mine[0]]) else v[mine[0]] for v in values)
        state = states[key] if key in states else machine.start()
        states[key], out = machine.feed(state, {c: inputs[c][mine] for c in machine.inputs})
        rows.append(mine[np.asarray(out["row"], dtype=np.int64)])
        asked.append(out["is_queried"])
    if not rows:
        return frame.assign(is_queried=pd.array([], dtype="boolean"))
    answers = frame[[*keys, order]].iloc[np.concatenate(rows)].assign(is_queried=np.concatenate(asked))
    return frame.reset_index().merge(answers, on=[*keys, order], how="inner").set_index("index")


def _plain(fn: Callable) -> Callable:
    return lambda scored, keys, order, features, label, n_classes, memory=None: fn(scored, order)


def _least_sure(scored, order, size: int = 100):
    """The ``size`` rows of a chunk with the smallest margin."""
    if isinstance(scored, pd.DataFrame):
        return sel.query_least_sure(scored, [], "proba", order, size)
    return sel.query_least_sure(scored.withColumn("__one", F.lit(0)), ["__one"], "proba", order, size).drop("__one")


def _arrays(series: pd.Series) -> np.ndarray:
    """A column of arrays as a column of arrays, however its frame holds them."""
    out = np.empty(len(series), dtype=object)
    out[:] = [np.asarray(v, dtype=float) for v in series]
    return out


def _top2(series: pd.Series) -> np.ndarray:
    down = -np.sort(-np.stack(series.to_numpy()), axis=1)
    return down[:, 0] - down[:, 1]


_PROBA = lambda order, features, label: {"proba": F.col("proba"), "label": F.col(label)}
_VECTOR = lambda order, features, label: {"features": F.array(*[F.col(f).cast("double") for f in features]), "top": F.array_max("proba")}
_PROBA_HELD = lambda f, order, features, label: {"proba": _arrays(f["proba"]), "label": f[label].to_numpy()}
_VECTOR_HELD = lambda f, order, features, label: {
    "features": _arrays(pd.Series(list(f[features].to_numpy(dtype=float)))), "top": np.array([max(p) for p in f["proba"]], float)}

# every selector is select(scored, keys, order, features, label, n_classes, memory=None) -> scored rows with ``is_queried``;
# ``scored`` is a table or the pandas frame of a chunk
SELECTORS: dict[str, Callable] = {
    "all": _plain(lambda d, order: sel.query_all(d)),
    "random": _plain(lambda d, order: sel.query_random(d, order, 0.2)),
    "margin_fixed": _plain(lambda d, order: sel.query_margin_fixed(d, "proba", 0.5)),
    "top_per_chunk": _plain(_least_sure),
    "margin_variable": _remembering(
        lambda n: sel.MarginVariable(), lambda order, features, label: {"margin": range_margin(F.col("proba"))},
        lambda f, order, features, label: {"margin": sel.margins(f["proba"])}),
    "margin_or_random": _remembering(lambda n: sel.MarginOrRandom(n_classes=n), lambda order, features, label: {
        "margin": top2_margin(F.col("proba")), "draw": hash_uniform(F.col(order), "margin-or-random")},
        lambda f, order, features, label: {"margin": _top2(f["proba"]), "draw": sel.draws(f[order], "margin-or-random")}),
    "submodular": _remembering(lambda n: sel.Submodular(n), _PROBA, _PROBA_HELD),
    "submodular_dynamic": _remembering(lambda n: sel.SubmodularDynamic(n), _PROBA, _PROBA_HELD),
    "cognitive": _remembering(lambda n: sel.Cognitive(n_classes=n), _VECTOR, _VECTOR_HELD),
}


def _sgd(kind: str, rate: float) -> Callable:
    def run(df, keys, order, chunk, features, target):
        return regress.sgd_regression(df, keys, order, features, target, regress.Sgd(kind, rate=rate, warm=30))

    return run


def _as_true(fn: Callable) -> Callable:
    return lambda df, keys, order, chunk, features, target: fn(df, keys, order, chunk, features, target).withColumnRenamed(target, "y_true")


# run(df, keys, order, chunk, features, target) -> rows with ``y_true`` and ``y_pred``
REGRESSORS: dict[str, Callable] = {
    "sgd_linear": _sgd("linear", 0.02),
    "sgd_ridge": _sgd("ridge", 0.01),
    "sgd_lasso": _sgd("lasso", 0.01),
    "knn": _as_true(lambda df, keys, order, chunk, features, target: window_knn_regress(df, keys, features, target, seq=order)),
    "ridge": _as_true(lambda df, keys, order, chunk, features, target: regress.chunked_ridge(df, keys, chunk, features, target)),
    "tree": _as_true(lambda df, keys, order, chunk, features, target: trees.tree_regressor(df, keys, chunk, features, target)),
    "bagged_tree": _as_true(lambda df, keys, order, chunk, features, target: trees.tree_regressor(df, keys, chunk, features, target, members=10, ident=order)),
    "bagged_ridge": _as_true(lambda df, keys, order, chunk, features, target: regress.bagged_ridge(df, keys, chunk, order, features, target)),
}

DETECTORS = detect.DETECTORS


def names_of(text: str | list[str], known: dict) -> list[str]:
    """A comma list (or list) of registered names; an unknown one is an error."""
    names = [n.strip() for n in text.split(",")] if isinstance(text, str) else list(text)
    unknown = [n for n in names if n not in known]
    if unknown or not names:
        raise ValueError(f"unknown names {unknown}; choose from {sorted(known)}")
    return names


def prequential(
    df: DataFrame, learners: str | list[str], *, order: str, features: list[str], label: str, n_classes: int, chunk_size: int = 100, keys: list[str] | None = None
) -> DataFrame:
    """Test-then-train predictions of several learners: (method, keys, order, y_true, y_pred).

    ``order`` is a dense 1-based position; without ``keys`` the table is one stream and learners that are
    sequential machines are refused.
    """
    keys = keys or []
    out = None
    chunked = df.withColumn("__chunk_id", F.expr(f"(cast(`{order}` as bigint) - 1) div {int(chunk_size)}"))
    for name in names_of(learners, CLASSIFIERS):
        if name in NEED_KEYS and not keys:
            raise ValueError(f"{name} is a per-key learner: name the key columns of the stream")
        if name in BINARY and n_classes != 2:
            raise ValueError(f"{name} handles two classes only")
        scored = CLASSIFIERS[name](chunked, keys, order, "__chunk_id", features, label, n_classes)
        kept = [k for k in keys if k in scored.columns]
        part = scored.select(F.lit(name).alias("method"), *kept, F.col(order), F.col(label).alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def prequential_regression(
    df: DataFrame, regressors: str | list[str], *, order: str, features: list[str], target: str, chunk_size: int = 100, keys: list[str] | None = None
) -> DataFrame:
    """Test-then-train predictions of several regressors: (method, keys, order, y_true, y_pred)."""
    keys = keys or []
    out = None
    chunked = df.withColumn("__chunk_id", F.expr(f"(cast(`{order}` as bigint) - 1) div {int(chunk_size)}"))
    for name in names_of(regressors, REGRESSORS):
        if name.startswith("sgd") and not keys:
            raise ValueError(f"{name} is a per-key learner: name the key columns, or use 'ridge' for one stream")
        scored = REGRESSORS[name](chunked, keys, order, "__chunk_id", features, target)
        part = scored.select(F.lit(name).alias("method"), *keys, order, F.col("y_true").cast("double").alias("y_true"), F.col("y_pred").cast("double").alias("y_pred"))
        out = part if out is None else out.unionByName(part)
    return out
