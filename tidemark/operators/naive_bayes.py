"""Gaussian naive Bayes as sums: per-row prequential, per-chunk, weighted, or fitted once.

Statistics are one wide row per (key, chunk): n, sum and sum of squares of each feature in each
class.  Scoring reads them as columns, so it stays inside generated code and never multiplies rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.chunks import lagged_prefix, score_join
from tidemark.plans.scan import running


def stat_columns(features: list[str], label: str, classes: list[int], weight: str = "1.0D") -> dict[str, str]:
    """Additive terms per row as SQL text, zero for other classes, unlabelled rows and rows with gaps."""
    usable = " AND ".join(f"`{f}` IS NOT NULL" for f in features)
    cols = {}
    for c in classes:
        own = f"`{label}` = {c} AND {usable}"
        cols[f"n{c}"] = f"CASE WHEN {own} THEN {weight} ELSE 0.0D END"
        for j, f in enumerate(features):
            x = f"cast(`{f}` as double)"
            cols[f"s{c}_{j}"] = f"CASE WHEN {own} THEN {weight} * {x} ELSE 0.0D END"
            cols[f"q{c}_{j}"] = f"CASE WHEN {own} THEN {weight} * {x} * {x} ELSE 0.0D END"
    return cols


def stat_names(n_features: int, classes: list[int]) -> list[str]:
    return [n for c in classes for n in [f"n{c}", *[f"{k}{c}_{j}" for j in range(n_features) for k in "sq"]]]


def nb_stats(df: DataFrame, by: list[str], features: list[str], label: str, classes: list[int], weight: str | None = None) -> DataFrame:
    """Sufficient statistics per group; partial sums are combined before the shuffle.

    ``weight`` is the name of a weight column.
    """
    cols = stat_columns(features, label, classes, f"cast(`{weight}` as double)" if weight else "1.0D")
    return df.groupBy(*by).agg(*[F.expr(f"sum({c}) AS {n}") for n, c in cols.items()])


def parameters(df: DataFrame, n_features: int, classes: list[int], *, smoothing: float = 1e-9) -> DataFrame:
    """Replace statistics columns by the model they imply: per class a constant ``a``, means ``m``
    and variances ``v``.

    Done on the model side, before models meet rows, so rows only see a short arithmetic expression.
    Variances get ``smoothing`` times the largest overall feature variance, at least 1e-9.  A class
    not seen yet has constant minus infinity.
    """
    plus = lambda terms: "(" + " + ".join(terms) + ")"
    spread = [
        f"({plus(f'q{c}_{j}' for c in classes)} / __all - pow({plus(f's{c}_{j}' for c in classes)} / __all, 2))" for j in range(n_features)]
    widest = f"greatest({', '.join(spread)})" if n_features > 1 else spread[0]
    stats = set(stat_names(n_features, classes))
    kept = [f"`{c}`" for c in df.columns if c not in stats]
    means, finals = [], []
    for c in classes:
        means.append(f"n{c}")
        logs = []
        for j in range(n_features):
            means.append(f"CASE WHEN n{c} > 0 THEN s{c}_{j} / n{c} ELSE 0.0D END AS m{c}_{j}")
            means.append(f"CASE WHEN n{c} > 0 THEN greatest(q{c}_{j} / n{c} - pow(s{c}_{j} / n{c}, 2), 0.0D) + __eps ELSE 1.0D END AS v{c}_{j}")
            logs.append(f"ln({2 * math.pi!r}D * v{c}_{j})")
            finals += [f"m{c}_{j}", f"v{c}_{j}"]
        finals.append(f"CASE WHEN n{c} > 0 THEN ln(n{c} / __all) - 0.5D * {plus(logs)} ELSE double('-infinity') END AS a{c}")
    return (
        df.selectExpr("*", f"{plus(f'n{c}' for c in classes)} AS __all")
        .selectExpr("*", f"CASE WHEN __all > 0 THEN greatest({widest} * {smoothing!r}D, 1e-9D) ELSE 1e-9D END AS __eps")
        .selectExpr(*kept, "__all", *means)
        .selectExpr(*kept, *finals))


def parameter_names(n_features: int, classes: list[int]) -> list[str]:
    return [n for c in classes for n in [f"a{c}", *[f"{k}{c}_{j}" for j in range(n_features) for k in "mv"]]]


def apply(
    df: DataFrame, features: list[str], classes: list[int], *, pred: str = "y_pred", proba: str | None = None, prefix: str = ""
) -> DataFrame:
    """Predict from parameter columns (named with ``prefix``) of the same row, which are dropped.

    Ties and an empty model give the lowest class id; a row with a missing feature stays unscored.
    """
    params = {f"{prefix}{n}" for n in parameter_names(len(features), classes)}
    kept = [f"`{c}`" for c in df.columns if c not in params]
    lls = []
    for c in classes:
        gaps = [f"pow(cast(`{f}` as double) - `{prefix}m{c}_{j}`, 2) / `{prefix}v{c}_{j}`" for j, f in enumerate(features)]
        lls.append(f"coalesce(`{prefix}a{c}`, double('-infinity')) - 0.5D * ({' + '.join(gaps)}) AS __ll{c}")
    names = [f"__ll{c}" for c in classes]
    best = f"greatest({', '.join(names)})" if len(names) > 1 else names[0]
    choice = " ".join(f"WHEN __ll{c} = __best THEN {c}" for c in classes)
    gap = " OR ".join(f"`{f}` IS NULL" for f in features)
    out = [f"cast(CASE WHEN {gap} THEN NULL {choice} ELSE {classes[0]} END as int) AS `{pred}`"]
    if proba:
        shifted = ", ".join(f"CASE WHEN __best = double('-infinity') THEN 1.0D ELSE exp(__ll{c} - __best) END" for c in classes)
        out.append(f"array({shifted}) AS __e")
    done = df.selectExpr(*kept, *lls).selectExpr("*", f"{best} AS __best").selectExpr(*kept, *out)
    if proba:
        total = " + ".join(f"__e[{i}]" for i in range(len(classes)))
        done = done.selectExpr(*kept, f"`{pred}`", f"transform(__e, x -> x / ({total})) AS `{proba}`")
    return done


def prequential_nb(
    df: DataFrame, keys: list[str], order: str, features: list[str], label: str, classes: list[int], *,
    span: int = 1_000_000, proba: str | None = None,
) -> DataFrame:
    """Exact per-row test-then-train: each row is scored by the statistics of strictly earlier rows."""
    cols = stat_columns(features, label, classes)
    run = running(df, keys, order, {n: ("sum", c) for n, c in cols.items()}, exclusive=True, span=span)
    return apply(parameters(run, len(features), classes), features, classes, proba=proba)


def chunked_nb(
    df: DataFrame, keys: list[str], chunk: str, features: list[str], label: str, classes: list[int], *,
    weight: str | None = None, proba: str | None = None,
) -> DataFrame:
    """Chunk t is scored by the model of all chunks before it (lagged model join)."""
    stats = nb_stats(df, [*keys, chunk], features, label, classes, weight)
    sums = lagged_prefix(stats, keys, chunk, stat_names(len(features), classes))
    return apply(score_join(df, parameters(sums, len(features), classes), [*keys, chunk]), features, classes, proba=proba)


def fit_nb(df: DataFrame, features: list[str], label: str, classes: list[int], weight: str | None = None) -> dict[str, float]:
    """One model of the whole table: a few numbers per class and feature, on the driver."""
    return parameters(nb_stats(df, [], features, label, classes, weight), len(features), classes).first().asDict()


def predict_nb(df: DataFrame, model: dict[str, float], features: list[str], classes: list[int], *, pred: str = "y_pred", proba: str | None = None) -> DataFrame:
    fixed = [f"double('{float(v)!r}') AS `{n}`" for n, v in model.items()]
    return apply(df.selectExpr("*", *fixed), features, classes, pred=pred, proba=proba)
