"""Learners that watch their own densities or errors and re-weight history when those drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import detect as dt
from tidemark.operators import naive_bayes as nb
from tidemark.operators.broad import mvn_oas
from tidemark.operators.density import BatchDensities, mvn_logpdf
from tidemark.plans.blocks import stream_past
from tidemark.plans.chunks import score_join
from tidemark.plans.keyed import Machine
from tidemark.plans.scan import with_seq


def density_drift(df: DataFrame, keys: list[str], order: str, features: list[str], *, chunk: int, machine: Machine | None = None, **scan) -> DataFrame:
    """Alarms on the standardised log density of each row under its key's previous chunk.

    A chunk's model is its mean and OAS covariance; scores are standardised by the mean and deviation
    of the model's own chunk.  Models stream past the rows of the next chunk, then the detector runs.
    """
    p = len(features)
    rows = with_seq(df.select(*keys, order, *features), keys, order, name="__rn").withColumn("__chunk", F.expr(f"(__rn - 1) div {int(chunk)}"))
    models = mvn_oas(rows, [*keys, "__chunk"], features)
    base = T.StructType([rows.schema[c] for c in [*keys, order, "__chunk"]] + [T.StructField("__lp", T.DoubleType())])

    def logpdf(part: pd.DataFrame, side: dict | None) -> pd.DataFrame:
        if side is None:
            lp = np.full(len(part), np.nan)
        else:
            cov = np.asarray(side["cov"]).reshape(p, p) + 1e-9 * np.eye(p)
            gap = part[features].to_numpy(dtype=float) - np.asarray(side["mean"])
            lp = -0.5 * (p * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap))
        return part[[*keys, order, "__chunk"]].assign(__lp=lp)

    on = [*keys, "__chunk"]
    own = stream_past(rows, models, on, ["mean", "cov"], logpdf, base)
    scale = own.groupBy(*on).agg(F.avg("__lp").alias("__mu"), F.stddev_pop("__lp").alias("__sd"))
    after = models.join(scale, on).withColumn("__chunk", F.col("__chunk") + 1)
    scored = stream_past(rows, after, on, ["mean", "cov"], logpdf, base)
    lagged = scored.join(scale.withColumn("__chunk", F.col("__chunk") + 1), on)
    standard = (F.col("__mu") - F.col("__lp")) / F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(F.lit(1.0))
    return dt.detect(lagged, keys, order, standard, machine or dt.PageHinkley(), **scan)


def reweighted_stream(
    df: DataFrame, batch: str, features: list[str], label: str, classes: list[int], *, density: list[str] | None = None, machine: Machine | None = None, clip: float = 100.0,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, versions): naive Bayes that is refitted on re-weighted history when its error drifts.

    The first model is fitted on the first batch.  A version scores every later batch in one pass, which gives one
    error rate per batch; these go through the detector in order up to the first alarm.  There the next version
    is fitted: all rows up to that batch, weighted by the density of its model over that of their own batch
    (over ``density``: the features and the label by default), at most ``clip``.  Two passes per version, none per
    batch; the versions' validity intervals then meet the rows, each of which has one prediction (none in the
    first batch, nor with a missing feature).  ``versions`` has a row per batch: the version's batch, accuracy, and
    whether the batch raised an alarm.
    """
    density = density or [*features, label]
    detector = machine or dt.PageHinkley(min_n=2, delta=0.005, threshold=0.02)
    spark = df.sparkSession
    complete = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in dict.fromkeys([*density, *features, label])))
    models = BatchDensities.fit(complete, batch, density)
    names = [int(b) for b in models.batches]
    kind = ", ".join(["version bigint", *[f"`{n}` double" for n in nb.parameter_names(len(features), classes)]])

    def fitted(b: int) -> dict[str, float]:
        past = mvn_ratio(complete.filter(F.col(batch) <= F.lit(b)), models, batch, b, clip)
        return nb.fit_nb(past, features, label, classes, "__weight")

    versions, valid, told, state = {}, {}, {}, detector.start()
    at = 0
    while at < len(names):
        b = names[at]
        versions[b] = fitted(b)
        scored = nb.predict_nb(complete.filter(F.col(batch) > F.lit(b)), versions[b], features, classes)
        rates = {int(r[batch]): r["e"] for r in scored.groupBy(batch).agg(F.avg((F.col(label) != F.col("y_pred")).cast("double")).alias("e")).collect()}
        for at in range(at + 1, len(names) + 1):
            if at == len(names):
                break
            now = names[at]
            state, alarm = detector.feed(state, {"x": np.array([rates[now]])})
            valid[now], told[now] = b, (1 - rates[now], len(alarm["row"]) > 0)
            if told[now][1]:
                break
    table = spark.createDataFrame([[b, *[float(m[n]) for n in nb.parameter_names(len(features), classes)]] for b, m in versions.items()], kind)
    spans = spark.createDataFrame([(t, b) for t, b in valid.items()], f"`{batch}` bigint, version bigint")  # one row per batch
    joined = score_join(df, spans.join(table, "version"), [batch])
    rows = nb.apply(joined, features, classes).withColumn("y_pred", F.when(F.col("version").isNotNull(), F.col("y_pred")))
    first = [(names[0], None, None, False)] if names else []
    summary = spark.createDataFrame([*first, *[(t, valid[t], told[t][0], told[t][1]) for t in sorted(told)]], f"`{batch}` bigint, version bigint, accuracy double, drifted boolean")
    return rows.select(*df.columns, "y_pred", "version"), summary


def mvn_ratio(df: DataFrame, models: BatchDensities, batch: str, newest: int, clip: float) -> DataFrame:
    """Add ``__weight``: density under the model of batch ``newest`` over that of the row's own, at most ``clip``."""
    both = mvn_logpdf(mvn_logpdf(df.withColumn("__newest", F.lit(newest)), models, "__newest", "__lp_new"), models, batch, "__lp_own")
    return both.withColumn("__weight", F.least(F.exp("__lp_new") / (F.exp("__lp_own") + F.lit(1e-16)), F.lit(float(clip)))).drop("__newest", "__lp_new", "__lp_own")
