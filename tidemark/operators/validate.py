"""Whole-table drift validation with a classifier fixed on the first windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.operators import naive_bayes as nb


def validate_drift(
    df: DataFrame, features: list[str], label: str, classes: list[int], *, window: int = 100, seq: str = "seq", model: str = "nb"
) -> tuple[DataFrame, DataFrame]:
    """(window profile, verdict): a classifier fitted on the first two windows scores all windows.

    ``model='logistic'`` fits Spark ML logistic regression on standardised features instead of
    naive Bayes.  The verdict is one row: an accuracy fall or a feature-mean jump anywhere.
    """
    warm = df.filter(F.col(seq) <= 2 * window)
    if model == "nb":
        scored = nb.predict_nb(df, nb.fit_nb(warm, features, label, classes), features, classes)
    elif model == "logistic":
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        steps = Pipeline(stages=[
            VectorAssembler(inputCols=features, outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
            LogisticRegression(featuresCol="__x", labelCol=label, predictionCol="y_pred", maxIter=100,
                               rawPredictionCol="__r", probabilityCol="__p"),
        ])
        scored = steps.fit(warm).transform(df).drop("__raw", "__x", "__r", "__p")
    else:
        raise ValueError("model must be 'nb' or 'logistic'")
    profile = audit.window_profile(scored, features, window, seq=seq, hit=F.col(label) == F.col("y_pred"))
    return profile, audit.drift_verdict(audit.window_jumps(profile))


def pca_2d(df: DataFrame, features: str, split: int, *, seq: str = "seq") -> tuple[DataFrame, list[float]]:
    """Two principal components of an array column, tagged before/after, with explained variance.

    A component's entry of largest magnitude is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("__x", array_to_vector(features))
    fitted = PCA(k=2, inputCol="__x", outputCol="__pc").fit(x)
    directions = fitted.pc.toArray()
    signs = np.where(directions[np.abs(directions).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)
    pc = vector_to_array(F.col("__pc"))
    out = fitted.transform(x).select(
        seq, *[(F.get(pc, F.lit(i)) * F.lit(float(signs[i]))).alias(f"pc{i + 1}") for i in (0, 1)], (F.col(seq) < split).alias("before"))
    return out, [float(v) for v in fitted.explainedVariance]
