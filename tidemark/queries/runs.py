"""Runs of several registered learners over one stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import registry as RG
from tidemark.functions.hashing import poisson_cdf
from tidemark.operators import ensembles as E
from tidemark.operators import metrics as M
from tidemark.queries import query
from tidemark.queries.base import EV, events, lines, uniform_sql, with_
from tidemark.queries.metrics import nb_score_sql, nb_stats_sql

F2 = ["cents", "k"]
TABLE = "[" + ", ".join(repr(p) for p in poisson_cdf(1.0, 1e-10)) + "]"
BEFORE = "(PARTITION BY m ORDER BY c RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("bagged_nb", "L9", "L1", sql=with_(EV, f"""w AS (SELECT ev.*, m, (seq - 1) // 500 AS c, CAST(len(list_filter({TABLE}, lambda p: p <= {uniform_sql('seq', "'42:bag' || CAST(m AS VARCHAR)")})) AS DOUBLE) AS wt FROM ev, range(0, 10) t(m))""",
  f"st AS (SELECT m, seq, cents, k, y_sudden, {nb_stats_sql(F2, [0, 1], 'y_sudden', BEFORE, 'wt')} FROM w)", f"sc AS ({nb_score_sql('st', F2, [0, 1])})") +
  "SELECT seq, CAST(sum(y_pred) > 5 AS INT) AS y_pred FROM sc GROUP BY seq")
def _(spark, sf):
    e = events(spark, sf).withColumn("c", F.expr("(seq - 1) div 500"))
    return E.bagged_nb(e, [], "c", "seq", F2, "y_sudden", [0, 1], order="seq").select("seq", "y_pred")


@query("compare_learners", "R1", "G1", "L1", "L2", "L9")
def _(spark, sf):
    run = RG.prequential(events(spark, sf), "naive_bayes, broad, bagging, leveraging_bagging", order="seq", features=F2, label="y_sudden", n_classes=2, chunk_size=500)
    return M.round_summary(M.accuracy(run, ["method"]), ["method"], ["accuracy"]).select("method", F.round("accuracy_mean", 4).alias("accuracy"))


@query("compare_keyed_learners", "R1", "L7", "L11", "L16")
def _(spark, sf):
    run = RG.prequential(events(spark, sf), "adaptive_bagging, adwin_bagging, expert_selection, stable_dynamic", order="seq", features=F2, label="y_sudden", n_classes=2, keys=["user_id"])
    return M.accuracy(run, ["method"]).withColumn("accuracy", F.round("accuracy", 4))


@query("compare_regressors", "R3", "L18", "L19")
def _(spark, sf):
    e = events(spark, sf).withColumn("t", 3 * (F.col("k") / 100.0) + F.col("hr") / 24.0)
    run = RG.prequential_regression(e, "knn, ridge", order="seq", features=["k", "hr"], target="t", chunk_size=500)
    return M.regression_metrics(run, ["method"]).select("method", *[F.round(c, 4).alias(c) for c in ("MSE", "MAE", "R2", "RMSE")])
