"""Queries over prediction tables and prequential runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_uniform
from tidemark.operators import metrics as M
from tidemark.operators import naive_bayes as NB
from tidemark.queries import query
from tidemark.queries.base import DOC, EV, LI, PRED, documents, events, lines, predictions, uniform_sql, with_

CLS = [0, 1, 2, 3, 4]


def nb_stats_sql(features: list[str], classes: list[int], label: str, over: str, weight: str = "1.0") -> str:
    """Running class statistics as SQL window sums."""
    parts = []
    for c in classes:
        parts.append(f"coalesce(sum(CASE WHEN {label} = {c} THEN {weight} ELSE 0 END) OVER {over}, 0) AS n{c}")
        for j, f in enumerate(features):
            parts.append(f"coalesce(sum(CASE WHEN {label} = {c} THEN {weight} * CAST({f} AS DOUBLE) ELSE 0 END) OVER {over}, 0) AS s{c}_{j}")
            parts.append(f"coalesce(sum(CASE WHEN {label} = {c} THEN {weight} * CAST({f} AS DOUBLE) * {f} ELSE 0 END) OVER {over}, 0) AS q{c}_{j}")
    return ", ".join(parts)


def nb_score_sql(source: str, features: list[str], classes: list[int], pred: str = "y_pred", proba: bool = False) -> str:
    """Predictions from statistics columns of ``source`` as SQL."""
    total = " + ".join(f"n{c}" for c in classes)
    spread = [
        "(({q}) / nall - (({s}) / nall) * (({s}) / nall))".format(
            q=" + ".join(f"q{c}_{j}" for c in classes), s=" + ".join(f"s{c}_{j}" for c in classes))
        for j in range(len(features))
    ]
    widest = f"greatest({', '.join(spread)})" if len(spread) > 1 else spread[0]
    lls = []
    for c in classes:
        terms = []
        for j, f in enumerate(features):
            var = f"(greatest(q{c}_{j} / n{c} - (s{c}_{j} / n{c}) * (s{c}_{j} / n{c}), 0.0) + eps)"
            terms.append(f"0.5 * (ln(2 * pi() * {var}) + (CAST({f} AS DOUBLE) - s{c}_{j} / n{c}) * (CAST({f} AS DOUBLE) - s{c}_{j} / n{c}) / {var})")
        lls.append(f"CASE WHEN n{c} > 0 THEN ln(n{c} / nall) - " + " - ".join(terms) + f" ELSE CAST('-inf' AS DOUBLE) END AS ll{c}")
    best = f"greatest({', '.join(f'll{c}' for c in classes)})"
    choice = " ".join(f"WHEN ll{c} = best THEN {c}" for c in classes)
    out = f"CAST(CASE {choice} ELSE {classes[0]} END AS INT) AS {pred}"
    if proba:
        e = {c: f"(CASE WHEN best = CAST('-inf' AS DOUBLE) THEN 1.0 ELSE exp(ll{c} - best) END)" for c in classes}
        z = "(" + " + ".join(e.values()) + ")"
        out += ", " + ", ".join(f"{x} / {z} AS p{c}" for c, x in e.items())
    return (
        f"SELECT *, {out} FROM (SELECT *, {best} AS best FROM (SELECT *, {', '.join(lls)} FROM ("
        f"SELECT *, CASE WHEN nall > 0 THEN greatest(({widest}) * 1e-9, 1e-9) ELSE 1e-9 END AS eps FROM ("
        f"SELECT *, CAST({total} AS DOUBLE) AS nall FROM {source}) a0) a1) a2) a3"
    )


EVF = ["cents", "hr", "k"]
BEFORE = "(PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RUN_NB = ", ".join([
    EV, f"st AS (SELECT user_id, seq, y_sudden, cents, hr, k, {nb_stats_sql(EVF, [0, 1], 'y_sudden', BEFORE)} FROM ev)",
    f"nb AS ({nb_score_sql('st', EVF, [0, 1], proba=True)})",
])


def nb_run(spark, sf):
    e = events(spark, sf)
    return NB.prequential_nb(e, ["user_id"], "seq", EVF, "y_sudden", [0, 1], proba="proba")


@query("prequential_nb", "W10", "L1", sql=f"WITH {RUN_NB} SELECT user_id, seq, y_sudden AS y_true, y_pred FROM nb")
def _(spark, sf):
    return nb_run(spark, sf).select("user_id", "seq", F.col("y_sudden").alias("y_true"), "y_pred")


@query("prequential_nb_accuracy", "W10", "G1", "R1",
       sql=f"WITH {RUN_NB} SELECT user_id, avg(CAST(y_sudden = y_pred AS INT)) AS accuracy FROM nb GROUP BY user_id")
def _(spark, sf):
    return M.accuracy(nb_run(spark, sf).withColumn("y_true", F.col("y_sudden")), ["user_id"])


@query("accuracy_by_round", "G1", sql=with_(PRED) + "SELECT method, round, avg(CAST(y_true = y_pred AS INT)) AS accuracy FROM pred GROUP BY ALL")
def _(spark, sf):
    return M.accuracy(predictions(spark, sf), ["method", "round"])


def f1_sql(cls, source, by):
    counts = ", ".join(
        f"sum(CAST(y_true = {c} AND y_pred = {c} AS INT)) AS tp{c}, sum(CAST(y_true = {c} AS INT)) AS t{c}, sum(CAST(y_pred = {c} AS INT)) AS p{c}" for c in cls)
    f1 = " + ".join(f"(CASE WHEN t{c} + p{c} = 0 THEN 0.0 ELSE 2.0 * tp{c} / (t{c} + p{c}) END)" for c in cls)
    return f"SELECT {by}, ({f1}) / {len(cls)}.0 AS macro_f1 FROM (SELECT {by}, {counts} FROM {source} GROUP BY {by}) z"


@query("macro_f1_by_round", "G2", sql=with_(PRED) + f1_sql([*CLS, 5], "pred", "method, round"))
def _(spark, sf):
    return M.macro_f1(predictions(spark, sf), ["method", "round"], [*CLS, 5])


@query("round_summary", "G3", sql=with_(PRED) + """SELECT method, avg(a) AS accuracy_mean, stddev_pop(a) AS accuracy_std FROM
  (SELECT method, round, avg(CAST(y_true = y_pred AS INT)) AS a FROM pred GROUP BY ALL) GROUP BY method""")
def _(spark, sf):
    return M.round_summary(M.accuracy(predictions(spark, sf), ["method", "round"]), ["method"], ["accuracy"])


@query("score_rollup", "G1", "G3", sql=with_(PRED) + "SELECT method, round, avg(CAST(y_true = y_pred AS INT)) AS accuracy, count(*) AS n FROM pred GROUP BY ROLLUP (method, round)")
def _(spark, sf):
    return M.score_rollup(predictions(spark, sf), ["method", "round"])


@query("confusion_matrix", "G4", sql=with_(PRED) + """SELECT method, CAST(t AS INT) AS y_true, CAST(p AS INT) AS y_pred,
  (SELECT CAST(round_even(count(*) / 3.0, 0) AS BIGINT) FROM pred WHERE pred.method = g.method AND y_true = t AND y_pred = p) AS n
  FROM (SELECT DISTINCT method FROM pred) g, range(0, 5) a(t), range(0, 5) b(p)""")
def _(spark, sf):
    return M.confusion_matrix(predictions(spark, sf), ["method"], CLS, n_rounds=3)


@query("regression_detail", "S7", sql=with_(LI) + """SELECT rid, target AS y_true, 3 * qty AS y_pred, abs(target - 3 * qty) AS absolute_error,
  (target - 3 * qty) * (target - 3 * qty) AS squared_error, round(abs(target - 3 * qty) / (target + 1e-10) * 100, 4) AS percentage_error FROM li""")
def _(spark, sf):
    p = lines(spark, sf).select("rid", F.col("target").alias("y_true"), (3 * F.col("qty")).alias("y_pred"))
    return M.regression_detail(p).withColumn("percentage_error", F.round("percentage_error", 4))


@query("regression_summary", "G5", "S8", "P13", sql=with_(LI) + """SELECT regressor, round, round(avg(e * e), 6) AS MSE, round(avg(abs(e)), 6) AS MAE, round(1 - avg(e * e) / var_pop(target), 6) AS R2, round(sqrt(avg(e * e)), 6) AS RMSE
  FROM (SELECT 'slope' || CAST(m AS VARCHAR) AS regressor, CAST(disc % 3 AS INT) AS round, target, CASE WHEN tax = 0 THEN NULL ELSE target - m * qty END AS e FROM li, (VALUES (2), (3)) v(m)) WHERE e IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    li = lines(spark, sf).withColumn("m", F.explode(F.array(F.lit(2), F.lit(3))))
    p = li.select(F.concat(F.lit("slope"), F.col("m")).alias("regressor"), (F.col("disc") % 3).cast("int").alias("round"),
                  F.col("target").alias("y_true"), F.when(F.col("tax") != 0, F.col("m") * F.col("qty")).alias("y_pred"))
    g = M.regression_metrics(p, ["regressor", "round"])
    return g.select("regressor", "round", *[F.round(c, 6).alias(c) for c in ("MSE", "MAE", "R2", "RMSE")])


def doc_scores(spark, sf):
    d = documents(spark, sf).filter(F.col("quality").isNotNull())
    s = F.floor(F.least(F.col("n_spaces") / F.lit(200.0), F.lit(0.999)) * 20) / 20
    return d.select("lang", "doc_id", (F.col("doc_id") + 1).alias("seq"), F.col("quality").alias("y_true"),
                    s.alias("score"), (s > 0.3).cast("int").alias("y_pred"))


DOCS = DOC + """, sc AS (SELECT lang, doc_id, doc_id + 1 AS seq, quality AS y_true, floor(least(n_spaces / 200.0, 0.999) * 20) / 20 AS score,
  CAST(floor(least(n_spaces / 200.0, 0.999) * 20) / 20 > 0.3 AS INT) AS y_pred FROM doc WHERE quality IS NOT NULL)"""


def imbalance_sql(source, by):
    return f"""SELECT {by}, sqrt((CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END) * (CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END)) AS gm,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN tp + fn <= tn + fp THEN (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END) ELSE (CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END) END AS minority_recall
  FROM (SELECT {by}, CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS DOUBLE) AS fn FROM {source} GROUP BY {by}) z"""


@query("imbalance_metrics", "G6", sql=with_(DOCS) + imbalance_sql("sc", "lang"))
def _(spark, sf):
    return M.imbalance_metrics(doc_scores(spark, sf), ["lang"])


@query("ranked_auc", "G6", "L21", sql=with_(DOCS) + """SELECT lang, CASE WHEN np = 0 OR nn = 0 THEN 0.0 ELSE round((sum(CASE WHEN y_true = 1 THEN r ELSE 0 END) - np * (np + 1) / 2.0) / np / nn, 6) END AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r,
    sum(y_true) OVER (PARTITION BY lang) AS np, sum(1 - y_true) OVER (PARTITION BY lang) AS nn FROM sc) GROUP BY lang, np, nn""")
def _(spark, sf):
    return M.auc(doc_scores(spark, sf), ["lang"], "score", "y_true").withColumn("auc", F.round("auc", 6))


@query("class_balance", "G10", sql=with_(EV) + """SELECT dow, count(*) AS n_classes, arg_min(k, n * 1000 + k) AS minority_class, min(n) AS minority_n, max(n) / min(n) AS imbalance_ratio
  FROM (SELECT dow, k, count(*) AS n FROM ev GROUP BY ALL) GROUP BY dow""")
def _(spark, sf):
    return M.class_balance(events(spark, sf), ["dow"], "k")


def interval_sql(source, by, cols, interval):
    return f"SELECT {by}, (seq - 1) // {interval} AS interval, max(seq) AS seq, {cols} FROM {source} GROUP BY ALL"


@query("prequential_accuracy", "W1", sql=with_(PRED) + f"""SELECT method, round, interval, seq, sum(h) OVER w / sum(n) OVER w AS accuracy FROM (
  {interval_sql('pred', 'method, round', 'sum(CAST(y_true = y_pred AS INT)) AS h, count(*) AS n', 300)})
  WINDOW w AS (PARTITION BY method, round ORDER BY interval)""")
def _(spark, sf):
    return M.prequential_accuracy(predictions(spark, sf), ["method", "round"], 300)


def running_f1_sql(cls):
    counts = ", ".join(f"sum(CAST(y_true = {c} AND y_pred = {c} AS INT)) AS a{c}, sum(CAST(y_true = {c} AS INT)) AS b{c}, sum(CAST(y_pred = {c} AS INT)) AS d{c}" for c in cls)
    cum = ", ".join(f"sum(a{c}) OVER w AS tp{c}, sum(b{c}) OVER w AS t{c}, sum(d{c}) OVER w AS p{c}" for c in cls)
    f1 = " + ".join(f"(CASE WHEN t{c} + p{c} = 0 THEN 0.0 ELSE 2.0 * tp{c} / (t{c} + p{c}) END)" for c in cls)
    return f"""SELECT method, round, interval, seq, ({f1}) / {len(cls)}.0 AS macro_f1 FROM (SELECT method, round, interval, seq, {cum} FROM (
      {interval_sql('pred', 'method, round', counts, 300)}) WINDOW w AS (PARTITION BY method, round ORDER BY interval))"""


@query("prequential_macro_f1", "W2", sql=with_(PRED) + running_f1_sql(CLS))
def _(spark, sf):
    return M.prequential_macro_f1(predictions(spark, sf), ["method", "round"], 300, CLS)


@query("metric_band", "W3", sql=with_(PRED) + f"""SELECT method, interval, avg(a) AS mean, stddev_pop(a) AS std, avg(a) - stddev_pop(a) AS lower, avg(a) + stddev_pop(a) AS upper FROM (
  SELECT method, round, interval, seq, sum(h) OVER w / sum(n) OVER w AS a FROM (
  {interval_sql('pred', 'method, round', 'sum(CAST(y_true = y_pred AS INT)) AS h, count(*) AS n', 300)})
  WINDOW w AS (PARTITION BY method, round ORDER BY interval)) GROUP BY ALL""")
def _(spark, sf):
    return M.metric_band(M.prequential_accuracy(predictions(spark, sf), ["method", "round"], 300), ["method", "interval"], "accuracy")


BIN = uniform_sql("event_id", "'score'")


def binary_scores(spark, sf):
    e = events(spark, sf)
    s = hash_uniform(F.col("event_id"), "score")
    s = F.when(F.col("y") == 1, F.greatest(s, F.lit(0.3))).otherwise(s)
    return e.select("hr", "seq", F.col("y").alias("y_true"), s.alias("score"), (s >= 0.6).cast("int").alias("y_pred"))


@query("prequential_imbalance", "W4", sql=with_(EV, f"""s0 AS (SELECT hr, seq, y AS y_true, CASE WHEN y = 1 THEN greatest({BIN}, 0.3) ELSE {BIN} END AS score FROM ev),
  s AS (SELECT *, CAST(score >= 0.6 AS INT) AS y_pred, CAST(seq >= 4000 AS INT) + CAST(seq >= 8000 AS INT) AS segment, (seq - 1) // 1000 AS interval FROM s0),
  ends AS (SELECT segment, interval, max(seq) AS seq FROM s GROUP BY ALL),
  pre AS (SELECT ends.segment, ends.interval, ends.seq AS upto, s.score, s.y_true, s.y_pred FROM ends JOIN s ON s.segment = ends.segment AND s.seq <= ends.seq),
  m AS (""" + imbalance_sql("pre", "segment, interval, upto") + """),
  a AS (SELECT segment, interval, CASE WHEN np = 0 OR nn = 0 THEN 0.0 ELSE (sum(CASE WHEN y_true = 1 THEN r ELSE 0 END) - np * (np + 1) / 2.0) / np / nn END AS auc FROM (
   SELECT *, rank() OVER (PARTITION BY segment, interval ORDER BY score) + (count(*) OVER (PARTITION BY segment, interval, score) - 1) / 2.0 AS r,
    sum(y_true) OVER (PARTITION BY segment, interval) AS np, sum(1 - y_true) OVER (PARTITION BY segment, interval) AS nn FROM pre) GROUP BY segment, interval, np, nn)""") +
    "SELECT m.segment, m.interval, m.upto AS seq, gm, f1, minority_recall, auc FROM m JOIN a ON a.segment = m.segment AND a.interval = m.interval")
def _(spark, sf):
    return M.prequential_imbalance(binary_scores(spark, sf), [], 1000, [4000, 8000])


@query("label_budget_estimate", "W8", sql=with_(EV) + """SELECT user_id, seq, v * 199.0 / 200.0 + y AS v_hat, (v * 199.0 / 200.0 + y) / 200.0 AS spend FROM (
  SELECT user_id, seq, y, sum(y) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS v FROM ev)""")
def _(spark, sf):
    from tidemark.operators.select import label_budget_estimate

    return label_budget_estimate(events(spark, sf), ["user_id"], "seq", "y", 200).select("user_id", "seq", "v_hat", "spend")


@query("running_class_counts", "W9", sql=with_(EV) + """SELECT user_id, seq, coalesce(sum(CAST(y_sudden = 0 AND k < 50 AS INT)) OVER w, 0) AS n_0, coalesce(sum(CAST(y_sudden = 1 AND k < 50 AS INT)) OVER w, 0) AS n_1
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    from tidemark.operators.select import running_class_counts

    return running_class_counts(events(spark, sf), ["user_id"], "seq", "y_sudden", F.col("k") < 50, [0, 1]).select("user_id", "seq", "n_0", "n_1")


@query("running_feature_moments", "W7", sql=with_(EV) + """SELECT feature, seq, n, round(mean, 6) AS mean, round(sq / n - mean * mean, 3) AS variance FROM (
  SELECT feature, seq, count(*) OVER w AS n, sum(x) OVER w / count(*) OVER w AS mean, sum(x * x) OVER w AS sq FROM (
    SELECT 0 AS feature, seq, CAST(cents AS DOUBLE) AS x FROM ev WHERE cents <> 0 UNION ALL SELECT 1, seq, hr FROM ev WHERE hr <> 0 UNION ALL SELECT 2, seq, k FROM ev WHERE k <> 0)
  WINDOW w AS (PARTITION BY feature ORDER BY seq))""")
def _(spark, sf):
    from tidemark.functions.maps import to_sparse_map
    from tidemark.operators.features import running_feature_moments

    e = events(spark, sf).select("seq", to_sparse_map(F.array(*[F.col(c).cast("double") for c in EVF]), drop_zeros=True).alias("x"))
    return running_feature_moments(e, "seq", "x").select(
        "feature", "seq", "n", F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"))
