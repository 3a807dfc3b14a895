"""Chunk-wise learners: naive Bayes, random-feature ridge and semi-supervised variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_uniform
from tidemark.operators import broad as B
from tidemark.operators import metrics as M
from tidemark.operators import naive_bayes as NB
from tidemark.plans import chunks as CH
from tidemark.queries import query
from tidemark.queries.base import EV, LI, VEC, events, lines, recursive, uniform_sql, vectors, with_
from tidemark.queries.metrics import nb_score_sql, nb_stats_sql

LF = ["qty", "disc", "tax"]
C3 = [0, 1, 2]


def month_nb_sql(weight: str = "1.0") -> str:
    names = NB.stat_names(len(LF), C3)
    per = nb_stats_sql(LF, C3, "label", "()", weight).replace(" OVER ()", "")
    return with_(LI, f"per AS (SELECT month, {per} FROM li GROUP BY month)",
                 "pre AS (SELECT month, " + ", ".join(f"coalesce(sum({n}) OVER w, 0) AS {n}" for n in names) +
                 " FROM per WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
                 f"sc AS ({nb_score_sql('(SELECT li.*, pre.* EXCLUDE (month) FROM li JOIN pre USING (month))', LF, C3)})")


@query("nb_stats", "G11", sql=with_(LI) + f"SELECT month, {nb_stats_sql(LF, C3, 'label', '()').replace(' OVER ()', '')} FROM li GROUP BY month")
def _(spark, sf):
    return NB.nb_stats(lines(spark, sf), ["month"], LF, "label", C3)


@query("nb_stats_weighted", "G11", "M13", sql=with_(LI) + f"SELECT l_returnflag, {nb_stats_sql(LF, C3, 'label', '()', 'tax').replace(' OVER ()', '')} FROM li GROUP BY l_returnflag")
def _(spark, sf):
    return NB.nb_stats(lines(spark, sf), ["l_returnflag"], LF, "label", C3, weight="tax")


@query("chunked_nb", "L1", "J3", "R1", sql=month_nb_sql() + "SELECT rid, label AS y_true, y_pred FROM sc")
def _(spark, sf):
    return NB.chunked_nb(lines(spark, sf), [], "month", LF, "label", C3).select("rid", F.col("label").alias("y_true"), "y_pred")


@query("chunked_nb_accuracy", "R1", sql=month_nb_sql() + "SELECT month, count(*) AS n, avg(CAST(label = y_pred AS INT)) AS accuracy FROM sc GROUP BY month")
def _(spark, sf):
    scored = NB.chunked_nb(lines(spark, sf), [], "month", LF, "label", C3)
    return scored.groupBy("month").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("y_pred")).cast("int")).alias("accuracy"))


@query("asof_lagged_model", "J3", sql=with_(EV, "m AS (SELECT user_id, seq, k AS w, hr AS v FROM ev WHERE event_type = 'signup')") +
       """SELECT e.user_id, e.seq, m.w, m.v FROM ev e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.seq > m.seq""")
def _(spark, sf):
    e = events(spark, sf)
    models = e.filter(F.col("event_type") == "signup").select("user_id", "seq", F.col("k").alias("w"), F.col("hr").alias("v"))
    return CH.latest_before(e.select("user_id", "seq"), models, ["user_id"], "seq", ["w", "v"])


@query("experiment_grid", "R4", sql=with_(EV, f"""c AS (SELECT ev.*, s.strategy, r.round, (strategy = 'all' OR {uniform_sql('event_id', "'grid:' || CAST(r.round AS VARCHAR)")} < 0.3) AS used FROM ev, (VALUES ('all'), ('random')) s(strategy), (VALUES (0), (1)) r(round))""",
  "st AS (SELECT strategy, round, seq, cents, k, y_sudden, " + nb_stats_sql(["cents", "k"], [0, 1], "CASE WHEN used THEN y_sudden END",
  "(PARTITION BY strategy, round ORDER BY (seq - 1) // 500 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") + " FROM c)",
  f"sc AS ({nb_score_sql('st', ['cents', 'k'], [0, 1])})") + "SELECT strategy, round, avg(CAST(y_sudden = y_pred AS INT)) AS accuracy FROM sc GROUP BY ALL")
def _(spark, sf):
    from tidemark.runner import experiment_grid

    cells = [{"strategy": s, "round": r} for s in ("all", "random") for r in (0, 1)]
    grid = experiment_grid(events(spark, sf), cells).withColumn("chunk_id", F.expr("(seq - 1) div 500"))
    used = (F.col("strategy") == "all") | (hash_uniform(F.col("event_id"), F.concat(F.lit("grid:"), F.col("round").cast("string"))) < 0.3)
    grid = grid.withColumn("train", F.when(used, F.col("y_sudden")))
    scored = NB.chunked_nb(grid, ["strategy", "round"], "chunk_id", ["cents", "k"], "train", [0, 1])
    return M.accuracy(scored.withColumn("y_true", F.col("y_sudden")), ["strategy", "round"])


@query("gram_stats", "G12", sql=with_(LI) + """SELECT month, count(*) AS n, sum(qty * qty) AS g0_0, sum(qty * disc) AS g0_1, sum(qty * target) AS t0_0, sum(disc * disc) AS g1_1, sum(disc * target) AS t1_0 FROM li GROUP BY month""")
def _(spark, sf):
    return B.gram_columns(lines(spark, sf), ["month"], ["qty", "disc"], ["target"])


@query("gram_blocks", "G12", sql=with_(LI) + """SELECT month, count(*) AS n, CAST(sum(qty * qty) AS DOUBLE) AS g00, CAST(sum(qty * disc) AS DOUBLE) AS g01, CAST(sum(tax * tax) AS DOUBLE) AS g22,
  CAST(coalesce(sum(qty) FILTER (label = 0), 0) AS DOUBLE) AS t00, CAST(coalesce(sum(tax) FILTER (label = 2), 0) AS DOUBLE) AS t22 FROM li GROUP BY month""")
def _(spark, sf):
    li = lines(spark, sf).select("month", F.array(*LF).alias("features"), "label")
    identity = B.NodeMap(3, mapping=False, ne=1, n2=3, enhance_function="linear", whiten=False)
    identity._enhance = [(np.eye(3), 0.0)]
    s = B.BroadLearner(identity, 3).stats(li, [], "month", "features", "label", salts=4)
    g = lambda c, i: F.get(c, F.lit(i))
    return s.select("month", "n", g("gram", 0).alias("g00"), g("gram", 1).alias("g01"), g("gram", 8).alias("g22"), g("xty", 0).alias("t00"), g("xty", 8).alias("t22"))


NODES = B.NodeMap(3, nf=2, n1=2, ne=1, n2=2, seed=7)


def node_sql() -> str:
    z = []
    for w, b in NODES._map:
        for j in range(w.shape[1]):
            z.append("1 / (1 + exp(-(" + " + ".join(f"CAST({v!r} AS DOUBLE) * {f}" for v, f in zip(w[:, j].tolist(), ("c", "h", "q"))) + f" + CAST({b!r} AS DOUBLE))))")
    names = [f"z{i}" for i in range(len(z))]
    e = []
    for w, b in NODES._enhance:
        for j in range(w.shape[1]):
            e.append("1 / (1 + exp(-(" + " + ".join(f"CAST({v!r} AS DOUBLE) * {n}" for v, n in zip(w[:, j].tolist(), names)) + f" + CAST({b!r} AS DOUBLE))))")
    inner = f"SELECT event_id, {', '.join(f'{x} AS {n}' for x, n in zip(z, names))} FROM (SELECT event_id, cents / 10000.0 AS c, hr / 24.0 AS h, k / 100.0 AS q FROM ev)"
    return f"SELECT event_id, [{', '.join([f'round({n}, 6)' for n in names] + [f'round({x}, 6)' for x in e])}] AS nodes FROM ({inner})"


@query("random_nodes", "P4", sql=with_(EV) + node_sql())
def _(spark, sf):
    e = events(spark, sf).select("event_id", F.array(*[(F.col(c) / w).cast("double") for c, w in (("cents", 10000.0), ("hr", 24.0), ("k", 100.0))]).alias("x"))
    out = B.random_nodes(e, "x", NODES)
    return out.select("event_id", F.transform("nodes", lambda v: F.round(v, 6)).alias("nodes"))


@query("mvn_oas_fit", "G13", sql=with_(LI, """c AS (SELECT month, count(*) AS n, avg(qty) AS m0, avg(disc) AS m1, var_pop(qty) AS a, covar_pop(qty, disc) AS b, var_pop(disc) AS d FROM li GROUP BY month)""",
  "s AS (SELECT *, least(1.0, ((1 - 2 / 2.0) * (a * a + 2 * b * b + d * d) + (a + d) * (a + d)) / ((n + 1 - 2 / 2.0) * ((a * a + 2 * b * b + d * d) - (a + d) * (a + d) / 2))) AS r FROM c)") +
  "SELECT month, n, round(m0, 6) AS m0, round(m1, 6) AS m1, round((1 - r) * a + r * (a + d) / 2, 4) AS c00, round((1 - r) * b, 4) AS c01, round((1 - r) * d + r * (a + d) / 2, 4) AS c11, round(r, 6) AS shrinkage FROM s")
def _(spark, sf):
    g = B.mvn_oas(lines(spark, sf), ["month"], ["qty", "disc"])
    at = lambda c, i: F.get(c, F.lit(i))
    return g.select("month", "n", F.round(at("mean", 0), 6).alias("m0"), F.round(at("mean", 1), 6).alias("m1"), F.round(at("cov", 0), 4).alias("c00"),
                    F.round(at("cov", 1), 4).alias("c01"), F.round(at("cov", 3), 4).alias("c11"), F.round("shrinkage", 6).alias("shrinkage"))


def _broad(spark, sf, size=50, **options):
    v = vectors(spark, sf).withColumn("chunk_id", F.expr(f"(seq - 1) div {size}"))
    extra = options.pop("extra", ())
    mapping = options.pop("mapping", True)
    nodes = B.NodeMap.fitted(v.filter(F.col("seq") <= 100), "features", 64, extra=extra, mapping=mapping, whiten=options.get("mode") != "graph")
    if options.get("mode") == "anchor":
        rows = v.filter(F.col("seq") <= 20).orderBy("seq").select("features").collect()
        options["anchors"] = np.array([r["features"] for r in rows])
    return v, B.BroadLearner(nodes, 3, **options)


def _hidden():
    return F.when((F.col("seq") <= 100) | (hash_uniform(F.col("vec_id"), "labelled") < 0.5), F.col("label"))


def _summary(scored):
    return scored.select("vec_id", "chunk_id", F.col("label").alias("y_true"), "y_pred")


@query("broad_learner", "L2", "R1")
def _(spark, sf):
    v, learner = _broad(spark, sf)
    return _summary(learner.prequential(v, [], "chunk_id", "features", "label"))


@query("broad_learner_volume", "L2")
def _(spark, sf):
    li = lines(spark, sf).select("month", F.array(*LF).alias("features"), "label")
    nodes = B.NodeMap.fitted(li.filter(F.col("month") == 0), "features", 3)
    scored = B.BroadLearner(nodes, 3).prequential(li, [], "month", "features", "label", salts=8)
    return scored.groupBy("month").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("y_pred")).cast("int")), 3).alias("accuracy"))


@query("broad_learner_growth", "L3")
def _(spark, sf):
    v, learner = _broad(spark, sf, extra=((4, 1, 1), (7, 0, 1)))
    return _summary(learner.prequential(v, [], "chunk_id", "features", "label"))


@query("semi_broad_anchor", "L4")
def _(spark, sf):
    v, learner = _broad(spark, sf, mode="anchor")
    return _summary(learner.prequential(v, [], "chunk_id", "features", "label", train_label=_hidden()))


@query("semi_broad_graph", "L5")
def _(spark, sf):
    v, learner = _broad(spark, sf, mode="graph")
    return _summary(learner.prequential(v, [], "chunk_id", "features", "label", train_label=_hidden()))


@query("semi_enhance_graph", "L6")
def _(spark, sf):
    v, learner = _broad(spark, sf, mode="graph", mapping=False)
    return _summary(learner.prequential(v, [], "chunk_id", "features", "label", train_label=_hidden()))


POWERS = 24


def power_sql(name: str, source: str) -> str:
    """The matrix of ``source`` (m, symmetric) squared ``POWERS`` times, with trace 1."""
    return f"""{name} AS (SELECT 0 AS k, m FROM {source}
  UNION ALL SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / t)) FROM (
    SELECT k, q, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i][i])) AS t FROM (
      SELECT k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS q FROM {name} WHERE k < {POWERS}) z0) z1)"""


def leading_sql(name: str, power: str) -> str:
    """The unit vector of a matrix of rank one, its entry of largest magnitude positive."""
    return f"""{name} AS (SELECT list_transform(r, lambda x: x / s * sg) AS v FROM (
  SELECT r, sqrt(list_dot_product(r, r)) AS s, sign(r[list_position(list_transform(r, lambda x: abs(x)), list_max(list_transform(r, lambda x: abs(x))))]) AS sg FROM (
    SELECT m[list_position(d, list_max(d))] AS r FROM (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {power} WHERE k = {POWERS}) z0) z1) z2)"""


PCA = [
    VEC, "cv AS (SELECT i, j, covar_samp(features[i], features[j]) AS c FROM vec, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j)",
    "cm AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i) z)", power_sql("pw", "cm"), leading_sql("v1", "pw"),
    """df AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM (
  SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM cm, v1) z)""", power_sql("pu", "df"), leading_sql("v2", "pu")]


@query("pca_2d", "V2", sql=recursive(*PCA) + "SELECT seq, round(list_dot_product(features, v1.v), 5) AS pc1, round(list_dot_product(features, v2.v), 5) AS pc2, seq < 251 AS before FROM vec, v1, v2")
def _(spark, sf):
    from tidemark.operators.validate import pca_2d

    out, _ = pca_2d(vectors(spark, sf), "features", 251)
    return out.withColumn("pc1", F.round("pc1", 5)).withColumn("pc2", F.round("pc2", 5))
