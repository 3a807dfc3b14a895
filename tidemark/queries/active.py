"""Data-dependent chunks, explanation-driven selection and active-learning runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import broad as B
from tidemark.operators import chunking as CK
from tidemark.operators import explain as EX
from tidemark.operators import select as Q
from tidemark.queries import query
from tidemark.queries.base import EV, SCORED, events, fold_sql, recursive, scored, uniform_sql, vectors, with_
from tidemark.queries.metrics import nb_score_sql, nb_stats_sql
from tidemark.runner import BayesModel, BroadModel, active_by_name, annotation_rate, prequential_active, replay_refit


@query("variance_chunks", "C3", "G16")
def _(spark, sf):
    machine = CK.VarianceChunks(block=15)
    return CK.growing_chunks(events(spark, sf), ["user_id"], "seq", ["cents", "k"], "y_sudden", machine).withColumn("p_value", F.round("p_value", 6))


@query("permutation_chunks", "C4")
def _(spark, sf):
    machine = CK.PermutationChunks(block=15)
    return CK.growing_chunks(events(spark, sf), ["user_id"], "seq", ["cents", "k"], "y_sudden", machine).withColumn("p_value", F.round("p_value", 6))


def _variance_pairs(spark, sf):
    """Value variance of each hour, and of the same hour one block of rows later."""
    e = events(spark, sf).withColumn("block", F.expr("seq div 1000"))
    g = e.groupBy("block", "hr").agg(F.count("*").alias("n"), F.var_samp("cents").alias("v"))
    later = g.select((F.col("block") - 1).alias("block"), "hr", F.col("n").alias("n2"), F.col("v").alias("v2"))
    return g.join(later, ["block", "hr"])


@query("variance_f_ratios", "G16", sql=with_(EV, "g AS (SELECT seq // 1000 AS block, hr, count(*) AS n, var_samp(cents) AS v FROM ev GROUP BY ALL)") +
  """SELECT a.block, a.hr, round(a.v / b.v, 6) AS f, a.n - 1 AS df1, b.n - 1 AS df2 FROM g a JOIN g b ON b.block = a.block + 1 AND b.hr = a.hr WHERE a.n > 1 AND b.n > 1 AND b.v > 0""")
def _(spark, sf):
    return CK.f_ratios(_variance_pairs(spark, sf)).select("block", "hr", F.round("f", 6).alias("f"), "df1", "df2")


@query("variance_f_test", "G16")
def _(spark, sf):
    """The tests of each block combined."""
    out = CK.combine_f_tests(_variance_pairs(spark, sf), ["block"], "hr", max_rows=24)
    return out.withColumn("p_value", F.round("p_value", 6))


W3 = [[0.02, -0.5, 0.3], [-0.01, 0.4, -0.2], [0.005, 0.1, 0.25]]
MEANS = [5000.0, 11.5, 49.5]


def _attr_sql(j, f):
    blend = " + ".join(f"{W3[c][j]} / 3.0" for c in range(3))
    return f"sum(({blend}) * ({f} - {MEANS[j]}))"


@query("attribution_ranking", "T2", sql=with_(EV, "s0 AS (SELECT (seq - 1) // 500 AS chunk_id, [" + ", ".join(
  f"{{'i': {j}, 'v': {_attr_sql(j, f)}}}" for j, f in enumerate(("cents", "hr", "k"))) + "] AS l FROM ev GROUP BY (seq - 1) // 500)", "s AS (SELECT chunk_id, unnest(l) AS a FROM s0)") +
  "SELECT chunk_id, list(CAST(a.i AS DOUBLE) ORDER BY a.v, a.i) AS ranking FROM s GROUP BY chunk_id")
def _(spark, sf):
    e = events(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 500"))
    even = F.array(*[F.lit(1.0 / 3)] * 3)
    return EX.attribution_ranking(EX.attributions(e, ["cents", "hr", "k"], W3, MEANS, even), ["chunk_id"], "attribution", 3)


def _explained(spark, sf):
    s = scored(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 100"))
    return EX.query_explanation_chunk(s, [], "chunk_id", "seq", ["cents", "hr", "k"], W3, MEANS, "proba", query_size=10, gamma=0.3)


def _rank_sql(cols):
    return "list_transform(list_sort([" + ", ".join(f"{{'v': {c}, 'i': {j}}}" for j, c in enumerate(cols)) + "]), lambda e: CAST(e.i AS DOUBLE))"


def _jeffreys_sql(a, b):
    n = lambda x: f"list_transform({x}, lambda r: (r + 1) / 6)"
    return f"list_sum(list_transform(list_zip({n(a)}, {n(b)}), lambda t: t[1] * ln(t[1] / t[2]) + t[2] * ln(t[2] / t[1])))"


FEATS = ("cents", "hr", "k")
EXPL = [
    "ch AS (SELECT *, (seq - 1) // 100 AS chunk_id, list_position(proba, list_max(proba)) - 1 AS pred FROM scored)",
    "sh AS (SELECT chunk_id + 1 AS chunk_id, avg(CAST(pred = 0 AS DOUBLE)) AS s0, avg(CAST(pred = 1 AS DOUBLE)) AS s1, avg(CAST(pred = 2 AS DOUBLE)) AS s2 FROM ch GROUP BY ALL)",
    "cw AS (SELECT ch.*, coalesce(s0, 1.0 / 3) AS c0, coalesce(s1, 1.0 / 3) AS c1, coalesce(s2, 1.0 / 3) AS c2 FROM ch LEFT JOIN sh USING (chunk_id))",
    "at AS (SELECT *, " + ", ".join("(" + " + ".join(f"c{c} * {W3[c][j]}" for c in range(3)) + f") * ({f} - {MEANS[j]}) AS a{j}" for j, f in enumerate(FEATS)) + " FROM cw)",
    f"rk AS (SELECT chunk_id, {_rank_sql(['sum(a0)', 'sum(a1)', 'sum(a2)'])} AS r FROM at GROUP BY chunk_id)",
    f"dv AS (SELECT 0 AS lane, rk.chunk_id, coalesce({_jeffreys_sql('rk.r', 'bf.r')}, 0) AS d, bf.r AS before FROM rk LEFT JOIN rk bf ON rk.chunk_id = bf.chunk_id + 1)",
    fold_sql(source="SELECT lane, chunk_id, d FROM dv", key="lane", order="chunk_id", cols=["d"], state={"quiet": "0", "g": "0.0::DOUBLE", "op": "false"},
             steps=[{"g": "0.3::DOUBLE * exp(-0.1::DOUBLE * quiet)"}, {"op": "d >= g"}, {"quiet": "CASE WHEN op THEN 0 ELSE quiet + 1 END"}]),
]
EXPL = [e.replace("at AS (", "att AS (").replace("FROM at GROUP", "FROM att GROUP") for e in EXPL]


@query("query_explanation_chunk", "Q9", "G15", sql=recursive(EV, SCORED, *EXPL,
       f"so AS (SELECT att.event_id, att.seq, att.chunk_id, {_jeffreys_sql(_rank_sql(['a0', 'a1', 'a2']), 'dv.before')} + CASE pred WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END * sqrt(list_sum(list_transform(proba, lambda p: p * p))) AS score FROM att JOIN dv USING (chunk_id) JOIN f ON f.rn > 0 AND f.chunk_id = att.chunk_id AND f.op WHERE dv.before IS NOT NULL)") +
       "SELECT event_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(score, 9), seq) AS rank FROM so) WHERE rank <= 10")
def _(spark, sf):
    return _explained(spark, sf)[0].select("event_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("explanation_gate", "Q9", sql=recursive(EV, SCORED, *EXPL) + "SELECT chunk_id, round(d, 6) AS divergence, op AS is_open, round(g, 6) AS gamma FROM f WHERE rn > 0")
def _(spark, sf):
    return _explained(spark, sf)[1].withColumn("divergence", F.round("divergence", 6)).withColumn("gamma", F.round("gamma", 6))


AF = ["cents", "k"]


def _in_chunks(e, size):
    return e.withColumn("chunk_id", F.expr(f"(seq - 1) div {size}"))


_SUMS = [n for c in (0, 1) for n in [f"n{c}", *[f"{k}{c}_{j}" for j in range(2) for k in "sq"]]]


def _added(where: str) -> dict[str, str]:
    """SQL sums of the rows that meet ``where``, by statistic."""
    out = {}
    for c in (0, 1):
        own = f"({where}) AND y = {c}"
        out[f"n{c}"] = f"sum(CASE WHEN {own} THEN 1.0::DOUBLE ELSE 0 END)"
        for j, f in enumerate(AF):
            out[f"s{c}_{j}"] = f"sum(CASE WHEN {own} THEN CAST({f} AS DOUBLE) ELSE 0 END)"
            out[f"q{c}_{j}"] = f"sum(CASE WHEN {own} THEN CAST({f} AS DOUBLE) * {f} ELSE 0 END)"
    return out


def active_sql(size: int, ask: str, budget: float | None = None) -> list[str]:
    """A run over two classes as one recursion over chunks: ``aw`` has t, n_rows, asked and right of each chunk.

    ``ask`` decides from p0, p1, seq and u (a draw); a row of rank one is the first in its order.
    """
    learned, first = _added("asked_now"), _added("true")
    scored = nb_score_sql(f"(SELECT aw.t + 1 AS t, {', '.join('aw.' + n for n in _SUMS)}, aw.seen, aw.spent, ch.seq, ch.cents, ch.k, ch.y, ch.u FROM aw JOIN ch ON ch.t = aw.t + 1)", AF, [0, 1], proba=True)
    wanted = f"SELECT *, {ask} AS wanted, count(*) OVER () AS here FROM ({scored}) s0"
    limit = "true" if budget is None else f"sum(CAST(wanted AS INT)) OVER (ORDER BY seq) <= greatest(CAST(floor({budget}::DOUBLE * (seen + here)) AS BIGINT) - spent, 0)"
    cut = f"SELECT *, wanted AND {limit} AS asked_now FROM ({wanted}) s1"
    keep = ", ".join(f"any_value({n}) + {learned[n]} AS {n}" for n in _SUMS)
    return [
        EV, f"ch AS (SELECT (seq - 1) // {size} AS t, seq, cents, k, y_sudden AS y, {uniform_sql('seq', chr(39) + '42:query' + chr(39))} AS u FROM ev)",
        f"aw AS (SELECT 0::BIGINT AS t, {', '.join(f'{x} AS {n}' for n, x in first.items())}, 0::BIGINT AS seen, 0::BIGINT AS spent, 0::BIGINT AS n_rows, 0::BIGINT AS asked, 0::DOUBLE AS accuracy FROM ch WHERE t = 0\n"
        f"UNION ALL SELECT t, {keep}, any_value(seen) + count(*), any_value(spent) + sum(CAST(asked_now AS INT)), count(*), sum(CAST(asked_now AS INT)), avg(CAST(y = y_pred AS INT)) FROM ({cut}) s2 GROUP BY t)"]


def _per_chunk(run):
    return run.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if("is_queried").alias("asked"),
                                       F.round(F.avg((F.col("y_sudden") == F.col("y_pred")).cast("int")), 6).alias("accuracy"))


CHUNK_OUT = "SELECT t AS chunk_id, n_rows AS n, CAST(asked AS BIGINT) AS asked, round(accuracy, 6) AS accuracy FROM aw WHERE t > 0"
MARGIN = "abs(p1 - p0) < 0.5"


@query("prequential_active", "R2", "Q2", sql=recursive(*active_sql(500, MARGIN)) + CHUNK_OUT)
def _(spark, sf):
    e = _in_chunks(events(spark, sf), 500)
    model = BayesModel(AF, "y_sudden", [0, 1])
    ask = lambda d, memory=None: Q.query_margin_fixed(d, "proba", 0.5)
    return _per_chunk(prequential_active(e, model, "chunk_id", "y_sudden", ask, held=ask))


def by_name(spark, sf, selectors, size, budget=None):
    e, out = _in_chunks(events(spark, sf), size), None
    for name in selectors:
        run = active_by_name(e, "naive_bayes", name, chunk="chunk_id", order="seq", features=AF, label="y_sudden", n_classes=2, keys=["user_id"], budget=budget)
        part = _per_chunk(run).withColumn("selector", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("active_by_name", "R2", "Q1", "Q2", sql="SELECT 'random' AS selector, * FROM (" + recursive(*active_sql(2500, "u < 0.2")) + CHUNK_OUT + ") x UNION ALL SELECT 'margin_fixed', * FROM ("
       + recursive(*active_sql(2500, MARGIN)) + CHUNK_OUT + ") y")
def _(spark, sf):
    """Two selectors over naive Bayes, by their names: rows, questions and accuracy."""
    return by_name(spark, sf, ("random", "margin_fixed"), 2500)


@query("active_remembering", "R2", "Q3", "Q7")
def _(spark, sf):
    """Rules that remember earlier answers, one stream per user across all chunks."""
    return by_name(spark, sf, ("margin_variable", "submodular"), 2500)


@query("prequential_active_budget", "R2", "Q10", sql=recursive(*active_sql(1000, MARGIN, 0.1)) + CHUNK_OUT)
def _(spark, sf):
    return by_name(spark, sf, ("margin_fixed",), 1000, 0.1).drop("selector")


LEAST = "row_number() OVER (ORDER BY round(abs(p1 - p0), 12), seq) <= 200"


@query("prequential_active_topk", "R2", "T1", "Q10", sql=recursive(*active_sql(2500, LEAST, 0.05)) + "SELECT t AS chunk_id, round(asked / n_rows, 6) AS annotation_rate FROM aw WHERE t > 0")
def _(spark, sf):
    e = _in_chunks(events(spark, sf), 2500)

    least_sure = lambda d, memory=None: Q.query_least_sure(d, ["chunk_id"], "proba", "seq", 200, digits=12)
    run = prequential_active(e, BayesModel(AF, "y_sudden", [0, 1]), "chunk_id", "y_sudden", least_sure, budget=0.05, held=least_sure)
    return annotation_rate(run, ["chunk_id"]).withColumn("annotation_rate", F.round("annotation_rate", 6))


@query("prequential_active_semi", "R2", "L4", "Q1")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 100"))
    warm = v.filter(F.col("seq") <= 100)
    nodes = B.NodeMap.fitted(warm, "features", 64)
    anchors = np.array([r["features"] for r in warm.filter(F.col("seq") <= 20).orderBy("seq").select("features").collect()])
    model = BroadModel(B.BroadLearner(nodes, 3, mode="anchor", anchors=anchors), "features", "label", "chunk_id")
    ask = lambda d, memory=None: Q.query_hashed(d, "vec_id", "ask", 0.4)
    run = prequential_active(v, model, "chunk_id", "label", ask, semi=True, held=ask)
    return run.select("vec_id", "chunk_id", F.col("label").alias("y_true"), "y_pred", "is_queried")


REPLAY = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS age FROM scored WHERE k < 60) WHERE age <= 20)"
MMN = "list_transform(proba, lambda x: (x - list_min(proba)) / (list_max(proba) - list_min(proba) + 1e-10))"


@query("replay_refit", "Q11", "T5", sql=with_(EV, SCORED, REPLAY) + f"SELECT user_id, {nb_stats_sql(['cents', 'hr'], [0, 1, 2], 'label', '()').replace(' OVER ()', '')} FROM r GROUP BY user_id")
def _(spark, sf):
    return replay_refit(scored(spark, sf).filter(F.col("k") < 60), ["user_id"], "seq", ["cents", "hr"], "label", [0, 1, 2], capacity=20)


@query("replay_refit_sure", "Q11", sql=with_(EV, SCORED, REPLAY, f"""g AS (SELECT user_id FROM (SELECT user_id, label, {MMN} AS q FROM r WHERE age = 1)
  WHERE sqrt(list_sum(list_transform(range(1, 4), lambda i: pow(q[i] / list_sum(q) - CAST(label + 1 = i AS INT), 2)))) <= 0.5)""") +
  f"SELECT user_id, {nb_stats_sql(['cents', 'hr'], [0, 1, 2], 'label', '()').replace(' OVER ()', '')} FROM r WHERE user_id IN (SELECT user_id FROM g) GROUP BY user_id")
def _(spark, sf):
    return replay_refit(scored(spark, sf).filter(F.col("k") < 60), ["user_id"], "seq", ["cents", "hr"], "label", [0, 1, 2], capacity=20, proba="proba", residual=0.5)
