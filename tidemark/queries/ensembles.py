"""Ensemble and per-key learner queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_uniform
from tidemark.functions.maps import to_sparse_map
from tidemark.operators import ensembles as E
from tidemark.operators import experts as X
from tidemark.operators import features as FT
from tidemark.queries import query
from tidemark.queries.base import EV, LI, PRED, events, fold_sql, lines, predictions, recursive, uniform_sql, with_
from tidemark.queries.metrics import nb_score_sql, nb_stats_sql

EF = ["cents", "hr", "k"]


def _per_key(df, key):
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 6).alias("accuracy"))


@query("bagged_stream", "L7")
def _(spark, sf):
    out = E.bagged_stream(events(spark, sf), ["user_id"], "seq", ["cents", "k"], "y_sudden", 2, chunk=10)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")), 6).alias("accuracy"), F.max("swaps").alias("swaps"))


@query("random_patches", "L8", "P12")
def _(spark, sf):
    spaces = {r["member"]: list(r["features"]) for r in FT.subspaces(spark, 3, 3, "percentage", 60).collect()}
    out = E.bagged_stream(events(spark, sf), ["user_id"], "seq", EF, "y_sudden", 2, members=3, chunk=10, subspaces=spaces)
    return _per_key(out, "user_id")


_BAG = uniform_sql("(CAST(event_id AS VARCHAR) || '-' || CAST(bag AS VARCHAR))", "'42:bag'")
CHUNK_ENSEMBLE = [
    EV, "ch AS (SELECT event_id, (seq - 1) // 500 AS chunk, cents, k, y_sudden AS y FROM ev)",
    "ct AS (SELECT chunk, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM ch GROUP BY chunk)",
    "tk AS (SELECT chunk, CASE WHEN q > p THEN 0 ELSE 1 END AS cut, least(p, q) AS keep, greatest(CAST(ceil(greatest(p, q) / least(p, q)::DOUBLE) AS INT), 11) AS nb FROM ct WHERE p > 0 AND q > 0)",
    "sp AS (SELECT ch.*, cut, keep, CAST(unnest(range(0, nb + CASE WHEN nb % 2 = 0 THEN 1 ELSE 0 END)) AS INT) AS bag FROM ch JOIN tk USING (chunk))",
    f"rk AS (SELECT *, row_number() OVER (PARTITION BY chunk, bag, y ORDER BY {_BAG}, event_id) AS r FROM sp)",
    f"st AS (SELECT chunk AS member, bag, {nb_stats_sql(['cents', 'k'], [0, 1], 'y', '()').replace(' OVER ()', '')} FROM rk WHERE y <> cut OR r <= keep GROUP BY chunk, bag)",
    f"sc AS ({nb_score_sql('(SELECT ch.*, st.* FROM ch JOIN st ON st.member BETWEEN ch.chunk - 10 AND ch.chunk)', ['cents', 'k'], [0, 1])})",
    "sg AS (SELECT event_id, chunk, member, y, sign(2 * avg(y_pred) - 1) AS s FROM sc GROUP BY ALL)",
    "gm AS (SELECT chunk, member, CASE WHEN count(*) FILTER (y = 1) = 0 OR count(*) FILTER (y = 0) = 0 THEN 0.0 ELSE sqrt(avg(CAST(s > 0 AS INT)) FILTER (y = 1) * avg(CAST(s < 0 AS INT)) FILTER (y = 0)) END AS g FROM sg GROUP BY ALL)",
    "tm AS (SELECT DISTINCT member, member + a AS t FROM gm, range(1, 11) x(a))",
    "wt AS (SELECT tm.member, t, product(g) AS w FROM tm JOIN gm ON gm.member = tm.member AND gm.chunk < t GROUP BY tm.member, t HAVING product(g) >= 0.1)",
    "pr AS (SELECT ch.event_id, ch.chunk, ch.y, coalesce(sum(s * w), 0) AS v FROM ch LEFT JOIN (SELECT sg.event_id, s, w FROM sg JOIN wt ON wt.member = sg.member AND wt.t = sg.chunk WHERE sg.member < sg.chunk) z ON z.event_id = ch.event_id GROUP BY ALL)",
]


@query("chunk_weighted_ensemble", "L13", sql=with_(*CHUNK_ENSEMBLE) + "SELECT chunk AS chunk_id, count(*) AS n, round(avg(CAST(y = CAST(v > 0 AS INT) AS INT)), 6) AS accuracy FROM pr GROUP BY chunk")
def _(spark, sf):
    e = events(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 500"))
    pred, _w = E.chunk_weighted_ensemble(e, "chunk_id", "event_id", ["cents", "k"], "y_sudden", members=10, bags=11)
    return _per_key(pred, "chunk_id")


@query("chunk_member_weights", "L13", sql=with_(*CHUNK_ENSEMBLE) + "SELECT t AS chunk_id, member, round(w, 6) AS weight FROM wt")
def _(spark, sf):
    e = events(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 500"))
    _p, weights = E.chunk_weighted_ensemble(e, "chunk_id", "event_id", ["cents", "k"], "y_sudden", members=10, bags=11)
    return weights.withColumn("weight", F.round("weight", 6))


@query("stable_dynamic", "L16", "Q4")
def _(spark, sf):
    out = E.stable_dynamic(events(spark, sf), ["user_id"], "seq", ["cents", "k"], "y_sudden", E.StableDynamic(2), hash_uniform(F.col("seq"), "dynamic-draw"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("is_queried").alias("asked"), F.round(F.avg((F.col("label") == F.col("y_pred")).cast("int")), 6).alias("accuracy"), F.max("n_members").alias("n_members"))


@query("stable_dynamic_reinforced", "L17", "Q5")
def _(spark, sf):
    machine = E.StableDynamic(2, reinforced=True, theta=0.5)
    out = E.stable_dynamic(events(spark, sf), ["user_id"], "seq", ["cents", "k"], "y_sudden", machine, hash_uniform(F.col("seq"), "reinforced-draw"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("is_queried").alias("asked"), F.round(F.avg((F.col("label") == F.col("y_pred")).cast("int")), 6).alias("accuracy"), F.max("n_members").alias("n_members"))


@query("expert_selection", "L11")
def _(spark, sf):
    from tidemark.plans.keyed import keyed_scan

    e = events(spark, sf).select("user_id", "seq", F.array(F.col("cents").cast("double"), F.col("k").cast("double")).alias("features"), F.col("y_sudden").alias("label"))
    out = keyed_scan(e, ["user_id"], "seq", E.ExpertSelection(), keep=("label",))
    return _per_key(out.withColumnRenamed("label", "y_true"), "user_id")


@query("varying_features", "L15", "P9")
def _(spark, sf):
    from tidemark.plans.keyed import keyed_scan

    e = events(spark, sf)
    n = e.count()
    x = F.array((F.col("cents") - 5000) / 5000.0, F.col("hr") / 24.0, F.col("k") / 100.0, F.col("dow") / 7.0)
    rows = e.select("user_id", "seq", FT.drop_features(to_sparse_map(x), F.col("seq"), n, 4).alias("features"), F.col("y_sudden").alias("label"))
    out = keyed_scan(rows, ["user_id"], "seq", E.VaryingFeatures(), keep=("label",))
    return _per_key(out.withColumnRenamed("label", "y_true"), "user_id")


LOG = "(CASE WHEN {a} > 0 THEN -{a}::DOUBLE / ({t}) * log2({a}::DOUBLE / ({t})) ELSE 0 END)"


def _entropy(k):
    t = " + ".join(f"{k}{c}" for c in range(3))
    return "(" + " + ".join(LOG.format(a=f"{k}{c}", t=t) for c in range(3)) + ")"


@query("hoeffding_split_stats", "L20", sql=with_(LI, "lg AS (SELECT month // 12 AS leaf, label, f.n AS feature, f.v AS v FROM (SELECT month, label, unnest([{'n': 'qty', 'v': qty}, {'n': 'disc', 'v': disc}, {'n': 'tax', 'v': tax}]) AS f FROM li))",
  "en AS (SELECT leaf, feature, min(v) AS lo, max(v) AS hi FROM lg GROUP BY ALL)",
  "bn AS (SELECT leaf, feature, lo, hi, label, least(CAST(floor((v - lo) / (hi - lo) * 10) AS INT), 9) AS b FROM lg JOIN en USING (leaf, feature))",
  "ct AS (SELECT leaf, feature, lo + (hi - lo) * c / 10 AS cut, " + ", ".join(f"count(*) FILTER (b < c AND label = {k}) AS a{k}, count(*) FILTER (b >= c AND label = {k}) AS b{k}, count(*) FILTER (label = {k}) AS t{k}" for k in range(3)) + " FROM bn, range(1, 10) r(c) GROUP BY leaf, feature, lo, hi, c)",
  f"ga AS (SELECT leaf, feature, cut, t0 + t1 + t2 AS n, round({_entropy('t')} - (a0 + a1 + a2) / (t0 + t1 + t2)::DOUBLE * {_entropy('a')} - (b0 + b1 + b2) / (t0 + t1 + t2)::DOUBLE * {_entropy('b')}, 10) AS gain FROM ct)",
  "bf AS (SELECT *, row_number() OVER (PARTITION BY leaf, feature ORDER BY gain DESC, cut) AS r FROM ga)",
  "rk AS (SELECT leaf, n, feature, cut, gain, lead(gain) OVER w AS second_gain, row_number() OVER w AS q FROM bf WHERE r = 1 WINDOW w AS (PARTITION BY leaf ORDER BY gain DESC, feature DESC))") +
  "SELECT leaf, n, feature, round(cut, 6) AS cut, round(gain, 6) AS gain, round(second_gain, 6) AS second_gain, round(log2(3) * sqrt(ln(1e7) / (2 * n)), 6) AS epsilon, gain - second_gain > log2(3) * sqrt(ln(1e7) / (2 * n)) AS split FROM rk WHERE q = 1")
def _(spark, sf):
    li = lines(spark, sf).withColumn("leaf", F.expr("month div 12"))
    out = E.hoeffding_split_stats(li, "leaf", ["qty", "disc", "tax"], "label", [0, 1, 2])
    return out.select("leaf", "n", "feature", *[F.round(c, 6).alias(c) for c in ("cut", "gain", "second_gain", "epsilon")], "split")


MEMBER = "CASE method WHEN 'nb' THEN 0 ELSE 3 END + round"
ERRS = "er AS (SELECT s % 3 AS grp, (s - 1) // 300 AS chunk_id, " + ", ".join(f"avg(CASE WHEN m = {i} THEN CAST(y_true <> y_pred AS INT) END) AS e{i}" for i in range(6)) + f" FROM (SELECT seq AS s, {MEMBER} AS m, y_true, y_pred FROM pred) GROUP BY ALL)"
DWM = fold_sql(source="SELECT * FROM er", key="grp", order="chunk_id", cols=[f"e{i}" for i in range(6)], state={**{f"w{i}": "CAST(1 AS DOUBLE)" for i in range(6)}, **{f"u{i}": "CAST(1 AS DOUBLE)" for i in range(6)}},
  steps=[{f"u{i}": f"w{i}" for i in range(6)}, {f"r{i}": f"w{i} * pow(0.1::DOUBLE, e{i})" for i in range(6)}, {"mx": "greatest(" + ", ".join(f"r{i}" for i in range(6)) + ")"},
         {f"w{i}": f"CASE WHEN r{i} / mx >= 0.2::DOUBLE THEN r{i} / mx ELSE 0 END" for i in range(6)}])


def dwm_weights(spark, sf):
    p = predictions(spark, sf).withColumn("member", F.when(F.col("method") == "nb", 0).otherwise(3) + F.col("round"))
    p = p.withColumn("grp", F.col("seq") % 3).withColumn("chunk_id", F.expr("(seq - 1) div 300"))
    errors = X.member_errors(p, ["grp"], "chunk_id", "member", 6, F.col("y_true") != F.col("y_pred"))
    return p, X.dynamic_weights(errors, ["grp"], "chunk_id", 6, X.majority_rule(0.1, 0.2))


@query("dynamic_weights", "L10", sql=recursive(PRED, ERRS, DWM) + "SELECT grp, chunk_id, [" + ", ".join(f"round(u{i}, 6)" for i in range(6)) + "] AS weights FROM f WHERE rn > 0")
def _(spark, sf):
    _p, w = dwm_weights(spark, sf)
    return w.withColumn("weights", F.transform("weights", lambda v: F.round(v, 6)))


@query("weighted_vote", "L10", sql=recursive(PRED, ERRS, DWM, "vt AS (SELECT p.seq, p.y_pred, sum(list_extract([" + ", ".join(f"u{i}" for i in range(6)) + f"], CAST({MEMBER} + 1 AS BIGINT))) AS v FROM pred p JOIN f ON f.rn > 0 AND f.grp = p.seq % 3 AND f.chunk_id = (p.seq - 1) // 300 GROUP BY p.seq, p.y_pred)") +
  "SELECT seq, y_pred FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(v, 9) DESC, y_pred) AS r FROM vt) WHERE r = 1")
def _(spark, sf):
    p, w = dwm_weights(spark, sf)
    rounded = w.withColumn("weights", F.transform("weights", lambda v: F.round(v, 12)))
    return X.weighted_vote(p, rounded, ["grp"], "chunk_id", ["seq"], "member", "y_pred").select("seq", "y_pred")


@query("cost_weights", "L10", sql=with_(EV, "b AS (SELECT event_id, y, CAST(k < 30 AS INT) AS p, CASE WHEN y = 1 THEN 3.0 ELSE 1.0 END AS c FROM ev)",
  "a AS (SELECT 0.5 * ln(sum(CASE WHEN y = p THEN c ELSE 0 END) / sum(CASE WHEN y <> p THEN c ELSE 0 END)) AS alpha FROM b)", "r AS (SELECT event_id, c * exp(CASE WHEN y = p THEN -alpha ELSE alpha END) AS w, alpha FROM b, a)") +
  "SELECT event_id, round(w / (SELECT sum(w) FROM r) * (SELECT count(*) FROM r), 6) AS weight, round(alpha, 6) AS alpha FROM r")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "y", (F.col("k") < 30).cast("int").alias("p"), F.lit(1.0).alias("weight"))
    out = X.cost_weights(e, "y", "p", [1.0, 3.0])
    return out.select("event_id", F.round("weight", 6).alias("weight"), F.round("alpha", 6).alias("alpha"))
