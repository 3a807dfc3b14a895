"""Density and importance-weight queries over yearly batches of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import density as DE
from tidemark.operators import detect as D
from tidemark.operators import experts as X
from tidemark.operators import metrics as M
from tidemark.operators import naive_bayes as NB
from tidemark.operators import weights as W
from tidemark.queries import query
from tidemark.queries.base import EV, LI, SCORED, events, fold_sql, lines, recursive, scored, uniform_sql, with_
from tidemark.queries.detectors import ph_fold
from tidemark.queries.metrics import nb_score_sql, nb_stats_sql

KF = ["qty", "tax"]
WF = [*KF, "label"]  # the density is that of features and label together


def _cov(i: int, j: int) -> str:
    return f"s{min(i, j)}{max(i, j)}"


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_SQUARE = "(" + " + ".join(f"{_cov(i, j)} * {_cov(i, j)}" for i in range(3) for j in range(3)) + ")"
_TRACE = "(s00 + s11 + s22)"
_C = lambda i, j: f"c{min(i, j)}{max(i, j)}"


def _adjugate(i: int, j: int) -> str:
    r, c = [x for x in range(3) if x != j], [x for x in range(3) if x != i]
    sign = "" if (i + j) % 2 == 0 else "-"
    return f"{sign}({_C(r[0], c[0])} * {_C(r[1], c[1])} - {_C(r[0], c[1])} * {_C(r[1], c[0])})"


_DET = "(" + " + ".join(f"c0{j} * ({_adjugate(j, 0)})" for j in range(3)) + ")"
_FORM = " + ".join(f"({WF[i]} - m{i}) * ({WF[j]} - m{j}) * ({_adjugate(i, j)})" for i in range(3) for j in range(3))
MODEL = f"""yr AS (SELECT *, month // 12 AS batch FROM li),
mo0 AS (SELECT batch, count(*) AS n, {", ".join(f"avg({f}) AS m{i}" for i, f in enumerate(WF))}, {", ".join(f"covar_pop({WF[i]}, {WF[j]}) AS s{i}{j}" for i, j in _PAIRS)} FROM yr GROUP BY batch),
mo1 AS (SELECT *, CASE WHEN {_SQUARE} - {_TRACE} * {_TRACE} / 3 = 0 THEN 1.0 ELSE least(1.0, ((1 - 2 / 3.0) * {_SQUARE} + {_TRACE} * {_TRACE}) / ((n + 1 - 2 / 3.0) * ({_SQUARE} - {_TRACE} * {_TRACE} / 3))) END AS r FROM mo0),
mo AS (SELECT batch AS mb, m0, m1, m2, {", ".join(f"(1 - r) * s{i}{j}" + (f" + r * {_TRACE} / 3 + 1e-9" if i == j else "") + f" AS c{i}{j}" for i, j in _PAIRS)} FROM mo1),
md AS (SELECT *, {_DET} AS det FROM mo),
newest AS (SELECT max(mb) AS nb FROM mo),
dens AS (SELECT rid, batch, label, qty, disc, tax, mb, -0.5 * (3 * ln(2 * pi()) + ln(det)) - 0.5 * ({_FORM}) / det AS lp FROM yr, md),
ps AS (SELECT rid, batch, any_value(label) AS label, any_value(qty) AS qty, any_value(disc) AS disc, any_value(tax) AS tax, sum(CASE WHEN mb = nb THEN exp(lp) END) AS p_new, sum(CASE WHEN mb = batch THEN exp(lp) END) AS p_own, avg(exp(lp)) AS p_mean, avg(CASE WHEN mb = batch OR mb = batch - 1 THEN exp(lp) END) AS p_near, count(*) FILTER (mb = batch) AS dup FROM dens, newest GROUP BY rid, batch)"""


def batches(spark, sf):
    return lines(spark, sf).withColumn("batch", F.expr("month div 12"))


def densities(spark, sf, need, window=None):
    b = batches(spark, sf)
    return DE.batch_densities(b, DE.BatchDensities.fit(b, "batch", WF), "batch", window, need=need)


@query("mvn_logpdf", "M1", sql=with_(LI, MODEL) + "SELECT rid, batch, round(lp, 5) AS logpdf FROM dens WHERE mb = batch")
def _(spark, sf):
    b = batches(spark, sf)
    out = DE.mvn_logpdf(b, DE.BatchDensities.fit(b, "batch", WF), "batch")
    return out.select("rid", "batch", F.round("logpdf", 5).alias("logpdf"))


@query("kde_logpdf", "M2", sql=with_(LI) + """SELECT a.rid, round(ln(avg(exp(-((a.qty - b.qty) * (a.qty - b.qty) + (a.tax - b.tax) * (a.tax - b.tax)) / 8.0))) - ln(2 * pi() * 4.0), 5) AS logpdf
  FROM li a JOIN li b ON a.month = b.month GROUP BY a.rid""")
def _(spark, sf):
    li = lines(spark, sf)
    return DE.kde_logpdf(li, li, ["month"], KF, "rid", bandwidth=2.0).select("rid", F.round("logpdf", 5).alias("logpdf"))


GMM_STEPS = 12


def gmm_sql() -> list[str]:
    """Two components over qty and tax of the newest batch, as one recursion over steps of sums around the overall mean."""
    x = ["qty", "tax"]
    comp = range(2)
    state = [f"{n}{j}" for j in comp for n in ("w", "a", "b", "v", "c", "u")]  # weight, means, covariance (v c; c u)

    def log_part(j: int) -> str:
        det = f"(v{j} * u{j} - c{j} * c{j})"
        form = f"((x - a{j}) * (x - a{j}) * u{j} - 2 * (x - a{j}) * (y - b{j}) * c{j} + (y - b{j}) * (y - b{j}) * v{j}) / {det}"
        return f"ln(w{j}) - ln(2 * pi()) - 0.5 * ln({det}) - 0.5 * {form}"

    parts = ", ".join(f"{log_part(j)} AS l{j}" for j in comp)
    new = []
    for j in comp:
        r = f"exp(l{j} - t)"
        n = f"sum({r})"
        new += [f"{n} / count(*) AS w{j}", f"any_value(mx) + sum({r} * (x - mx)) / {n} AS a{j}", f"any_value(my) + sum({r} * (y - my)) / {n} AS b{j}",
                f"sum({r} * (x - mx) * (x - mx)) / {n} - pow(sum({r} * (x - mx)) / {n}, 2) + 1e-6 AS v{j}",
                f"sum({r} * (x - mx) * (y - my)) / {n} - sum({r} * (x - mx)) / {n} * sum({r} * (y - my)) / {n} AS c{j}",
                f"sum({r} * (y - my) * (y - my)) / {n} - pow(sum({r} * (y - my)) / {n}, 2) + 1e-6 AS u{j}"]
    total = "greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1)))"
    start = ", ".join(f"0.5::DOUBLE AS w{j}, mx + {2 * j - 1} / 2.0::DOUBLE * sqrt(sx) AS a{j}, my + {2 * j - 1} / 2.0::DOUBLE * sqrt(sy) AS b{j}, sx + 1e-6 AS v{j}, 0::DOUBLE AS c{j}, sy + 1e-6 AS u{j}" for j in comp)
    return [
        LI, f"pt AS (SELECT CAST({x[0]} AS DOUBLE) AS x, CAST({x[1]} AS DOUBLE) AS y FROM li WHERE month // 12 = (SELECT max(month // 12) FROM li))",
        "mo AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS sx, var_pop(y) AS sy FROM pt)",
        f"em AS (SELECT 0 AS i, {start} FROM mo UNION ALL SELECT i + 1, {', '.join(new)} FROM (SELECT *, {total} AS t FROM (SELECT em.*, x, y, mx, my, {parts} FROM em, pt, mo WHERE i < {GMM_STEPS}) z0) z1 GROUP BY i)",
        f"lp AS (SELECT batch, rid, {total} AS lp FROM (SELECT batch, rid, {parts} FROM (SELECT month // 12 AS batch, rid, qty AS x, tax AS y, {', '.join(state)} FROM li, em WHERE i = {GMM_STEPS}) z2) z3)"]


@query("gmm_logpdf", "M3", sql=recursive(*gmm_sql()) + "SELECT rid, batch, round(lp, 5) AS logpdf FROM lp")
def _(spark, sf):
    b = batches(spark, sf)
    newest = b.agg(F.max("batch")).first()[0]
    out = DE.gmm_logpdf(b, b.filter(F.col("batch") == newest), KF, k=2, steps=GMM_STEPS, tolerance=-1.0)
    return out.select("rid", "batch", F.round("logpdf", 5).alias("logpdf"))


def scaled_sql(raw: str, clip: bool = True) -> str:
    c = f"greatest(0.0, least({raw}, 100.0))" if clip else raw
    return with_(LI, MODEL, f"w AS (SELECT *, {c} AS w FROM ps)") + "SELECT rid, round(w / (SELECT sum(abs(w)) FROM w) * (SELECT count(*) FROM w), 5) AS weight FROM w"


def _out(df):
    return df.select("rid", F.round("weight", 5).alias("weight"))


@query("weight_direct", "M4", sql=scaled_sql("p_new / (SELECT sqrt(sum(p_new * p_new)) FROM ps)"))
def _(spark, sf):
    return _out(W.weight_direct(densities(spark, sf, ("new",))))


@query("weight_ratio", "M5", sql=scaled_sql("p_new / (p_own + 1e-16)"))
def _(spark, sf):
    return _out(W.weight_ratio(densities(spark, sf, ("new", "own"))))


@query("weight_balance", "M6", sql=scaled_sql("p_new / p_mean"))
def _(spark, sf):
    return _out(W.weight_balance(densities(spark, sf, ("new", "mean"))))


@query("weight_balance_window", "M7", sql=scaled_sql("p_new / (p_near + 0.01)"))
def _(spark, sf):
    return _out(W.weight_balance_window(densities(spark, sf, ("new", "near"), window=1)))


@query("weight_power_law", "M8", sql=with_(LI, MODEL) + "SELECT rid, round(1 / (0.1 / greatest(p_new / (p_own + 1e-16), 1e-300) + 0.9), 5) AS weight FROM ps")
def _(spark, sf):
    return _out(W.weight_power_law(densities(spark, sf, ("new", "own")), 0.9, -1.0))


def _tuning_sql(rounds: int = 5, cells: int = 16, delta: float = 0.1) -> list[str]:
    """The grid narrowed round by round: the first point whose criterion is not negative, and the one before it."""
    parts = ["rw AS (SELECT batch, greatest(p_new / (p_own + 1e-16), 1e-300) AS w FROM ps)", "z0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"]
    for i in range(1, rounds + 1):
        x = f"lo + (hi - lo) * i / {cells}::DOUBLE"
        parts.append(f"y{i} AS (SELECT i, lo, hi, {x} AS x, ({x}) * ({x}) / count(*) * sum(pow(1 / ((1 - ({x})) / w + ({x})), 2)) - 2 * log10(1 / {delta}::DOUBLE) / (3 * count(*)) AS v "
                     f"FROM rw, z{i - 1}, range(1, {cells + 1}) t(i) GROUP BY i, lo, hi)")
        parts.append(f"z{i} AS (SELECT CASE WHEN a IS NULL THEN hi ELSE lo + (hi - lo) * (a - 1) / {cells}::DOUBLE END AS lo, CASE WHEN a IS NULL THEN hi ELSE lo + (hi - lo) * a / {cells}::DOUBLE END AS hi "
                     f"FROM (SELECT min(i) FILTER (v >= 0) AS a, any_value(lo) AS lo, any_value(hi) AS hi FROM y{i}))")
    return [*parts, f"lm AS (SELECT hi AS lam FROM z{rounds})"]


@query("weight_power_law_tuned", "M8", sql=with_(LI, MODEL, *_tuning_sql()) + "SELECT batch, round(avg(1 / ((1 - lam) / w + lam)), 4) AS weight, round(any_value(lam), 4) AS lam FROM rw, lm GROUP BY batch")
def _(spark, sf):
    return W.weight_power_law(densities(spark, sf, ("new", "own")), None, -1.0).groupBy("batch").agg(F.round(F.avg("weight"), 4).alias("weight"), F.round(F.max("lam"), 4).alias("lam"))


@query("weight_recent", "M9", sql=with_(LI) + """, b AS (SELECT rid, CAST(month // 12 > (SELECT max(month // 12) FROM li) - 2 AS INT) AS w FROM li) SELECT rid, round(w / (SELECT sum(w) FROM b) * (SELECT count(*) FROM b), 5) AS weight FROM b""")
def _(spark, sf):
    return _out(W.weight_recent(batches(spark, sf), "batch", 2))


@query("weight_uniform", "M9", sql=with_(LI) + "SELECT rid, 1.0 AS weight FROM li")
def _(spark, sf):
    return _out(W.weight_uniform(batches(spark, sf)))


@query("weight_classifier", "M10")
def _(spark, sf):
    out = W.weight_classifier(batches(spark, sf), "batch", WF)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 2).alias("weight"))


NEWTON = 12


def logistic_sql() -> list[str]:
    """The maximum of the likelihood that a row is of the newest batch, by Newton steps; each step solves by elimination."""
    x, n = ["1", *WF], 4
    cell = lambda i, j: f"t{i}" if j == n else f"g{min(i, j)}_{max(i, j)}"
    grid = [(i, j) for i in range(n) for j in range(n + 1)]
    line = " + ".join(f"b{i} * {x[i]}" for i in range(n))
    held = ", ".join(f"b{i}" for i in range(n))
    sums = ", ".join([f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS g{i}_{j}" for i in range(n) for j in range(i, n)] + [f"sum((y - p) * {x[i]}) AS t{i}" for i in range(n)]
                     + [f"any_value(b{i}) AS b{i}" for i in range(n)])
    step = f"SELECT i, {sums} FROM (SELECT *, 1 / (1 + exp(-({line}))) AS p FROM nr, ys WHERE i < {NEWTON}) z GROUP BY i"
    step = f"SELECT i, {held}, {', '.join(f'{cell(i, j)} AS a{i}_{j}' for i, j in grid)} FROM ({step}) z0"
    for k in range(n):
        step = f"SELECT i, {held}, " + ", ".join(f"a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i, j in grid) + f" FROM ({step}) z{k + 1}"
    return [
        LI, "ys AS (SELECT month // 12 AS batch, qty, tax, CAST(label AS DOUBLE) AS label, CAST(month // 12 = (SELECT max(month // 12) FROM li) AS INT) AS y FROM li)",
        f"nr AS (SELECT 0 AS i, {', '.join(f'0::DOUBLE AS b{i}' for i in range(n))} UNION ALL SELECT i + 1, {', '.join(f'b{i} + a{i}_{n}' for i in range(n))} FROM ({step}) z9)",
        f"pr AS (SELECT batch, 1 / (1 + exp(-({line}))) AS w FROM ys, nr WHERE i = {NEWTON})"]


@query("weight_logistic", "M10", sql=recursive(*logistic_sql()) + "SELECT batch, round(avg(w) / (SELECT avg(w) FROM pr), 4) AS weight, round(max(w) / (SELECT avg(w) FROM pr), 4) AS most FROM pr GROUP BY batch")
def _(spark, sf):
    out = W.weight_classifier(batches(spark, sf), "batch", WF, model="logistic")
    return out.groupBy("batch").agg(F.round(F.avg("weight"), 4).alias("weight"), F.round(F.max("weight"), 4).alias("most"))


@query("weight_rulsif", "M11")
def _(spark, sf):
    out = W.weight_rulsif(batches(spark, sf), "batch", WF, "rid")
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 3).alias("weight"))


@query("weight_kliep", "M11")
def _(spark, sf):
    out = W.weight_kliep(batches(spark, sf), "batch", WF, "rid")
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 3).alias("weight"))


DRAW = uniform_sql("id", "'42:draw'")


@query("importance_resample", "M12", sql=with_(EV, f"d AS (SELECT CAST(id // 200 AS INT) AS replica, CAST(id % 200 AS INT) AS draw, {DRAW} AS u FROM range(0, 2000) t(id))",
  "c AS (SELECT event_id, sum(k) OVER (ORDER BY seq) - k AS lo, sum(k) OVER (ORDER BY seq) AS hi, sum(k) OVER () AS total FROM ev WHERE k > 0)") +
  "SELECT replica, draw, event_id FROM d JOIN c ON u * total >= lo AND u * total < hi")
def _(spark, sf):
    out = W.importance_resample(events(spark, sf).select("event_id", "seq", "k"), "k", "seq", size=200, replicas=10)
    return out.select("replica", "draw", "event_id")


@query("resampled_bag", "M12", sql=with_(EV, f"d AS (SELECT CAST(id // 200 AS INT) AS replica, CAST(id % 200 AS INT) AS draw, {DRAW} AS u FROM range(0, 2000) t(id))",
  "c AS (SELECT event_id, sum(k) OVER (ORDER BY seq) - k AS lo, sum(k) OVER (ORDER BY seq) AS hi, sum(k) OVER () AS total FROM ev WHERE k > 0)",
  "sm AS (SELECT replica, ev.cents, ev.hr, ev.y_sudden FROM d JOIN c ON u * total >= lo AND u * total < hi JOIN ev ON ev.event_id = c.event_id)",
  f"st AS (SELECT replica, {nb_stats_sql(['cents', 'hr'], [0, 1], 'y_sudden', '()').replace(' OVER ()', '')} FROM sm GROUP BY replica)",
  f"sc AS ({nb_score_sql('(SELECT ev.*, st.* FROM ev, st)', ['cents', 'hr'], [0, 1], proba=True)})") + "SELECT event_id, round(avg(p1), 4) AS p1 FROM sc GROUP BY event_id")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "seq", "k", "hr", "cents", "y_sudden")
    out = W.resampled_bag(e, e, "k", "seq", ["cents", "hr"], "y_sudden", [0, 1], size=200, replicas=10)
    return out.select("event_id", F.round(F.get("proba", F.lit(1)), 4).alias("p1"))


REFIT = "w AS (SELECT *, greatest(0.0, least(p_new / (p_own + 1e-16), 100.0)) AS raw FROM ps), w2 AS (SELECT *, raw / (SELECT sum(raw) FROM w) * (SELECT count(*) FROM w) AS wt FROM w)"


@query("weighted_refit", "M13", "L1", sql=with_(LI, MODEL, REFIT, f"st AS (SELECT DISTINCT {nb_stats_sql(['qty', 'disc', 'tax'], [0, 1, 2], 'label', '()', 'wt')} FROM w2)",
       f"sc AS ({nb_score_sql('(SELECT w2.*, st.* FROM w2, st)', ['qty', 'disc', 'tax'], [0, 1, 2])})") + "SELECT batch, avg(CAST(label = y_pred AS INT)) AS accuracy FROM sc GROUP BY batch")
def _(spark, sf):
    w = W.weight_ratio(densities(spark, sf, ("new", "own")))
    model = W.weighted_refit(w, ["qty", "disc", "tax"], "label", [0, 1, 2], "weight")
    scored_ = NB.predict_nb(w, model, ["qty", "disc", "tax"], [0, 1, 2])
    return M.accuracy(scored_.withColumn("y_true", F.col("label")), ["batch"])


_OAS2 = "least(1.0, (TR * TR) / (n * (SQ - TR * TR / 2)))".replace("SQ", "(s00 * s00 + 2 * s01 * s01 + s11 * s11)").replace("TR", "(s00 + s11)")
_SPREAD2 = "(s00 * s00 + 2 * s01 * s01 + s11 * s11) - (s00 + s11) * (s00 + s11) / 2"
_LOG2 = "-0.5 * (2 * ln(2 * pi()) + ln(c00 * c11 - c01 * c01) + ((x0 - m0) * (x0 - m0) * c11 - 2 * (x0 - m0) * (x1 - m1) * c01 + (x1 - m1) * (x1 - m1) * c00) / (c00 * c11 - c01 * c01))"
DENSITY_DRIFT = [
    EV, "rw AS (SELECT user_id, seq, cents / 100.0::DOUBLE AS x0, CAST(k AS DOUBLE) AS x1, (row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) // 20 AS ch FROM ev)",
    "m0 AS (SELECT user_id, ch, count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, var_pop(x0) AS s00, var_pop(x1) AS s11, covar_pop(x0, x1) AS s01 FROM rw GROUP BY ALL)",
    f"m1 AS (SELECT *, CASE WHEN n * ({_SPREAD2}) = 0 THEN 1.0 ELSE {_OAS2} END AS r FROM m0)",
    "m2 AS (SELECT user_id, ch, m0, m1, (1 - r) * s00 + r * (s00 + s11) / 2 + 1e-9 AS c00, (1 - r) * s11 + r * (s00 + s11) / 2 + 1e-9 AS c11, (1 - r) * s01 AS c01 FROM m1)",
    f"ow AS (SELECT rw.user_id, rw.ch, avg({_LOG2}) AS mu, stddev_pop({_LOG2}) AS sd FROM rw JOIN m2 ON m2.user_id = rw.user_id AND m2.ch = rw.ch GROUP BY ALL)",
    f"st AS (SELECT rw.user_id, rw.seq, (mu - ({_LOG2})) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS x FROM rw JOIN m2 ON m2.user_id = rw.user_id AND m2.ch = rw.ch - 1 JOIN ow ON ow.user_id = rw.user_id AND ow.ch = rw.ch - 1)",
    ph_fold("SELECT * FROM st", "user_id", threshold=10.0).replace("0.005::DOUBLE", "0.05::DOUBLE"),
]


@query("density_drift", "D7", sql=recursive(*DENSITY_DRIFT) + "SELECT user_id, seq, 'change' AS kind, round(mean, 6) AS estimation FROM f WHERE rn > 0 AND chg")
def _(spark, sf):
    from tidemark.operators.stream_models import density_drift

    e = events(spark, sf).withColumn("x0", F.col("cents") / 100.0).withColumn("x1", F.col("k").cast("double"))
    out = density_drift(e, ["user_id"], "seq", ["x0", "x1"], chunk=20, machine=D.PageHinkley(threshold=10.0, delta=0.05))
    return out.withColumn("estimation", F.round("estimation", 6))


RMSE = """rm AS (SELECT model, month, sqrt(avg((target - p) * (target - p))) AS e FROM (SELECT 'slope2' AS model, month, target, 2 * qty AS p FROM li UNION ALL SELECT 'slope3', month, target, 3 * qty FROM li UNION ALL SELECT 'flat', month, target, 70 FROM li) GROUP BY ALL)"""
EW = fold_sql(source="SELECT model, month, e FROM rm", key="model", order="month", cols=["e"], state={"r": "CAST(0 AS DOUBLE)"}, steps=[{"r": "(1 - 0.1::DOUBLE) * r + 0.1::DOUBLE * e"}])


def model_rmse(spark, sf):
    preds = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in (
        ("slope2", 2.0 * F.col("qty")), ("slope3", 3.0 * F.col("qty")), ("flat", F.lit(70.0)))]))
    li = lines(spark, sf).select("month", "target", preds.alias("m")).select("month", "target", "m.*")
    return li.groupBy("model", "month").agg(F.sqrt(F.avg((F.col("target") - F.col("p")) * (F.col("target") - F.col("p")))).alias("e"))


@query("ewma_metric", "W6", sql=recursive(LI, RMSE, EW) + "SELECT model, month, round(r, 5) AS ewma FROM f WHERE rn > 0")
def _(spark, sf):
    return X.ewma_metric(model_rmse(spark, sf), ["model"], "month", F.col("e")).withColumn("ewma", F.round("ewma", 5))


@query("best_model_ewma", "W6", sql=recursive(LI, RMSE, EW) + "SELECT month, arg_min(model, r) AS model, round(min(r), 5) AS ewma FROM f WHERE rn > 0 GROUP BY month")
def _(spark, sf):
    best = X.best_model_ewma(X.ewma_metric(model_rmse(spark, sf), ["model"], "month", F.col("e")), "model", "month")
    return best.withColumn("ewma", F.round("ewma", 5))


@query("label_prior_omd", "L22", sql=recursive(EV, SCORED, "g AS (SELECT hr, (seq - 1) // 1000 AS chunk_id, avg(proba[1] - CAST(label = 0 AS INT)) AS g0, avg(proba[2] - CAST(label = 1 AS INT)) AS g1, avg(proba[3] - CAST(label = 2 AS INT)) AS g2 FROM scored GROUP BY ALL)",
  fold_sql(source="SELECT * FROM g", key="hr", order="chunk_id", cols=["g0", "g1", "g2"], state={"t": "0", "p0": "1.0::DOUBLE / 3", "p1": "1.0::DOUBLE / 3", "p2": "1.0::DOUBLE / 3"},
   steps=[{"t": "t + 1"}, {f"r{i}": f"p{i} * exp(-0.5::DOUBLE / sqrt(t) * g{i}) + 1e-4" for i in range(3)}, {f"p{i}": f"r{i} / (r0 + r1 + r2)" for i in range(3)}])) +
  "SELECT hr, chunk_id, [round(p0, 6), round(p1, 6), round(p2, 6)] AS prior FROM f WHERE rn > 0")
def _(spark, sf):
    s = scored(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 1000"))
    out = X.label_prior_omd(s, ["hr"], "chunk_id", "proba", "label", 3, eta=0.5)
    return out.withColumn("prior", F.transform("prior", lambda p: F.round(p, 6)))


# every batch's candidate refit, its error on every later batch, and the fold that picks the version in force
REWEIGHTED = [
    LI, MODEL, "ow AS (SELECT *, max(CASE WHEN mb = batch THEN lp END) OVER (PARTITION BY rid, batch) AS own FROM dens)",
    "rw AS (SELECT mb AS s, label, qty, tax, least(exp(lp) / (exp(own) + 1e-16), 100.0) AS w FROM ow WHERE batch <= mb)",
    f"st AS (SELECT s, {nb_stats_sql(KF, [0, 1, 2], 'label', '()', 'w').replace(' OVER ()', '')} FROM rw GROUP BY s)",
    f"sc AS ({nb_score_sql('(SELECT yr.rid, yr.batch, yr.label, yr.qty, yr.tax, st.* FROM yr JOIN st ON st.s < yr.batch)', KF, [0, 1, 2])})",
    "er AS (SELECT s, batch AS t, avg(CAST(y_pred <> label AS INT)) AS e FROM sc GROUP BY ALL)",
    """ph AS (SELECT min(batch) AS t, min(batch) AS s, CAST(NULL AS BIGINT) AS used, 0::BIGINT AS n, 0::DOUBLE AS total, 0::DOUBLE AS up, CAST(NULL AS DOUBLE) AS e, false AS drifted FROM yr
  UNION ALL SELECT t, CASE WHEN u > 0.02 THEN t ELSE s END, s, CASE WHEN u > 0.02 THEN 0 ELSE n END, CASE WHEN u > 0.02 THEN 0 ELSE total END, CASE WHEN u > 0.02 THEN 0 ELSE u END, e, u > 0.02
  FROM (SELECT er.t, ph.s, ph.n + 1 AS n, ph.total + er.e AS total, er.e, greatest(0, 0.9999 * ph.up + er.e - (ph.total + er.e) / (ph.n + 1) - 0.005) AS u
    FROM ph JOIN er ON er.s = ph.s AND er.t = ph.t + 1) z)""",
]


@query("iwda_stream", "L21", sql=recursive(*REWEIGHTED) + "SELECT t AS batch, used AS version, round(1 - e, 6) AS accuracy, drifted FROM ph")
def _(spark, sf):
    from tidemark.operators.stream_models import reweighted_stream

    _rows, versions = reweighted_stream(batches(spark, sf), "batch", KF, "label", [0, 1, 2])
    return versions.withColumn("accuracy", F.round("accuracy", 6))


@query("iwda_predictions", "L21", sql=recursive(*REWEIGHTED) + "SELECT yr.rid, yr.batch, used AS version, sc.y_pred FROM yr JOIN ph ON ph.t = yr.batch LEFT JOIN sc ON sc.rid = yr.rid AND sc.batch = yr.batch AND sc.s = ph.used")
def _(spark, sf):
    from tidemark.operators.stream_models import reweighted_stream

    rows, _versions = reweighted_stream(batches(spark, sf), "batch", KF, "label", [0, 1, 2])
    return rows.select("rid", "batch", "version", "y_pred")


@query("prequential_auc", "L21", sql=with_(EV, """s AS (SELECT (seq - 1) // 1000 AS interval, y AS y_true, (k * 7 + hr) / 723.0 AS score FROM ev)""",
  """c AS (SELECT e.interval, score, sum(y_true) AS p, sum(1 - y_true) AS n FROM (SELECT DISTINCT interval FROM s) e JOIN s ON s.interval <= e.interval GROUP BY ALL)""",
  """r AS (SELECT interval, p, n, coalesce(sum(n) OVER (PARTITION BY interval ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)""") +
  "SELECT interval, round(sum(p * (below + n / 2.0)) / sum(p) / sum(n), 6) AS auc FROM r GROUP BY interval")
def _(spark, sf):
    e = events(spark, sf).select("seq", F.col("y").alias("y_true"), ((F.col("k") * 7 + F.col("hr")) / 723.0).alias("score"), F.lit(0).alias("y_pred"))
    return M.prequential_imbalance(e, [], 1000, []).select("interval", F.round("auc", 6).alias("auc"))
