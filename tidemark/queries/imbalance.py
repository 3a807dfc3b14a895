"""Regression, resampling and bagging-weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import poisson_cdf
from tidemark.operators import metrics as M
from tidemark.operators import regress as R
from tidemark.operators import resample as RS
from tidemark.queries import query
from tidemark.queries.base import DOC, EV, LI, documents, events, fold_sql, lines, recursive, uniform_sql, with_


def sgd_fold(update_w: str, lr: str, kind: str) -> str:
    return fold_sql(
        source="SELECT user_id, seq, k / 100.0 AS x, 3 * (k / 100.0) + hr / 24.0 AS y FROM ev", key="user_id", order="seq", cols=["x", "y"],
        state={"w": "CAST(0 AS DOUBLE)", "b": "CAST(0 AS DOUBLE)", "lr": f"{lr}::DOUBLE", "p": "CAST(0 AS DOUBLE)"},
        steps=[{"p": "x * w + b"}, {"err": "y - p"}, {"w": update_w, "b": "b + lr * err", "lr": "lr * 0.99::DOUBLE" if kind == "linear" else "lr"}])


UPDATES = {
    "linear": "w + lr * err * x",
    "ridge": "w - lr * (0.01::DOUBLE * w - err * x)",
    "lasso": "w + lr * CASE WHEN w = 0 THEN (CASE WHEN abs(err * x) > 0.01 THEN err * x - 0.01::DOUBLE * sign(err * x) ELSE 0 END) ELSE err * x - 0.01::DOUBLE * sign(w) END",
}


def _sgd(kind):
    def run(spark, sf):
        e = events(spark, sf).withColumn("x", F.col("k") / 100.0).withColumn("t", 3 * (F.col("k") / 100.0) + F.col("hr") / 24.0)
        out = R.sgd_regression(e, ["user_id"], "seq", ["x"], "t", R.Sgd(kind, rate=0.02))
        return out.select("user_id", "seq", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 6).alias("y_pred"))

    return run


for _kind, _update in UPDATES.items():
    query(f"sgd_{_kind}", "L18", sql=recursive(EV, sgd_fold(_update, "0.02", _kind)) + "SELECT user_id, seq, round(y, 6) AS y_true, round(p, 6) AS y_pred FROM f WHERE rn > 0")(_sgd(_kind))


@query("sgd_warm", "L18", "R3")
def _(spark, sf):
    e = events(spark, sf).withColumn("t", 3 * (F.col("k") / 100.0) + F.col("hr") / 24.0)
    out = R.sgd_regression(e, ["user_id"], "seq", ["k", "hr"], "t", R.Sgd("lasso", rate=0.01, warm=20))
    return M.regression_metrics(out, []).select(*[F.round(c, 4).alias(c) for c in ("MSE", "MAE", "R2", "RMSE")])


RF = ["qty", "disc", "tax"]
_X = ["1", *RF]
_N = len(_X)
_FIT = "b0 + " + " + ".join(f"b{i + 1} * {f}" for i, f in enumerate(RF))


def ridge_sql(source: str, key: str = "", weight: str = "1") -> list[str]:
    """Coefficients b0.. of every month (and ``key``) from the months before it: sums of products, then elimination."""
    by = f"month, {key}" if key else "month"
    names = {f"g{i}_{j}": f"{weight} * {_X[i]} * {_X[j]}" for i in range(_N) for j in range(i, _N)} | {f"t{i}": f"{weight} * {_X[i]} * target" for i in range(_N)}
    cell = lambda i, j: f"t{i}" if j == _N else f"g{min(i, j)}_{max(i, j)}"
    parts = [
        f"pm AS (SELECT {by}, " + ", ".join(f"sum(CAST({x} AS DOUBLE)) AS {n}" for n, x in names.items()) + f" FROM {source} GROUP BY {by})",
        f"pp AS (SELECT {by}, " + ", ".join(f"coalesce(sum({n}) OVER w, 0) AS {n}" for n in names)
        + f" FROM pm WINDOW w AS ({f'PARTITION BY {key} ' if key else ''}ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"e0 AS (SELECT {by}, " + ", ".join(f"{cell(i, j)}{(' + 1e-12' if i == 0 else ' + 1') if i == j else ''} AS a{i}_{j}" for i in range(_N) for j in range(_N + 1)) + " FROM pp)"]
    for k in range(_N):
        parts.append(f"e{k + 1} AS (SELECT {by}, " + ", ".join(
            f"a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i in range(_N) for j in range(_N + 1)) + f" FROM e{k})")
    mean = (lambda x: f"avg({x})") if key else (lambda x: x)
    parts.append("co AS (SELECT month, " + ", ".join(f"{mean(f'a{i}_{_N}')} AS b{i}" for i in range(_N)) + f" FROM e{_N}{' GROUP BY month' if key else ''})")
    return parts


@query("chunked_ridge", "L18", "R3", sql=with_(LI, *ridge_sql("li")) + f"SELECT rid, round({_FIT}, 4) AS y_pred FROM li JOIN co USING (month)")
def _(spark, sf):
    out = R.chunked_ridge(lines(spark, sf), [], "month", RF, "target", reg=1.0)
    return out.select("rid", F.round("y_pred", 4).alias("y_pred"))


@query("prequential_regression", "R3", "G5", sql=with_(LI, *ridge_sql("li")) + f"""SELECT round(avg(e * e), 4) AS MSE, round(avg(abs(e)), 4) AS MAE, round(1 - avg(e * e) / var_pop(target), 4) AS R2, round(sqrt(avg(e * e)), 4) AS RMSE
  FROM (SELECT target, target - ({_FIT}) AS e FROM li JOIN co USING (month))""")
def _(spark, sf):
    out = R.chunked_ridge(lines(spark, sf), [], "month", RF, "target", reg=1.0)
    return M.regression_metrics(out.withColumn("y_true", F.col("target")), []).select(*[F.round(c, 4).alias(c) for c in ("MSE", "MAE", "R2", "RMSE")])


BAGW = "CAST(len(list_filter([" + ", ".join(repr(p) for p in poisson_cdf(6.0, 1e-10)) + "], lambda p: p <= " + uniform_sql("rid", "'bag' || CAST(m AS VARCHAR)") + ")) AS DOUBLE)"
BAG = [f"bw AS (SELECT li.*, m, {BAGW} AS w FROM li, range(0, 10) t(m))", *ridge_sql("bw", "m", "w")]


@query("bagged_ridge", "L18b", sql=with_(LI, *BAG) + f"SELECT rid, round({_FIT}, 4) AS y_pred FROM li JOIN co USING (month)")
def _(spark, sf):
    out = R.bagged_ridge(lines(spark, sf), [], "month", "rid", RF, "target", reg=1.0)
    return out.select("rid", F.round("y_pred", 4).alias("y_pred"))


BAGU = uniform_sql("(CAST(doc_id AS VARCHAR) || '-' || CAST(bag AS VARCHAR))", "'42:bag'")
UNDER = DOC + f""", lab AS (SELECT doc_id, lang, 1 - quality AS y, n_chars FROM doc WHERE quality IS NOT NULL),
 c AS (SELECT lang, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM lab GROUP BY lang),
 t AS (SELECT lang, CASE WHEN q > p THEN 0 ELSE 1 END AS cut, least(p, q) AS keep, greatest(CAST(ceil(greatest(p, q) / least(p, q)::DOUBLE) AS INT), 5) AS nb FROM c WHERE p > 0 AND q > 0),
 t2 AS (SELECT *, nb + CASE WHEN nb % 2 = 0 THEN 1 ELSE 0 END AS bags FROM t),
 sp AS (SELECT lab.*, t2.cut, t2.keep, CAST(unnest(range(0, bags)) AS INT) AS bag FROM lab JOIN t2 USING (lang)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY lang, bag, y ORDER BY {BAGU}, doc_id) AS r FROM sp)"""


@query("underbag", "L14", sql=with_(UNDER) + "SELECT lang, doc_id, bag, y FROM rk WHERE y <> cut OR r <= keep")
def _(spark, sf):
    d = documents(spark, sf).filter(F.col("quality").isNotNull()).withColumn("y", 1 - F.col("quality"))
    return RS.underbag(d, ["lang"], "y", "doc_id", bags=5, auto=True).select("lang", "doc_id", "bag", "y")


SM = f"""x AS (SELECT seq AS id, (seq - 1) // 100 AS block, y, [CAST(hr AS DOUBLE), CAST(k AS DOUBLE)] AS f, hr, k FROM ev),
 s AS (SELECT block, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM x GROUP BY block),
 nd AS (SELECT block, CASE WHEN a < b THEN 1 ELSE 0 END AS minor, abs(a - b) AS need FROM s WHERE a <> b AND least(a, b) > 0),
 mi AS (SELECT x.*, nd.minor FROM x JOIN nd USING (block) WHERE y = minor),
 rf AS (SELECT m.block, m.id, sqrt((m.hr - r.hr) * (m.hr - r.hr) + (m.k - r.k) * (m.k - r.k)) AS d, row_number() OVER (PARTITION BY m.id ORDER BY (m.hr - r.hr) * (m.hr - r.hr) + (m.k - r.k) * (m.k - r.k), r.id) AS rn FROM mi m JOIN x r ON r.block = m.block - 1 AND r.y = m.minor),
 aim AS (SELECT block, id, avg(d) AS aim FROM rf WHERE rn <= 5 GROUP BY ALL),
 nn AS (SELECT m.block, m.id, n.id AS nb, n.y AS ny, m.minor, sqrt((m.hr - n.hr) * (m.hr - n.hr) + (m.k - n.k) * (m.k - n.k)) AS d, row_number() OVER (PARTITION BY m.id ORDER BY (m.hr - n.hr) * (m.hr - n.hr) + (m.k - n.k) * (m.k - n.k), n.id) AS rn FROM mi m JOIN x n ON n.block = m.block AND n.id <> m.id),
 sm AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS kk, avg(d) OVER (PARTITION BY id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS mean FROM nn WHERE rn <= 7 AND ny = minor),
 bk AS (SELECT id, arg_min(kk, abs(mean / aim - 1) * 1000000 + kk * 1e-6) AS best FROM sm JOIN aim USING (id) WHERE aim > 0 AND abs(mean / aim - 1) < 1 GROUP BY id),
 pr AS (SELECT block, id, nb FROM sm JOIN bk USING (id) WHERE kk <= best UNION ALL SELECT aim.block, aim.id, aim.id FROM aim WHERE id NOT IN (SELECT id FROM bk)),
 pl AS (SELECT block, id, nb, row_number() OVER (PARTITION BY block ORDER BY id, nb) - 1 AS pos, count(*) OVER (PARTITION BY block) AS np FROM pr),
 dr AS (SELECT block, minor, unnest(range(1, need + 1)) AS draw FROM nd),
 du AS (SELECT *, {uniform_sql("(CAST(block AS VARCHAR) || '-' || CAST(draw AS VARCHAR))", "'42:step'")} AS st, {uniform_sql("(CAST(block AS VARCHAR) || '-' || CAST(draw AS VARCHAR))", "'42:pair'")} AS pu FROM dr)"""


@query("adaptive_smote", "L12", sql=with_(EV, SM) + """SELECT du.block, du.draw, CAST(du.minor AS INT) AS y, [round(a.hr + st * (b.hr - a.hr), 6), round(a.k + st * (b.k - a.k), 6)] AS features
  FROM du JOIN pl ON pl.block = du.block AND pl.pos = CAST(floor(pu * np) AS BIGINT) JOIN x a ON a.id = pl.id JOIN x b ON b.id = pl.nb""")
def _(spark, sf):
    e = events(spark, sf).withColumn("block", F.expr("(seq - 1) div 100"))
    out = RS.adaptive_smote(e, "block", "y", "seq", ["hr", "k"])
    return out.withColumn("features", F.transform("features", lambda v: F.round(v, 6)))


def _pois(lam, salt):
    return f"CAST(len(list_filter([{', '.join(repr(p) for p in poisson_cdf(lam, 1e-10))}], lambda p: p <= {uniform_sql('event_id', salt)})) AS INT)"


@query("online_bagging_weights", "L9", sql=with_(EV) + f"""SELECT event_id, CAST(m AS INT) AS member, {_pois(6.0, "'42:bag' || CAST(m AS VARCHAR)")} AS leveraging, {_pois(1.0, "'42:bag' || CAST(m AS VARCHAR)")} AS online FROM ev, range(0, 3) t(m)""")
def _(spark, sf):
    e = events(spark, sf).select("event_id")
    a = RS.online_bagging_weights(e, "event_id", 3, "leveraging").select("event_id", "member", F.col("weight").alias("leveraging"))
    b = RS.online_bagging_weights(e, "event_id", 3, "online").select("event_id", "member", F.col("weight").alias("online"))
    return a.join(b, ["event_id", "member"])


@query("oversampling_rates", "L9", sql=with_(EV) + """SELECT event_id, round(CASE WHEN own = 0 THEN 1.0 ELSE greatest(a, b) / own END, 6) AS rate FROM (SELECT event_id, a, b, CASE WHEN y = 1 THEN b ELSE a END AS own FROM (
  SELECT event_id, y, coalesce(sum(1 - y) OVER w, 0) AS a, coalesce(sum(y) OVER w, 0) AS b FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "seq", "y")
    out = RS.online_bagging_weights(e, "event_id", 1, "oversampling", label="y", keys=["user_id"], order="seq")
    return out.select("event_id", F.round("rate", 6).alias("rate"))


RARE = """ra AS (SELECT event_id, seq, event_type, CAST(cents % 997 = 0 AS INT) AS y FROM ev),
 rc AS (SELECT *, coalesce(sum(1 - y) OVER w, 0) AS a, coalesce(sum(y) OVER w, 0) AS b FROM ra WINDOW w AS (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 rr AS (SELECT event_id, CASE WHEN (CASE WHEN y = 1 THEN b ELSE a END) = 0 THEN 1.0 ELSE greatest(a, b) / (CASE WHEN y = 1 THEN b ELSE a END) END AS rate FROM rc),
 ru AS (SELECT event_id, rate, """ + uniform_sql("event_id", "'42:bag0'") + """ AS u, greatest(0, CAST(floor(rate - 12 * sqrt(rate) - 30) AS BIGINT)) AS lo, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) AS hi FROM rr),
 rk AS (SELECT event_id, rate, u, lo, unnest(range(lo, hi + 1)) AS k FROM ru),
 rp AS (SELECT *, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY event_id ORDER BY k) AS cdf FROM rk)"""


@query("oversampling_weights", "L9", sql=with_(EV, RARE) + "SELECT event_id, round(rate, 6) AS rate, CAST(min(lo) + count(*) FILTER (cdf <= u) AS INT) AS weight FROM rp GROUP BY event_id, rate")
def _(spark, sf):
    """A class of about one row in a thousand, so that rates go beyond a hundred."""
    e = events(spark, sf).select("event_id", "event_type", "seq", (F.col("cents") % 997 == 0).cast("int").alias("y"))
    out = RS.online_bagging_weights(e, "event_id", 1, "oversampling", label="y", keys=["event_type"], order="seq")
    return out.select("event_id", F.round("rate", 6).alias("rate"), "weight")
