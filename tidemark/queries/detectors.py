"""Drift detector queries; oracles are recursive SQL folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import detect as D
from tidemark.queries import query
from tidemark.queries.base import EV, events, fold_sql, recursive, with_

INF = "CAST('inf' AS DOUBLE)"


def ddm_fold(source: str, key: str, reset: str = "chg", tag: str = "") -> str:
    keep = lambda name, first: f"CASE WHEN {reset} THEN {first} ELSE {name} END"
    return fold_sql(
        source=source, key=key, order="seq", cols=["x"], tag=tag,
        state={"n": "0", "e": "0", "low": INF, "lp": INF, "ls": INF, "p": "CAST(0 AS DOUBLE)", "chg": "false", "wrn": "false"},
        steps=[
            {"n": f"({keep('n', 0)}) + 1", "e": f"({keep('e', 0)}) + x", "low": keep("low", INF), "lp": keep("lp", INF), "ls": keep("ls", INF)},
            {"p": "CAST(e AS DOUBLE) / n"},
            {"s": "sqrt(p * (1 - p) / n)"},
            {"newlow": "n + 1 >= 30 AND p + s <= low"},
            {"low": "CASE WHEN newlow THEN p + s ELSE low END", "lp": "CASE WHEN newlow THEN p ELSE lp END", "ls": "CASE WHEN newlow THEN s ELSE ls END"},
            {"chg": "n + 1 >= 30 AND p + s > lp + 3 * ls"},
            {"wrn": "n + 1 >= 30 AND NOT chg AND p + s > lp + 2 * ls"},
        ])


def eddm_fold(source: str, key: str, tag: str = "") -> str:
    keep = lambda name, first: f"CASE WHEN chg THEN {first} ELSE {name} END"
    zero = "CAST(0 AS DOUBLE)"
    return fold_sql(
        source=source, key=key, order="seq", cols=["x"], tag=tag,
        state={"n": "0", "errs": "0", "lst": "0", "mean": zero, "spread": zero, "top": zero, "wrn": "false", "chg": "false"},
        steps=[
            {"n": f"({keep('n', 0)}) + 1", "errs": keep("errs", 0), "lst": keep("lst", 0), "mean": keep("mean", zero), "spread": keep("spread", zero),
             "top": keep("top", zero), "wrn": keep("wrn", "false")},
            {"errs": "errs + x", "gap": "CAST(n - lst AS DOUBLE)"},
            {"m2": "mean + (gap - mean) / greatest(errs, 1)"},
            {"s2": "spread + (gap - m2) * (gap - mean)"},
            {"level": "m2 + 2 * sqrt(greatest(s2, 0) / greatest(errs, 1))"},
            {"act": "x = 1 AND n + 1 >= 30", "up": "level > top"},
            {"chg": "act AND NOT up AND errs > 30 AND level / top < 0.9",
             "wrn": "CASE WHEN x = 1 THEN act AND NOT up AND errs > 30 AND level / top >= 0.9 AND level / top < 0.95 ELSE wrn END",
             "top": "CASE WHEN act AND up THEN level ELSE top END", "lst": "CASE WHEN x = 1 THEN n ELSE lst END",
             "mean": "CASE WHEN x = 1 THEN m2 ELSE mean END", "spread": "CASE WHEN x = 1 THEN s2 ELSE spread END"},
        ])


def ph_fold(source: str, key: str, tag: str = "", threshold: float = 50.0) -> str:
    return fold_sql(
        source=source, key=key, order="seq", cols=["x"], tag=tag,
        state={"n": "0", "total": "CAST(0 AS DOUBLE)", "up": "CAST(0 AS DOUBLE)", "mean": "CAST(0 AS DOUBLE)", "chg": "false"},
        steps=[
            {"n": "CASE WHEN chg THEN 1 ELSE n + 1 END", "total": "CASE WHEN chg THEN x ELSE total + x END", "up": "CASE WHEN chg THEN 0 ELSE up END"},
            {"mean": "total / n"},
            {"up": "greatest(CAST(0 AS DOUBLE), 0.9999::DOUBLE * up + (x - mean - 0.005::DOUBLE))"},
            {"chg": f"n + 1 >= 30 AND up > {threshold}"},
        ])


ERR = "SELECT user_id, seq, y AS x FROM ev"
DENSE = "SELECT user_id, seq, CAST(k < 60 AS INT) AS x FROM ev"
VALUE = "SELECT user_id, seq, CAST(k AS DOUBLE) AS x FROM ev"
KIND = "CASE WHEN chg THEN 'change' ELSE 'warning' END AS kind"


@query("detect_ddm", "D1", sql=recursive(EV, ddm_fold(ERR, "user_id")) + f"SELECT user_id, seq, {KIND}, round(p, 6) AS estimation FROM f WHERE rn > 0 AND (chg OR wrn)")
def _(spark, sf):
    return D.detect(events(spark, sf), ["user_id"], "seq", F.col("y"), D.Ddm()).withColumn("estimation", F.round("estimation", 6))


@query("detect_ddm_warning_reset", "D1", sql=recursive(EV, ddm_fold(ERR, "user_id", reset="wrn")) + f"SELECT user_id, seq, {KIND}, round(p, 6) AS estimation FROM f WHERE rn > 0 AND (chg OR wrn)")
def _(spark, sf):
    return D.detect(events(spark, sf), ["user_id"], "seq", F.col("y"), D.Ddm(reset_on="warning")).withColumn("estimation", F.round("estimation", 6))


@query("detect_ddm_sliced", "D1", sql=recursive(EV, ddm_fold(ERR, "user_id")) + f"SELECT user_id, seq, {KIND}, round(p, 6) AS estimation FROM f WHERE rn > 0 AND (chg OR wrn)")
def _(spark, sf):
    """The same detector over errors that arrive in other partitions: the shuffle alone decides the order."""
    e = events(spark, sf).repartition(16, "seq")
    out = D.detect(e, ["user_id"], "seq", F.col("y"), D.Ddm())
    return out.withColumn("estimation", F.round("estimation", 6))


@query("ddm_first_alarm", "D1b", sql=with_(EV, """a AS (SELECT user_id, seq, count(*) OVER w AS n, sum(y) OVER w AS e FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq))""",
  "b AS (SELECT *, CAST(e AS DOUBLE) / n AS p, sqrt(CAST(e AS DOUBLE) / n * (1 - CAST(e AS DOUBLE) / n) / n) AS s FROM a)",
  "c AS (SELECT *, min(CASE WHEN n + 1 >= 30 THEN {'l': p + s, 'n': -n, 'p': p, 's': s} END) OVER (PARTITION BY user_id ORDER BY seq) AS m FROM b)") +
  "SELECT user_id, min(seq) FILTER (n + 1 >= 30 AND p + s > m.p + 2 * m.s) AS first_warning, min(seq) FILTER (n + 1 >= 30 AND p + s > m.p + 3 * m.s) AS first_change FROM c GROUP BY user_id")
def _(spark, sf):
    return D.ddm_first_alarm(events(spark, sf), ["user_id"], "seq", "y")


@query("detect_eddm", "D2", sql=recursive(EV, eddm_fold(DENSE, "user_id")) + f"SELECT user_id, seq, {KIND}, round(mean, 6) AS estimation FROM f WHERE rn > 0 AND (chg OR wrn)")
def _(spark, sf):
    return D.detect(events(spark, sf), ["user_id"], "seq", (F.col("k") < 60).cast("int"), D.Eddm()).withColumn("estimation", F.round("estimation", 6))


@query("detect_page_hinkley", "D3", sql=recursive(EV, ph_fold(VALUE, "user_id")) + "SELECT user_id, seq, 'change' AS kind, round(mean, 6) AS estimation FROM f WHERE rn > 0 AND chg")
def _(spark, sf):
    return D.detect(events(spark, sf), ["user_id"], "seq", F.col("k"), D.PageHinkley()).withColumn("estimation", F.round("estimation", 6))


@query("detect_kswin", "D4")
def _(spark, sf):
    shifted = F.col("k") + F.when(F.col("dow") > 4, 40).otherwise(0)
    return D.detect(events(spark, sf), ["user_id"], "seq", shifted, D.Kswin(window=40, stat=15))


@query("detect_adwin", "D5", "L7")
def _(spark, sf):
    return D.detect(events(spark, sf), ["user_id"], "seq", F.col("y_sudden"), D.Adwin(change=0.05, warning=0.2, clock=4)).withColumn("estimation", F.round("estimation", 6))


@query("detector_suite", "D5", sql=recursive(EV, ddm_fold(DENSE, "user_id", tag="a"), eddm_fold(DENSE, "user_id", tag="b"), ph_fold(DENSE.replace("CAST(k < 60 AS INT)", "CAST(k < 60 AS INT)::DOUBLE"), "user_id", tag="c", threshold=5.0)) + """
  SELECT detector, kind, count(*) AS n FROM (SELECT 'ddm' AS detector, CASE WHEN chg THEN 'change' ELSE 'warning' END AS kind FROM fa WHERE rn > 0 AND (chg OR wrn)
   UNION ALL SELECT 'eddm', CASE WHEN chg THEN 'change' ELSE 'warning' END FROM fb WHERE rn > 0 AND (chg OR wrn) UNION ALL SELECT 'page_hinkley', 'change' FROM fc WHERE rn > 0 AND chg) GROUP BY ALL""")
def _(spark, sf):
    machines = {"ddm": D.Ddm(), "eddm": D.Eddm(), "page_hinkley": D.PageHinkley(threshold=5.0)}
    alarms = D.detector_suite(events(spark, sf), ["user_id"], "seq", (F.col("k") < 60).cast("int"), machines)
    return alarms.groupBy("detector", "kind").agg(F.count("*").alias("n"))


@query("fixed_chunks", "C1", sql=with_(EV, "b AS (SELECT (seq - 1) // 5 AS b, count(*) AS n, min(y) AS lo, max(y) AS hi FROM ev GROUP BY ALL)",
  "g AS (SELECT b, coalesce(sum(CAST(n = 5 AND lo <> hi AS BIGINT)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_id FROM b)") +
  "SELECT event_id, CAST(chunk_id AS BIGINT) AS chunk_id FROM ev JOIN g ON g.b = (seq - 1) // 5")
def _(spark, sf):
    return D.fixed_chunks(events(spark, sf), [], "y", 5).select("event_id", "chunk_id")


@query("minority_chunks", "C2", sql=recursive(EV, fold_sql(
  source="SELECT user_id, seq, y FROM ev", key="user_id", order="seq", cols=["y"], state={"z": "0", "o": "0", "id": "0", "done": "false"},
  steps=[{"z": "CASE WHEN done THEN 0 ELSE z END + 1 - y", "o": "CASE WHEN done THEN 0 ELSE o END + y", "id": "CASE WHEN done THEN id + 1 ELSE id END"}, {"done": "least(z, o) >= 5"}])) +
  "SELECT user_id, seq, CAST(id AS BIGINT) AS chunk_id, CAST(z + o AS BIGINT) AS n_rows FROM f WHERE rn > 0 AND done")
def _(spark, sf):
    return D.minority_chunks(events(spark, sf), ["user_id"], "seq", "y", 5)
