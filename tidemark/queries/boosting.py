"""Dynamic weighted majority and cost-sensitive boosting over trained members."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.queries import query
from tidemark.queries.base import EV, events, recursive, with_
from tidemark.queries.metrics import nb_score_sql, nb_stats_sql

F2 = ["cents", "k"]
REACH, MEMBERS = 4, 3
AGES = range(1, REACH + 1)


def chunked(spark, sf):
    return events(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 500"))


def _list(text: str) -> str:
    return "[" + ", ".join(text.format(a=a) for a in AGES) + "]"


def _vote(c: int) -> str:
    return "round(" + " + ".join(f"CASE WHEN p{a} = {c} THEN w[{a}] ELSE 0 END" for a in AGES) + ", 12)"


_NB = nb_stats_sql(F2, [0, 1], "y", "()").replace(" OVER ()", "")
_SUMS = ", ".join(f"coalesce(sum({n}), 0) AS {n}" for c in (0, 1) for n in [f"n{c}", *[f"{k}{c}_{j}" for j in range(2) for k in "sq"]])
MAJORITY = [
    EV, "ch AS (SELECT event_id, (seq - 1) // 500 AS t, cents, k, y_sudden AS y FROM ev)",
    f"st AS (SELECT t, {_NB} FROM ch GROUP BY t)",
    f"md AS (SELECT x.t, age, {_SUMS} FROM (SELECT t, unnest(range(1, {REACH + 1})) AS age FROM st) x JOIN st ON st.t BETWEEN x.t - age AND x.t - 1 WHERE x.t >= age GROUP BY x.t, age)",
    f"sc AS ({nb_score_sql('(SELECT ch.*, md.* EXCLUDE (t) FROM ch JOIN md ON md.t = ch.t)', F2, [0, 1])})",
    "pv AS (SELECT ch.event_id, ch.t, ch.y, " + ", ".join(f"coalesce(max(CASE WHEN sc.age = {a} THEN sc.y_pred END), 0) AS p{a}" for a in AGES)
    + " FROM ch LEFT JOIN sc ON sc.event_id = ch.event_id GROUP BY ch.event_id, ch.t, ch.y)",
    # weights by age in force at chunk t; the weakest of more than MEMBERS leaves, the older of two
    f"""fo AS (SELECT CAST(0 AS BIGINT) AS t, {_list("CAST(0 AS DOUBLE)")} AS w
  UNION ALL SELECT t + 1, CASE WHEN len(list_filter(g, lambda x: x > 0)) > {MEMBERS}
      THEN list_transform(range(1, {REACH + 1}), lambda i: CASE WHEN i = list_max(list_filter(range(1, {REACH + 1}), lambda j: round(g[j], 12) = round(list_min(list_filter(g, lambda x: x > 0)), 12))) THEN 0 ELSE g[i] END) ELSE g END
    FROM (SELECT t, [CASE WHEN wrong > 0.25 OR list_max(b) = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END] || b[1:{REACH - 1}] AS g
      FROM (SELECT t, wrong, list_transform(r, lambda x: CASE WHEN list_max(r) > 0 AND x / list_max(r) >= 0.01 THEN x / list_max(r) ELSE 0 END) AS b
        FROM (SELECT fo.t, avg(CAST(y <> CASE WHEN {_vote(1)} > {_vote(0)} THEN 1 ELSE 0 END AS INT)) AS wrong,
            [{", ".join(f"any_value(w)[{a}] * pow(0.5::DOUBLE, avg(CAST(y <> p{a} AS INT)))" for a in AGES)}] AS r
          FROM fo JOIN pv ON pv.t = fo.t GROUP BY fo.t) a) b) c)""",
]


@query("dynamic_majority", "L10", sql=recursive(*MAJORITY) + f"SELECT event_id, CASE WHEN {_vote(1)} > {_vote(0)} THEN 1 ELSE 0 END AS y_pred FROM pv JOIN fo ON fo.t = pv.t")
def _(spark, sf):
    rows, _life = B.dynamic_majority(chunked(spark, sf), [], "chunk_id", F2, "y_sudden", [0, 1], members=MEMBERS, reach=REACH)
    return rows.select("event_id", "y_pred")


@query("member_lifecycle", "L10", sql=recursive(*MAJORITY) + f"""SELECT * FROM (SELECT t AS chunk_id, t - a AS member, round(w[a], 6) AS weight FROM fo, range(1, {REACH + 1}) x(a)) z
  WHERE weight > 0 AND chunk_id <= (SELECT max(t) FROM ch)""")
def _(spark, sf):
    _rows, life = B.dynamic_majority(chunked(spark, sf), [], "chunk_id", F2, "y_sudden", [0, 1], members=MEMBERS, reach=REACH)
    return life.withColumn("weight", F.round("weight", 6))


BEFORE = "(ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ROUNDS, COSTS = 3, {0: 0.4, 1: 1.0}
_COST = "CASE y WHEN 0 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END"


def boost_sql() -> list[str]:
    parts = [EV, f"b0 AS (SELECT *, {_COST} AS w FROM (SELECT event_id, (seq - 1) // 500 AS t, cents, k, y_sudden AS y FROM ev) z)"]
    for m in range(ROUNDS):
        kept = ", ".join(x for i in range(m) for x in (f"p{i}", f"al{i}"))
        stat = nb_stats_sql(F2, [0, 1], "y", BEFORE, "w")
        parts.append(f"s{m} AS (SELECT *, {stat} FROM b{m})")
        parts.append(f"c{m} AS ({nb_score_sql(f's{m}', F2, [0, 1], pred=f'p{m}')})")
        parts.append(f"j{m} AS (SELECT event_id, t, cents, k, y, w, {kept + ', ' if m else ''}p{m}, n0 + n1 > 0 AS kn FROM c{m})")
        parts.append(f"""h{m} AS (SELECT *, coalesce(sum(CASE WHEN kn AND p{m} = y THEN w * {_COST} ELSE 0 END) OVER {BEFORE}, 0) AS r,
    coalesce(sum(CASE WHEN kn AND p{m} <> y THEN w * {_COST} ELSE 0 END) OVER {BEFORE}, 0) AS f FROM j{m})""")
        parts.append(f"""b{m + 1} AS (SELECT event_id, t, cents, k, y, {kept + ', ' if m else ''}p{m},
    CASE WHEN NOT kn THEN 0 WHEN r + f > 0 THEN 0.5 * ln(greatest(r, 1e-10) / greatest(f, 1e-10)) ELSE 1.0 END AS al{m},
    CASE WHEN kn THEN w * {_COST} * CASE WHEN r > 0 AND f > 0 THEN (r + f) / (2 * CASE WHEN p{m} = y THEN r ELSE f END) ELSE 1.0 END ELSE w END AS w FROM h{m})""")
    return parts


def _boosted(c: int) -> str:
    return "round(" + " + ".join(f"CASE WHEN p{m} = {c} THEN al{m} ELSE 0 END" for m in range(ROUNDS)) + ", 12)"


@query("cost_boost", "L10", sql=with_(*boost_sql()) + f"SELECT event_id, CASE WHEN {_boosted(1)} > {_boosted(0)} THEN 1 ELSE 0 END AS y_pred FROM b{ROUNDS}")
def _(spark, sf):
    return B.cost_boost(chunked(spark, sf), [], "chunk_id", F2, "y_sudden", [0, 1], members=ROUNDS, costs=[COSTS[0], COSTS[1]]).select("event_id", "y_pred")
