"""Label-query rules over scored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.arrays import range_margin, top2_margin
from tidemark.functions.hashing import hash_uniform
from tidemark.operators import select as Q
from tidemark.queries import query
from tidemark.queries.base import EV, SCORED, events, fold_sql, recursive, scored, uniform_sql, with_

HALF = "list_max(proba) - list_min(proba)"


@query("query_random", "Q1", sql=with_(EV) + f"SELECT event_id, {uniform_sql('event_id', repr('42:query'))} < 0.2 AS is_queried FROM ev")
def _(spark, sf):
    return Q.query_random(events(spark, sf), "event_id", 0.2).select("event_id", "is_queried")


@query("query_margin_fixed", "Q2", sql=with_(EV, SCORED) + f"SELECT event_id, {HALF} < 0.3 AS is_queried FROM scored")
def _(spark, sf):
    return Q.query_margin_fixed(scored(spark, sf), "proba", 0.3).select("event_id", "is_queried")


@query("query_margin_variable", "Q3", sql=recursive(EV, SCORED, fold_sql(
  source=f"SELECT user_id, seq, {HALF} AS m FROM scored", key="user_id", order="seq", cols=["m"], state={"theta": "CAST(0.47 AS DOUBLE)", "used": "CAST(0 AS DOUBLE)", "ask": "false"},
  steps=[{"ask": "m < theta", "used": "theta"}, {"theta": "CASE WHEN ask THEN theta * (1 - 0.01::DOUBLE) ELSE theta * (1 + 0.01::DOUBLE) END"}])) +
  "SELECT user_id, seq, ask AS is_queried, round(used, 6) AS threshold FROM f WHERE rn > 0")
def _(spark, sf):
    out = Q.query_keyed(scored(spark, sf), ["user_id"], "seq", Q.MarginVariable(0.47), {"margin": range_margin(F.col("proba"))})
    return out.withColumn("threshold", F.round("threshold", 6))


@query("query_margin_or_random", "Q4", sql=recursive(EV, SCORED, fold_sql(
  source=f"SELECT user_id, seq, list_reverse_sort(proba)[1] - list_reverse_sort(proba)[2] AS m, {uniform_sql('event_id', repr('draw'))} AS d FROM scored", key="user_id", order="seq", cols=["m", "d"],
  state={"theta": "2 * 0.4::DOUBLE / 3", "used": "CAST(0 AS DOUBLE)", "ask": "false"},
  steps=[{"sure": "m <= theta", "used": "theta"}, {"ask": "sure OR d <= 0.05", "theta": "CASE WHEN rn % 30 = 0 THEN 2 * 0.4::DOUBLE / 3 WHEN sure THEN theta * (1 - 0.01::DOUBLE) ELSE theta END"}])) +
  "SELECT user_id, seq, ask AS is_queried, round(used, 6) AS threshold FROM f WHERE rn > 0")
def _(spark, sf):
    rule = Q.MarginOrRandom(0.4, 3, 0.01, 0.05, period=30)
    out = Q.query_keyed(scored(spark, sf), ["user_id"], "seq", rule, {"margin": top2_margin(F.col("proba")), "draw": hash_uniform(F.col("event_id"), "draw")})
    return out.withColumn("threshold", F.round("threshold", 6))


MEM = "m AS (SELECT CAST(k % 10 AS INT) AS member, CAST(k % 3 AS INT) AS class, count(*) AS h, 1.0 / (1 + k % 10) AS w FROM ev GROUP BY ALL)"
SHARE = "d AS (SELECT class, sum(h * w) / (SELECT sum(h * w) FROM m) AS share FROM m GROUP BY class)"
RATE = "r AS (SELECT class, share, CASE WHEN share = 0 THEN 1.0 ELSE greatest(0.05 / (share * 3), 0.05) END AS rate FROM d)"


def member_counts(spark, sf):
    e = events(spark, sf)
    g = e.groupBy((F.col("k") % 10).cast("int").alias("member"), (F.col("k") % 3).cast("int").alias("class")).agg(F.count("*").alias("h"))
    return g.withColumn("w", 1.0 / (1 + F.col("member")))


@query("class_shares", "G14", sql=with_(EV, MEM, SHARE, RATE) + "SELECT class, round(share, 6) AS share, round(rate, 6) AS rate FROM r")
def _(spark, sf):
    return Q.class_shares(member_counts(spark, sf), 0.05, 3).select("class", F.round("share", 6).alias("share"), F.round("rate", 6).alias("rate"))


@query("query_imbalance", "Q5", sql=with_(EV, SCORED, MEM, SHARE, RATE) + f"""SELECT event_id, {uniform_sql('event_id', repr('42:imbalance'))} < rate AS is_queried
  FROM scored JOIN r ON r.class = list_position(proba, list_max(proba)) - 1""")
def _(spark, sf):
    rates = Q.class_shares(member_counts(spark, sf), 0.05, 3)
    return Q.query_imbalance(scored(spark, sf), rates, "proba", "event_id").select("event_id", "is_queried")


@query("query_cognitive", "Q6", "J8")
def _(spark, sf):
    s = scored(spark, sf)
    feats = F.array(*[(F.col(c) / F.lit(w)).cast("double") for c, w in (("cents", 10000.0), ("hr", 24.0), ("k", 100.0))])
    return Q.query_keyed(s, ["user_id"], "seq", Q.Cognitive(budget=0.25), {"features": feats, "top": F.array_max("proba")}).withColumn("spend", F.round("spend", 6))


MM = "list_transform(proba, lambda x: (x - list_min(proba)) / (list_max(proba) - list_min(proba) + 1e-10))"


@query("query_submodular", "Q7", sql=recursive(EV, SCORED, fold_sql(
  source=f"SELECT user_id, seq, label, q[1] / (q[1] + q[2] + q[3]) AS a, q[2] / (q[1] + q[2] + q[3]) AS b, q[3] / (q[1] + q[2] + q[3]) AS c FROM (SELECT *, {MM} AS q FROM scored)",
  key="user_id", order="seq", cols=["label", "a", "b", "c"], state={"n0": "0", "n1": "0", "n2": "0", "gain": "CAST(0 AS DOUBLE)", "ask": "false"},
  steps=[{"gain": "0.0::DOUBLE + a * (pow(n0 + 1, 0.5) - pow(n0, 0.5)) + b * (pow(n1 + 1, 0.5) - pow(n1, 0.5)) + c * (pow(n2 + 1, 0.5) - pow(n2, 0.5))"}, {"ask": "gain > 0.2"},
         {"n0": "n0 + CAST(ask AND label = 0 AS INT)", "n1": "n1 + CAST(ask AND label = 1 AS INT)", "n2": "n2 + CAST(ask AND label = 2 AS INT)"}])) +
  "SELECT user_id, seq, ask AS is_queried, round(gain, 6) AS threshold FROM f WHERE rn > 0")
def _(spark, sf):
    out = Q.query_keyed(scored(spark, sf), ["user_id"], "seq", Q.Submodular(3, 2.0, 0.2), {"proba": F.col("proba")})
    return out.withColumn("threshold", F.round("threshold", 6))


def dynamic_fold() -> str:
    """Counts, gamma, own thresholds and quiet length, one row at a time."""
    q = ["a", "b", "c"]
    pick = lambda names: "CASE label WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END".format(*names)
    kl = lambda i: f"(CASE WHEN {q[i]} > 0 THEN {q[i]} * ln({q[i]} / (({q[i]} + CAST(label = {i} AS INT)) / 2)) ELSE 0 END)"
    own = pick([f"ln(1 / ((1 + {x}) / 2))" for x in q])
    return fold_sql(
        source=f"SELECT user_id, seq, label, q[1] / (q[1] + q[2] + q[3]) AS a, q[2] / (q[1] + q[2] + q[3]) AS b, q[3] / (q[1] + q[2] + q[3]) AS c FROM (SELECT *, {MM} AS q FROM scored)",
        key="user_id", order="seq", cols=["label", *q],
        state={**{f"n{i}": "0" for i in range(3)}, **{f"o{i}": "0.3::DOUBLE" for i in range(3)}, "g": "0.3::DOUBLE", "skipped": "0", "used": "CAST(0 AS DOUBLE)", "ask": "false", "refit": "false"},
        steps=[
            {"used": "g", "forced": "skipped = 20", "gain": " + ".join(f"{q[i]} * (pow(n{i} + 1, 0.5) - pow(n{i}, 0.5))" for i in range(3))},
            {"ask": "forced OR gain > g"},
            {f"n{i}": f"n{i} + CAST(ask AND label = {i} AS INT)" for i in range(3)},
            {"fall": f"0.1::DOUBLE / 2 * pow({pick(['n0', 'n1', 'n2'])} + 1, -0.5)", "apart": f"0.5 * ({own}) + 0.5 * ({kl(0)} + {kl(1)} + {kl(2)})"},
            {"g": "CASE WHEN ask AND apart > 0.1 THEN greatest(g - fall, 0.15::DOUBLE) ELSE g END",
             **{f"o{i}": f"CASE WHEN ask AND label = {i} THEN greatest(o{i} - fall, 0.15::DOUBLE) ELSE o{i} END" for i in range(3)}},
            {"refit": "ask AND forced"},
            {"g": f"CASE WHEN refit THEN (CASE WHEN g > 0.15::DOUBLE THEN (1 - apart / 2) * {pick(['o0', 'o1', 'o2'])} ELSE 0.15::DOUBLE END) ELSE g END",
             **{f"n{i}": f"CASE WHEN refit THEN 0 ELSE n{i} END" for i in range(3)},
             "skipped": "CASE WHEN ask THEN 0 ELSE skipped + 1 END"},
            {f"o{i}": f"CASE WHEN refit THEN 0.4::DOUBLE ELSE o{i} END" for i in range(3)},
        ])


@query("query_submodular_dynamic", "Q8", sql=recursive(EV, SCORED, dynamic_fold()) +
       "SELECT user_id, seq, ask AS is_queried, round(used, 6) AS threshold, refit AS is_refit FROM f WHERE rn > 0")
def _(spark, sf):
    out = Q.query_keyed(scored(spark, sf), ["user_id"], "seq", Q.SubmodularDynamic(3, 2.0, 0.3), {"proba": F.col("proba")})
    return out.withColumn("threshold", F.round("threshold", 6))


@query("label_budget", "Q10", sql=recursive(EV, fold_sql(
  source="SELECT user_id, seq, CAST(k < 40 AS INT) AS w FROM ev", key="user_id", order="seq", cols=["w"], state={"seen": "0", "asked": "0", "spend": "CAST(0 AS DOUBLE)", "ask": "false"},
  steps=[{"spend": "CASE WHEN seen = 0 THEN 0.0::DOUBLE ELSE CAST(asked AS DOUBLE) / seen END"}, {"ask": "w = 1 AND spend <= 0.2::DOUBLE"}, {"seen": "seen + 1", "asked": "asked + CAST(ask AS INT)"}])) +
  "SELECT user_id, seq, ask AS is_queried, round(spend, 6) AS threshold FROM f WHERE rn > 0")
def _(spark, sf):
    out = Q.query_keyed(events(spark, sf), ["user_id"], "seq", Q.Budget(0.2), {"wanted": F.col("k") < 40})
    return out.withColumn("threshold", F.round("threshold", 6))


@query("query_topk_per_chunk", "T1", sql=with_(EV, SCORED) + f"SELECT event_id, (seq - 1) // 100 AS chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY (seq - 1) // 100 ORDER BY {HALF}, seq) AS rank FROM scored) WHERE rank <= 10")
def _(spark, sf):
    s = scored(spark, sf).withColumn("chunk_id", F.expr("(seq - 1) div 100")).withColumn("score", range_margin(F.col("proba")))
    return Q.query_topk_per_chunk(s, ["chunk_id"], "score", "seq", 10).select("event_id", "chunk_id", "rank")


@query("recent_per_class", "T5", sql=with_(EV, SCORED) + "SELECT user_id, label, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY seq DESC) AS age FROM scored) WHERE age <= 5")
def _(spark, sf):
    return Q.recent_per_class(scored(spark, sf), ["user_id"], "label", "seq", 5).select("user_id", "label", "event_id", "age")


@query("replay_union", "U3", sql=with_(EV, SCORED, "buf AS (SELECT user_id, event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY seq DESC) AS age FROM scored) WHERE age <= 5)",
  "smp AS (SELECT user_id, event_id, label FROM scored WHERE k < 20)") + "SELECT * FROM smp UNION SELECT * FROM buf")
def _(spark, sf):
    s = scored(spark, sf)
    buf = Q.recent_per_class(s, ["user_id"], "label", "seq", 5).select("user_id", "event_id", "label")
    return Q.replay_union(s.filter(F.col("k") < 20).select("user_id", "event_id", "label"), buf, ["event_id"])


@query("already_labelled", "J6", sql=with_(EV) + "SELECT status, count(*) AS n, sum(event_id) AS ids FROM (SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM ev WHERE y = 1) THEN 'known' ELSE 'new' END AS status FROM ev WHERE k < 50) GROUP BY status")
def _(spark, sf):
    e = events(spark, sf)
    known, new = Q.already_labelled(e.filter(F.col("k") < 50), e.filter(F.col("y") == 1), ["event_id"])
    both = known.withColumn("status", F.lit("known")).unionByName(new.withColumn("status", F.lit("new")))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("weakest_member", "T4", sql=with_(EV) + """SELECT user_id, arg_min(member, weight * 100 + member) AS member, min(weight) AS weight FROM (SELECT user_id, k % 10 AS member, count(*) AS weight FROM ev GROUP BY ALL) GROUP BY user_id""")
def _(spark, sf):
    m = events(spark, sf).groupBy("user_id", (F.col("k") % 10).alias("member")).agg(F.count("*").alias("weight"))
    return Q.weakest_member(m, ["user_id"])


@query("newest_members", "T4", sql=with_(EV) + """SELECT user_id, member FROM (SELECT user_id, k % 10 AS member, row_number() OVER (PARTITION BY user_id ORDER BY max(seq) DESC) AS r FROM ev GROUP BY user_id, k % 10) WHERE r <= 3""")
def _(spark, sf):
    m = events(spark, sf).groupBy("user_id", (F.col("k") % 10).alias("member")).agg(F.max("seq").alias("age"))
    return Q.newest_members(m, ["user_id"], "age", 3).select("user_id", "member")
