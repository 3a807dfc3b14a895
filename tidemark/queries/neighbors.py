"""Nearest-neighbour queries; oracles are brute-force joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import neighbors as N
from tidemark.queries import query
from tidemark.queries.base import EV, VEC, events, vectors, with_

# integer features keep distances exact on both sides
GRID = "g AS (SELECT vec_id AS id, vec_id // 100 AS block, label, list_transform(features, lambda x: round(x * 100)) AS x FROM vec)"
DIST = "list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def grid(spark, sf):
    v = vectors(spark, sf)
    return v.select(F.col("vec_id").alias("id"), F.expr("vec_id div 100").alias("block"), "label", "seq",
                    F.transform("features", lambda x: F.round(x * 100)).alias("features"))


@query("knn_join", "J1", "T6", sql=with_(VEC, GRID) + f"""SELECT block, id, neighbor, round(sqrt(d), 6) AS distance, CAST(r AS INT) AS rank FROM (
  SELECT a.block, a.id, b.id AS neighbor, {DIST} AS d, row_number() OVER (PARTITION BY a.block, a.id ORDER BY {DIST}, b.id) AS r FROM g a JOIN g b ON a.block = b.block AND b.label = 1) WHERE r <= 5""")
def _(spark, sf):
    g = grid(spark, sf)
    out = N.knn_join(g, g.filter(F.col("label") == 1), ["block"], 5, tile=32)
    return out.withColumn("distance", F.round("distance", 6))


@query("window_knn_mean", "J2", "L19", sql=with_(EV, """p AS (SELECT a.seq, b.k AS y, row_number() OVER (PARTITION BY a.seq ORDER BY (a.cents - b.cents) * (a.cents - b.cents) + (a.hr - b.hr) * (a.hr - b.hr), b.seq) AS r
  FROM ev a JOIN ev b ON b.seq BETWEEN a.seq - 300 AND a.seq - 1)""") + """SELECT ev.seq, k AS y_true, coalesce(m.y, 0) AS y_pred FROM ev LEFT JOIN (SELECT seq, CASE WHEN count(*) = 2 THEN avg(y) END AS y FROM p WHERE r <= 2 GROUP BY seq) m ON m.seq = ev.seq""")
def _(spark, sf):
    out = N.window_knn_regress(events(spark, sf), [], ["cents", "hr"], "k", k=2, window=300)
    return out.withColumnRenamed("k", "y_true")


@query("window_knn_median", "J2", "L19", sql=with_(EV, """u AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, cents, hr, k FROM ev)""", """p AS (SELECT a.user_id, a.pos, b.k AS y, row_number() OVER (PARTITION BY a.user_id, a.pos ORDER BY (a.cents - b.cents) * (a.cents - b.cents) + (a.hr - b.hr) * (a.hr - b.hr), b.pos) AS r
  FROM u a JOIN u b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 20 AND a.pos - 1)""") + """SELECT u.user_id, u.pos, k AS y_true, coalesce(m.y, 0) AS y_pred FROM u LEFT JOIN (SELECT user_id, pos, CASE WHEN count(*) = 3 THEN median(y) END AS y FROM p WHERE r <= 3 GROUP BY ALL) m ON m.user_id = u.user_id AND m.pos = u.pos""")
def _(spark, sf):
    from tidemark.plans.scan import with_seq

    u = with_seq(events(spark, sf).drop("seq"), ["user_id"], "event_id", name="pos")
    out = N.window_knn_regress(u, ["user_id"], ["cents", "hr"], "k", k=3, window=20, agg="median", seq="pos")
    return out.withColumnRenamed("k", "y_true")


@query("anchor_similarity", "J4", sql=with_(VEC, GRID, "an AS (SELECT id AS anchor, x FROM g WHERE id < 12)", f"""s AS (SELECT a.id, b.anchor, exp(-{DIST} / 50.0 / 100) AS w, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.anchor) AS r FROM g a, an b)""") +
  "SELECT id, CAST(anchor AS INT) AS anchor, round(w / (sum(w) OVER (PARTITION BY id) + 1e-10), 6) AS weight FROM s WHERE r <= 5")
def _(spark, sf):
    g = grid(spark, sf)
    anchors = [list(r["features"]) for r in g.filter(F.col("id") < 12).orderBy("id").select("features").collect()]
    out = N.anchor_similarity(g, "features", anchors, k=5, sigma=50.0)
    return out.select("id", F.explode("similarity").alias("s")).select("id", "s.anchor", F.round("s.weight", 6).alias("weight"))


EDGE = f"""nn AS (SELECT block, a_id, b_id FROM (SELECT a.block, a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS r FROM g a JOIN g b ON a.block = b.block AND a.id <> b.id) WHERE r <= 10),
 ed AS (SELECT block, a_id AS row, b_id AS col FROM nn UNION SELECT block, b_id, a_id FROM nn)"""


@query("graph_laplacian", "J5", sql=with_(VEC, GRID, EDGE) + "SELECT block, row, col, -1.0::DOUBLE AS value FROM ed UNION ALL SELECT block, row, row, count(*)::DOUBLE FROM ed GROUP BY block, row")
def _(spark, sf):
    return N.graph_laplacian(N.knn_graph(grid(spark, sf), ["block"], 10), ["block"])


@query("minority_pairs", "J9", sql=with_(VEC, GRID, f"nn AS (SELECT a.block, a.id, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS r FROM g a JOIN g b ON a.block = b.block AND a.id <> b.id AND a.label = 0 AND b.label = 0)") +
  "SELECT block, id, neighbor FROM nn WHERE r <= 3")
def _(spark, sf):
    small = grid(spark, sf).filter(F.col("label") == 0)
    near = N.knn_join(small, small, ["block"], 3, exclude_self=True).groupBy("block", "id").agg(F.collect_list("neighbor").alias("neighbors"))
    return N.minority_pairs(near, ["block"], "id")


@query("reverse_nn_density", "J8", sql=with_(VEC, GRID, f"""d AS (SELECT a.id AS i, b.id AS j, {DIST} AS d FROM g a JOIN g b ON a.id <> b.id AND abs(a.id - b.id) <= 50)""",
  "c AS (SELECT i, j, d, min(d) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d)") +
  "SELECT g.id + 1 AS seq, CAST(count(c.i) AS INT) AS density FROM g LEFT JOIN c ON c.i = g.id AND c.j < c.i AND c.d < coalesce(c.best, CAST('inf' AS DOUBLE)) GROUP BY g.id")
def _(spark, sf):
    return N.reverse_nn_density(grid(spark, sf), [], "features", window=50, bucket=120)
