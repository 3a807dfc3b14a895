"""Queries over sources, sinks and feature transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import maps as MP
from tidemark.functions.hashing import hash_normal, hash_poisson, hash_uniform, poisson_cdf
from tidemark.operators import features as FT
from tidemark.operators import metrics as M
from tidemark.plans.scan import with_chunk, with_global_seq, with_seq
from tidemark.queries import query
from tidemark.queries.base import EV, LI, PRED, VEC, events, lines, predictions, table, uniform_sql, vectors, with_
from tidemark.session import scratch_path
from tidemark.sources import predictions as P
from tidemark.sources import tables as S

CLS = [0, 1, 2, 3, 4]


@query("labelled_table", "S1", sql=with_(EV) + "SELECT user_id, seq, [CAST(cents AS DOUBLE), CAST(hr AS DOUBLE), CAST(k AS DOUBLE)] AS features, y AS label FROM ev")
def _(spark, sf):
    return S.labelled_table(events(spark, sf), ["cents", "hr", "k"], "y", "seq", key=["user_id"])


@query("csv_labelled", "S1", sql=with_(LI) + "SELECT label, count(*) AS n, sum(qty) AS s0, sum(disc) AS s1 FROM li GROUP BY label")
def _(spark, sf):
    path = scratch_path(spark, "csv-labelled")
    lines(spark, sf).select("qty", "disc", "label").write.csv(path, header=True)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("qty", T.DoubleType()), T.StructField("disc", T.DoubleType()), T.StructField("label", T.IntegerType())])
    t = S.read_labelled_csv(spark, path, schema)
    return t.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.get("features", F.lit(0))).alias("s0"), F.sum(F.get("features", F.lit(1))).alias("s1"))


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


@query("global_sequence", "S2", sql=f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS seq,
  (row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1) // 1000 AS chunk_id FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE_ORDER)
    return with_chunk(with_global_seq(li, LINE_ORDER), 1000).drop("l_shipdate")


@query("keyed_sequence", "S2", sql=with_(EV) + """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq,
  (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 25 AS chunk_id FROM ev""")
def _(spark, sf):
    e = events(spark, sf).select("user_id", "event_id")
    return with_chunk(with_seq(e, ["user_id"], "event_id"), 25)


@query("warmup_split", "S3", sql=with_(EV) + """SELECT 'warmup' AS part, count(*) AS n, sum(cents) AS cents FROM ev WHERE seq <= 2000
  UNION ALL SELECT 'stream', count(*), sum(cents) FROM ev WHERE seq > 2000""")
def _(spark, sf):
    e = events(spark, sf)
    tag = lambda d, name: d.agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).withColumn("part", F.lit(name))
    return tag(S.warmup(e, 2000), "warmup").unionByName(tag(S.stream_part(e, 2000), "stream"))


@query("write_predictions", "S5", sql=with_(PRED) + "SELECT method, round, seq, y_true, y_pred FROM pred")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    P.write_predictions(predictions(spark, sf).select("method", "round", "seq", "y_true", "y_pred"), path)
    return P.read_predictions(spark, path).withColumn("method", F.col("method").cast("string"))


@query("predictions_to_wide", "S6", sql=with_(PRED) + "SELECT method, round, string_agg(CAST(y_pred AS VARCHAR), ',' ORDER BY seq) AS line FROM pred GROUP BY ALL")
def _(spark, sf):
    return P.predictions_to_wide(predictions(spark, sf), "y_pred", ["method", "round"])


@query("wide_to_long", "S6", sql=with_(PRED) + "SELECT method, round, seq, y_pred FROM pred")
def _(spark, sf):
    wide = P.predictions_to_wide(predictions(spark, sf), "y_pred", ["method", "round"])
    return P.wide_to_long(wide, ["method", "round"], "y_pred")


@query("read_wide_predictions", "S6", sql=with_(PRED) + "SELECT method, CAST(round AS BIGINT) AS round, seq, y_pred FROM pred")
def _(spark, sf):
    """A text file per method with one line per round, written and read again."""
    path = scratch_path(spark, "wide-predictions")
    P.write_wide_predictions(P.predictions_to_wide(predictions(spark, sf), "y_pred", ["method", "round"]), path, ["method"], "round")
    return P.read_wide_predictions(spark, path, "y_pred").withColumn("method", F.regexp_extract("file", "method=([^/]+)/", 1)).select("method", "round", "seq", "y_pred")


@query("write_confusion", "S9", sql=with_(PRED) + "SELECT 'True_' || CAST(y_true AS VARCHAR) AS class, " + ", ".join(
    f"CAST(count(*) FILTER (y_pred = {c}) AS VARCHAR) AS Pred_{c}" for c in CLS) + " FROM pred GROUP BY y_true")
def _(spark, sf):
    path = scratch_path(spark, "confusion")
    P.write_confusion(M.confusion_matrix(predictions(spark, sf), [], CLS), path, CLS)
    return spark.read.csv(path, header=True)


@query("read_headerless_scaled", "S13", "P2", sql=with_(LI) + """SELECT label, count(*) AS n, round(sum((qty - a) / sa), 2) AS f0, round(sum((disc - b) / sb), 2) AS f1 FROM
  (SELECT CAST(label AS DOUBLE) AS label, qty, disc, avg(qty) OVER () AS a, stddev_pop(qty) OVER () AS sa, avg(disc) OVER () AS b, stddev_pop(disc) OVER () AS sb FROM li) GROUP BY label""")
def _(spark, sf):
    path = scratch_path(spark, "headerless")
    lines(spark, sf).select("qty", "disc", "label").write.csv(path, header=False)
    t = S.read_headerless_scaled(spark, path, 2)
    return t.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("f0"), 2).alias("f0"), F.round(F.sum("f1"), 2).alias("f1"))


@query("class_dictionary", "P1", sql="SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS class_id, event_type AS value FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, sf):
    return S.class_dictionary(table(spark, sf, "events"), "event_type")


@query("standardize", "P2", sql=with_(EV) + """SELECT event_id, round((cents - m) / (s + 1e-6), 6) AS cents, round((k - mk) / (sk + 1e-6), 6) AS k FROM ev,
  (SELECT avg(cents) AS m, stddev_pop(cents) AS s, avg(k) AS mk, stddev_pop(k) AS sk FROM ev WHERE seq <= 500)""")
def _(spark, sf):
    e = events(spark, sf)
    fitted = S.Standardizer.fit(S.warmup(e, 500), ["cents", "k"])
    return fitted.transform(e).select("event_id", F.round("cents", 6).alias("cents"), F.round("k", 6).alias("k"))


@query("one_hot", "P3", sql="SELECT vec_id, list_transform(range(0, 10), lambda i: CAST(i = label AS INT)::DOUBLE) AS code FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", A.one_hot(F.col("label"), 10).alias("code"))


@query("activations", "P5", sql=with_(VEC) + """SELECT vec_id, list_transform(features, lambda x: round(1 / (1 + exp(-x)), 6)) AS sigmoid, list_transform(features, lambda x: round(x, 6)) AS linear,
  list_transform(features, lambda x: round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 6)) AS tanh, list_transform(features, lambda x: round(greatest(x, 0), 6)) AS relu, list_transform(features, lambda x: round(2 / (1 + exp(-2 * x)) - 1, 6)) AS tansig FROM vec""")
def _(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", *[F.transform(A.activate(F.col("features"), n), lambda x: F.round(x, 6)).alias(n) for n in A.ACTIVATIONS])


SOFT = """soft AS (SELECT vec_id, list_transform(features, lambda x: exp(x - list_max(features))) AS e, features FROM vec),
proba AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, features FROM soft)"""


@query("softmax_argmax", "P6", sql=with_(VEC, SOFT) + """SELECT vec_id, list_transform(p, lambda x: round(x, 8)) AS p, CAST(list_position(features, list_max(features)) - 1 AS INT) AS top FROM proba""")
def _(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", F.transform(A.softmax(F.col("features")), lambda x: F.round(x, 8)).alias("p"), A.argmax_first(F.col("features")).alias("top"))


@query("minmax_sum_normalize", "P7", sql=with_(VEC) + """, m AS (SELECT vec_id, list_transform(features, lambda x: (x - list_min(features)) / (list_max(features) - list_min(features) + 1e-10)) AS m FROM vec)
  SELECT vec_id, list_transform(m, lambda x: round(x / list_sum(m), 8)) AS p FROM m""")
def _(spark, sf):
    v = vectors(spark, sf)
    return v.select("vec_id", F.transform(A.minmax_sum_normalize(F.col("features")), lambda x: F.round(x, 8)).alias("p"))


@query("proba_margins", "T3", sql=with_(VEC, SOFT) + """SELECT vec_id, round(list_max(p), 8) AS max_proba, round(list_max(p) - list_min(p), 8) AS range_margin,
  round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 8) AS top2_margin FROM proba""")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("p", A.softmax(F.col("features")))
    p = F.col("p")
    return v.select("vec_id", F.round(A.max_proba(p), 8).alias("max_proba"), F.round(A.range_margin(p), 8).alias("range_margin"), F.round(A.top2_margin(p), 8).alias("top2_margin"))


@query("array_norms", "array functions", sql=with_(VEC) + """SELECT vec_id, round(list_sum(list_transform(features, lambda x: abs(x))), 6) AS l1, round(sqrt(list_sum(list_transform(features, lambda x: x * x))), 6) AS l2,
  list_max(list_transform(features, lambda x: abs(x))) AS linf, round(list_sum(list_transform(features, lambda x: (x - 0.5) * (x - 0.5))), 6) AS d2 FROM vec""")
def _(spark, sf):
    v = vectors(spark, sf)
    f = F.col("features")
    half = F.transform(f, lambda x: F.lit(0.5))
    return v.select("vec_id", F.round(A.norm_l1(f), 6).alias("l1"), F.round(A.norm_l2(f), 6).alias("l2"), A.norm_max(f).alias("linf"), F.round(A.squared_distance(f, half), 6).alias("d2"))


@query("divergences", "G15", sql=with_(VEC) + """, d AS (SELECT vec_id, list_transform(features[1:32], lambda x: abs(x) + 0.01) AS a, list_transform(features[33:64], lambda x: abs(x) + 0.01) AS b FROM vec),
  n AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q FROM d),
  z AS (SELECT vec_id, p, q, list_transform(list_zip(p, q), lambda t: (t[1] + t[2]) / 2) AS m FROM n)
  SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda t: t[1] * ln(t[1] / t[2]))), 6) AS kl,
    round((list_sum(list_transform(list_zip(p, m), lambda t: t[1] * ln(t[1] / t[2]))) + list_sum(list_transform(list_zip(q, m), lambda t: t[1] * ln(t[1] / t[2])))) / 2, 6) AS js FROM z""")
def _(spark, sf):
    shift = lambda a: F.transform(a, lambda x: F.abs(x) + 0.01)
    v = vectors(spark, sf).select("vec_id", shift(F.slice("features", 1, 32)).alias("a"), shift(F.slice("features", 33, 32)).alias("b"))
    return v.select("vec_id", F.round(A.kl_divergence(F.col("a"), F.col("b")), 6).alias("kl"), F.round(A.js_divergence(F.col("a"), F.col("b")), 6).alias("js"))


@query("rank_divergence", "G15", sql=with_(VEC) + """, r AS (SELECT vec_id, list_transform(features[1:32], lambda x: CAST(len(list_filter(features[1:32], lambda y: y < x)) AS DOUBLE)) AS a,
    list_transform(features[33:64], lambda x: CAST(len(list_filter(features[33:64], lambda y: y < x)) AS DOUBLE)) AS b FROM vec),
  n AS (SELECT vec_id, list_transform(a, lambda x: (x + 1) / 528) AS p, list_transform(b, lambda x: (x + 1) / 528) AS q FROM r)
  SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda t: t[1] * ln(t[1] / t[2]) + t[2] * ln(t[2] / t[1]))), 6) AS jeffreys FROM n""")
def _(spark, sf):
    rank = lambda a: F.transform(a, lambda x: F.size(F.filter(a, lambda y: y < x)).cast("double"))
    v = vectors(spark, sf)
    return v.select("vec_id", F.round(A.jeffreys_rank_divergence(rank(F.slice("features", 1, 32)), rank(F.slice("features", 33, 32))), 6).alias("jeffreys"))


@query("permute_features", "P8", sql=with_(VEC) + f""", b AS (SELECT vec_id, vec_id // 50 AS batch, features AS f FROM vec),
 sw AS (SELECT *, CAST(floor({uniform_sql('batch', "'42:a'")} * 64) AS INT) AS sa, (CAST(floor({uniform_sql('batch', "'42:a'")} * 64) AS INT) + 1 + CAST(floor({uniform_sql('batch', "'42:b'")} * 63) AS INT)) % 64 AS sb,
   list_sort([{', '.join(f"{{'u': {uniform_sql('batch', repr(f'42:perm{i}'))}, 'i': {i}}}" for i in range(64))}]) AS dr FROM b)
 SELECT vec_id, CASE WHEN batch = 0 THEN f ELSE list_transform(range(0, 64), lambda i: f[((i - batch) % 64 + 64) % 64 + 1]) END AS rotated,
   CASE WHEN batch = 0 THEN f ELSE list_transform(dr, lambda d: f[d.i + 1]) END AS permuted,
   CASE WHEN batch = 0 THEN f ELSE list_transform(range(0, 64), lambda i: f[CASE WHEN i = sa THEN sb WHEN i = sb THEN sa ELSE i END + 1]) END AS swapped FROM sw""")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 50))
    f, b = F.col("features"), F.col("batch")
    return v.select("vec_id", FT.permute_features(f, b, 64, "rotate").alias("rotated"), FT.permute_features(f, b, 64, "permute").alias("permuted"), FT.permute_features(f, b, 64, "swap").alias("swapped"))


@query("drop_features_trapezoidal", "P9", "P10", sql=with_(VEC) + """, n AS (SELECT count(*) AS n FROM vec), x AS (SELECT vec_id, features AS f, n, CASE WHEN seq = n THEN 62 ELSE (CAST(floor((seq - 1) / (n / 10.0)) AS INT) + 1) * 6 END AS keep FROM vec, n)
  SELECT vec_id, len(list_filter(range(0, 64), lambda i: i <= keep)) AS n_kept, round(list_sum(list_transform(list_filter(range(0, 64), lambda i: i <= keep), lambda i: f[i + 1])), 6) AS total FROM x""")
def _(spark, sf):
    v = vectors(spark, sf)
    n = v.count()
    x = v.withColumn("x", FT.drop_features(MP.to_sparse_map(F.col("features")), F.col("seq"), n, 64, "trapezoidal"))
    return x.select("vec_id", F.size(F.map_keys("x")).cast("bigint").alias("n_kept"), F.round(A.array_sum(MP.sorted_values(F.col("x"))), 6).alias("total"))


@query("drop_features_capricious", "P9", sql=with_(VEC) + f""", n AS (SELECT count(*) AS n FROM vec),
  x AS (SELECT vec_id, features AS f, least(32 * (1 + seq // CAST(ceil(n * 0.5) AS BIGINT)), 64) AS keep, list_sort([{', '.join(f"{{'u': {uniform_sql('seq', repr(f'42:drop{i}'))}, 'i': {i}}}" for i in range(64))}]) AS dr FROM vec, n)
  SELECT vec_id, list_sort(list_transform(dr[1:keep], lambda d: d.i)) AS kept FROM x""")
def _(spark, sf):
    v = vectors(spark, sf)
    n = v.count()
    x = v.withColumn("x", FT.drop_features(MP.to_sparse_map(F.col("features")), F.col("seq"), n, 64, "capricious"))
    return x.select("vec_id", F.array_sort(F.map_keys("x")).alias("kept"))


@query("to_sparse_map", "P10", sql=with_(VEC) + """SELECT vec_id, list_transform(list_filter(range(0, 64), lambda i: greatest(features[i + 1], 0) <> 0), lambda i: CAST(i AS INT)) AS keys,
  list_transform(list_filter(range(0, 64), lambda i: greatest(features[i + 1], 0) <> 0), lambda i: features[i + 1]) AS vals FROM vec""")
def _(spark, sf):
    v = vectors(spark, sf)
    x = v.withColumn("x", MP.to_sparse_map(A.activate(F.col("features"), "relu"), drop_zeros=True))
    return x.select("vec_id", F.array_sort(F.map_keys("x")).alias("keys"), MP.sorted_values(F.col("x")).alias("vals"))


@query("signed_label", "P11", sql=with_(EV) + "SELECT event_id, CAST(CASE WHEN y = 1 THEN 1 ELSE -1 END AS INT) AS signed, y AS unsigned FROM ev")
def _(spark, sf):
    e = events(spark, sf).withColumn("signed", FT.signed_label(F.col("y")))
    return e.select("event_id", "signed", FT.unsigned_label(F.col("signed")).alias("unsigned"))


@query("subspaces", "P12", sql=with_(VEC) + f""", c AS (SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS combo, [a, b, c, d] AS f FROM range(0, 7) x(a), range(0, 7) y(b), range(0, 7) z(c), range(0, 7) w(d) WHERE a < b AND b < c AND c < d),
  o AS (SELECT f, row_number() OVER (ORDER BY {uniform_sql('combo', "'42:space'")}, f) - 1 AS pos FROM c)
  SELECT vec_id, CAST(pos AS INT) AS member, list_transform(f, lambda i: features[i + 1]) AS sub FROM vec, o WHERE pos < 10""")
def _(spark, sf):
    v = vectors(spark, sf, 7)
    spaces = {r["member"]: list(r["features"]) for r in FT.subspaces(spark, 7, 10, "percentage", 60).collect()}
    views = F.explode(F.array(*[F.struct(F.lit(m).alias("member"), A.pick(F.col("features"), ids).alias("sub")) for m, ids in sorted(spaces.items())]))
    return v.select("vec_id", views.alias("s")).select("vec_id", "s.member", "s.sub")


@query("row_filters", "P13", sql=with_(LI) + "SELECT count(*) AS n, sum(qty) AS qty FROM li WHERE disc <> 0")
def _(spark, sf):
    li = lines(spark, sf).withColumn("y", F.when(F.col("disc") != 0, F.col("disc")))
    return li.filter(F.col("y").isNotNull()).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("sparsify", "P14", sql=with_(VEC) + """, w AS (SELECT vec_id, features[1:32] AS w, list_transform(features[33:64], lambda x: abs(x)) AS v FROM vec),
  i AS (SELECT vec_id, w, list_transform(v, lambda x: x / list_sum(v)) AS info FROM w),
  s AS (SELECT vec_id, w, least(1.0, 0.05 / list_sum(list_transform(list_zip(w, info), lambda t: abs(t[1]) * t[2]))) AS s, list_reverse_sort(w)[12] AS cut FROM i)
  SELECT vec_id, list_transform(w, lambda x: round(CASE WHEN x >= cut THEN x * s ELSE 0 END, 8)) AS w FROM s""")
def _(spark, sf):
    v = vectors(spark, sf)
    w = MP.to_sparse_map(F.slice("features", 1, 32))
    var = MP.to_sparse_map(F.transform(F.slice("features", 33, 32), F.abs))
    x = v.select("vec_id", MP.sparsify(w, MP.informativeness(var), keep_share=0.4, radius=0.05).alias("w"))
    return x.select("vec_id", F.transform(MP.sorted_values(F.col("w")), lambda z: F.round(z, 8)).alias("w"))


@query("map_share_new", "J7", "U2", sql=with_(VEC) + """, m AS (SELECT vec_id, features[1:32] AS f, list_transform(list_filter(range(0, 32), lambda i: features[i + 1] > 0), lambda i: CAST(i AS INT)) AS a,
   list_transform(list_filter(range(0, 32), lambda i: features[i + 33] > 0), lambda i: CAST(i AS INT)) AS b FROM vec)
  SELECT vec_id, list_filter(a, lambda i: list_contains(b, i)) AS shared, list_filter(a, lambda i: NOT list_contains(b, i)) AS fresh,
   list_transform(list_filter(a, lambda i: list_contains(b, i)), lambda i: f[i + 1]) AS vals FROM m""")
def _(spark, sf):
    v = vectors(spark, sf)
    pos = lambda lo: F.map_filter(MP.to_sparse_map(F.slice("features", lo, 32)), lambda k, x: x > 0)
    x = v.select("vec_id", pos(1).alias("a"), pos(33).alias("b"))
    shared = MP.shared_keys(F.col("a"), F.col("b"))
    return x.select("vec_id", shared.alias("shared"), MP.new_keys(F.col("a"), F.col("b")).alias("fresh"), MP.sorted_values(MP.subset(F.col("a"), shared)).alias("vals"))


@query("sparse_dot", "map functions", sql=with_(VEC) + "SELECT vec_id, round(coalesce(list_sum(list_transform(list_filter(range(1, 33), lambda i: features[i] > 0 AND features[i + 32] > 0), lambda i: features[i] * features[i + 32])), 0), 8) AS d FROM vec")
def _(spark, sf):
    v = vectors(spark, sf)
    pos = lambda lo: F.map_filter(MP.to_sparse_map(F.slice("features", lo, 32)), lambda k, x: x > 0)
    return v.select("vec_id", F.round(MP.sparse_dot(pos(1), pos(33)), 8).alias("d"))


@query("append_batches", "U1", sql="""SELECT batch, count(*) AS n, sum(CAST(round(v * 100) AS BIGINT)) AS cents FROM (
  SELECT 0 AS batch, o_totalprice AS v FROM orders UNION ALL SELECT 1, l_extendedprice FROM lineitem UNION ALL SELECT 2, value FROM events) GROUP BY batch""")
def _(spark, sf):
    parts = [("orders", "o_totalprice"), ("lineitem", "l_extendedprice"), ("events", "value")]
    frames = [table(spark, sf, t).select(F.lit(i).alias("batch"), F.round(F.col(c) * 100).cast("bigint").alias("cents")) for i, (t, c) in enumerate(parts)]
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return both.groupBy("batch").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("hash_draws", "H0", sql=with_(EV) + f"""SELECT event_id, {uniform_sql('event_id', "'a'")} AS u,
  CAST(len(list_filter([{', '.join(repr(p) for p in poisson_cdf(6.0, 1e-10))}], lambda p: p <= {uniform_sql('event_id', "'p'")})) AS INT) AS pois,
  round(sqrt(-2 * ln(greatest({uniform_sql('event_id', "'n:r'")}, 1e-12))) * cos(2 * pi() * {uniform_sql('event_id', "'n:a'")}), 6) AS z FROM ev""")
def _(spark, sf):
    e = events(spark, sf)
    i = F.col("event_id")
    return e.select("event_id", hash_uniform(i, "a").alias("u"), hash_poisson(i, "p", 6.0).alias("pois"), F.round(hash_normal(i, "n"), 6).alias("z"))
