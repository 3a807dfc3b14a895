"""Learners against plain numpy references and planted concepts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import broad as B
from tidemark.operators import density as DE
from tidemark.operators import ensembles as E
from tidemark.operators import metrics as M
from tidemark.operators import naive_bayes as NB
from tidemark.operators import neighbors as N
from tidemark.operators import regress as R
from tidemark.plans.keyed import keyed_scan


def concept(n=600, d=4, seed=0, flip=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    if flip:
        y[flip:] = 1 - y[flip:]
    return x, y


def frame(spark, x, y, **extra):
    pdf = pd.DataFrame({f"x{j}": x[:, j] for j in range(x.shape[1])})
    pdf["features"] = list(x)
    pdf["label"] = y
    pdf["seq"] = np.arange(1, len(y) + 1)
    for k, v in extra.items():
        pdf[k] = v
    return spark.createDataFrame(pdf)


def test_chunked_equals_per_row_at_chunk_one(spark):
    x, y = concept(200)
    df = frame(spark, x, y)
    rows = NB.prequential_nb(df, [], "seq", ["x0", "x1"], "label", [0, 1], span=37).select("seq", "y_pred")
    chunks = NB.chunked_nb(df.withColumn("c", F.col("seq")), [], "c", ["x0", "x1"], "label", [0, 1]).select("seq", "y_pred")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, chunks.collect()))


def test_missing_features_and_labels(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, None, 1), (3, 5.0, 1), (4, 5.1, None), (5, 4.9, 1), (6, 1.0, 0)], "seq bigint, x double, label int")
    out = {r["seq"]: r["y_pred"] for r in NB.prequential_nb(df, [], "seq", ["x"], "label", [0, 1]).collect()}
    assert out[2] is None and out[1] == 0 and out[5] == 1 and out[6] == 0
    stats = NB.nb_stats(df, [], ["x"], "label", [0, 1]).first()
    assert stats["n0"] == 2 and stats["n1"] == 2


def smw(nodes, x, y, size, n_classes, reg):
    """Recursive inverse update, chunk by chunk."""
    p = np.eye(nodes.width) / reg
    w = np.zeros((nodes.width, n_classes))
    out = []
    for lo in range(0, len(x), size):
        a, t = nodes(x[lo : lo + size]), np.eye(n_classes)[y[lo : lo + size]]
        out.append((a @ w).argmax(axis=1))
        p = p - p @ a.T @ np.linalg.inv(np.eye(len(a)) + a @ p @ a.T) @ a @ p
        w = w + p @ a.T @ (t - a @ w)
    return np.concatenate(out), w


@pytest.mark.parametrize("span", [2, 64])
def test_ridge_equals_the_recursive_update(spark, span):
    x, y = concept(300)
    nodes = B.NodeMap(4, nf=2, n1=3, ne=1, n2=5, seed=1)
    learner = B.BroadLearner(nodes, 2, reg=0.1)
    df = frame(spark, x, y).withColumn("c", F.expr("(seq - 1) div 30"))
    want, _ = smw(nodes, x, y, 30, 2, 0.1)
    models = learner.models(learner.stats(df, [], "c", "features", "label", salts=3), [], "c", span=span)
    got = learner.score(df, models, ["c"], "c", "features", salts=2).toPandas().sort_values("seq")["y_pred"].to_numpy()
    assert (got[30:] == want[30:]).mean() > 0.995
    assert (got[30:] == y[30:]).mean() > 0.85


def test_graph_term_equals_the_dense_laplacian():
    x, y = concept(40)
    nodes = B.NodeMap(4, nf=1, n1=3, ne=1, n2=3, whiten=False)
    learner = B.BroadLearner(nodes, 2, mode="graph", gamma=0.5, graph_k=3)
    gram, xty = np.zeros((nodes.width,) * 2), np.zeros((nodes.width, 2))
    hidden = np.where(np.arange(40) % 2 == 0, y, -1)
    learner.add(gram, xty, x, hidden, None)
    a = nodes(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1)[:, 1:4]
    adj = np.zeros((40, 40))
    np.put_along_axis(adj, near, 1, axis=1)
    adj = np.maximum(adj, adj.T)
    lap = np.diag(adj.sum(axis=1)) - adj
    c = np.diag((hidden >= 0).astype(float))
    np.testing.assert_allclose(gram, a.T @ c @ a + 0.5 * a.T @ lap @ a)
    edges = sum(np.outer(a[i] - a[j], a[i] - a[j]) for i in range(40) for j in range(40) if adj[i, j]) / 2
    np.testing.assert_allclose(a.T @ lap @ a, edges)


def test_extra_nodes_stay_silent_before_their_chunk():
    nodes = B.NodeMap(3, nf=1, n1=2, ne=1, n2=2, extra=((5, 1, 1),))
    x = np.ones((2, 3))
    a = nodes(x, np.array([4, 5]))
    base = 4
    assert nodes.width == a.shape[1] == 8
    assert np.all(a[0, base:] == 0) and np.all(a[1, base:] != 0)


def test_unlabelled_rows_help_nothing_in_plain_mode():
    x, y = concept(50)
    nodes = B.NodeMap(4, nf=1, n1=3, ne=1, n2=3)
    one = B.BroadLearner(nodes, 2)
    g1, t1 = np.zeros((nodes.width,) * 2), np.zeros((nodes.width, 2))
    g2, t2 = g1.copy(), t1.copy()
    one.add(g1, t1, x[:20], y[:20], None)
    one.add(g2, t2, x, np.where(np.arange(50) < 20, y, -1), None)
    np.testing.assert_allclose(g1, g2)
    np.testing.assert_allclose(t1, t2)


def test_bag_recovers_from_a_flipped_concept(spark):
    x, y = concept(4000, flip=2000)
    df = frame(spark, x, y, key=1)
    out = E.bagged_stream(df, ["key"], "seq", ["x0", "x1"], "label", 2, members=4, chunk=25).toPandas().sort_values("seq")
    hit = (out["y_true"] == out["y_pred"]).to_numpy()
    assert hit[500:2000].mean() > 0.85 and hit[3000:].mean() > 0.85
    assert out["swaps"].max() >= 4


def test_bag_does_not_depend_on_partitions(spark):
    x, y = concept(700, flip=350)
    df = frame(spark, x, y, key=np.where(np.arange(700) % 3 == 0, 1, 2))
    pick = lambda d: sorted(map(tuple, d.select("key", "seq", "y_pred").collect()))
    run = lambda d: pick(E.bagged_stream(d, ["key"], "seq", ["x0", "x1"], "label", 2, members=3))
    assert run(df) == run(df.repartition(7, "seq"))


@pytest.mark.parametrize("reinforced", [False, True])
def test_stable_dynamic_learns_with_few_labels(spark, reinforced):
    x, y = concept(2000)
    df = frame(spark, x, y, key=1)
    machine = E.StableDynamic(2, reinforced=reinforced)
    out = E.stable_dynamic(df, ["key"], "seq", ["x0", "x1"], "label", machine, F.rand(1)).toPandas()
    assert (out["label"] == out["y_pred"]).mean() > 0.85
    assert out["is_queried"].mean() < 0.5
    assert 5 < out["n_members"].max() <= (11 if reinforced else 10)


def test_expert_selection_learns_an_imbalanced_concept(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2))
    y = (rng.random(1500) < 0.15).astype(int)
    x[y == 1] += 2.5
    df = frame(spark, x, y, key=1).select("key", "seq", "features", "label")
    out = keyed_scan(df, ["key"], "seq", E.ExpertSelection(), keep=("label",)).toPandas()
    late = out[out["seq"] > 200]
    assert (late["label"] == late["y_pred"]).mean() > 0.9
    assert late.loc[late["label"] == 1, "y_pred"].mean() > 0.75


def test_varying_features_learns(spark):
    x, y = concept(3000, d=4)
    rng = np.random.default_rng(1)
    rows = [(1, i + 1, {j: float(x[i, j]) for j in range(4) if j == 0 or rng.random() < 0.7}, int(y[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, seq bigint, features map<int,double>, label int")
    out = keyed_scan(df, ["key"], "seq", E.VaryingFeatures(), keep=("label",)).toPandas().sort_values("seq")
    late = out.iloc[500:]
    assert (late["label"] == late["y_pred"]).mean() > 0.7


def test_chunk_weighted_ensemble_learns_and_drops_old_members(spark):
    x, y = concept(3000, flip=1500)
    df = frame(spark, x, y).withColumn("c", F.expr("(seq - 1) div 250"))
    pred, weights = E.chunk_weighted_ensemble(df, "c", "seq", ["x0", "x1"], "label", members=4, bags=3)
    acc = pred.groupBy("c").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("a")).toPandas().set_index("c")["a"]
    assert acc[5] > 0.85 and acc[6] < 0.3 and acc[11] > 0.85
    w = weights.toPandas()
    assert (w["weight"] <= 1).all() and (w["weight"] >= 0.1).all()
    assert (w["c"] - w["member"]).max() <= 4 and w[(w["c"] == 8) & (w["member"] < 6)].empty


def test_sgd_fits_a_line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2))
    t = 3 * x[:, 0] - 2 * x[:, 1] + 1
    df = frame(spark, x, np.zeros(1500, int), key=1, t=t)
    for kind in ("linear", "ridge", "lasso"):
        out = R.sgd_regression(df, ["key"], "seq", ["x0", "x1"], "t", R.Sgd(kind, rate=0.02, warm=100))
        assert M.regression_metrics(out, []).first()["R2"] > 0.95


def test_exact_and_bagged_ridge_fit_a_line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 2))
    t = 3 * x[:, 0] - 2 * x[:, 1] + 1
    df = frame(spark, x, np.zeros(1000, int), t=t).withColumn("c", F.expr("(seq - 1) div 100"))
    for out in (R.chunked_ridge(df, [], "c", ["x0", "x1"], "t", reg=1e-6), R.bagged_ridge(df, [], "c", "seq", ["x0", "x1"], "t", members=3, reg=1e-6)):
        later = out.filter("c > 0").withColumn("y_true", F.col("t"))
        assert M.regression_metrics(later, []).first()["MSE"] < 1e-6


def test_log_density_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.multivariate_normal([1, 2], [[2, 0.5], [0.5, 1]], size=500)
    df = spark.createDataFrame(pd.DataFrame({"b": 0, "p": x[:, 0], "q": x[:, 1]}))
    model = DE.BatchDensities.fit(df, "b", ["p", "q"])
    got = DE.mvn_logpdf(df, model, "b").toPandas()
    s = np.cov(x.T, bias=True)
    tr, sq = np.trace(s), (s * s).sum()
    r = min(1.0, ((1 - 2 / 2) * sq + tr**2) / ((500 + 1 - 2 / 2) * (sq - tr**2 / 2)))
    c = (1 - r) * s + r * tr / 2 * np.eye(2)
    gap = got[["p", "q"]].to_numpy() - x.mean(axis=0)
    want = -0.5 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(c)) + (gap @ np.linalg.inv(c) * gap).sum(axis=1))
    np.testing.assert_allclose(got["logpdf"], want, rtol=1e-6)


@pytest.mark.parametrize("tile", [16, 5000])
def test_neighbours_do_not_depend_on_tiles(spark, tile):
    x, _ = concept(400)
    df = frame(spark, x, np.zeros(400, int)).withColumn("b", F.lit(1)).withColumn("id", F.col("seq"))
    got = N.knn_join(df, df, ["b"], 3, exclude_self=True, tile=tile).toPandas().sort_values(["id", "rank"])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :3] + 1
    np.testing.assert_array_equal(got["neighbor"].to_numpy().reshape(-1, 3), want)


@pytest.mark.parametrize("spaces", [None, {0: [0], 1: [0, 1], 2: [1]}])
def test_bag_is_its_members_one_by_one(spark, spaces):
    """Members, detectors and models one after the other, row by row where a row decides."""
    from tidemark.functions.bayes import Sums
    from tidemark.functions.hashing import hash_poisson
    from tidemark.operators.detect import Ddm

    x, y = concept(600, flip=300)
    key, members, chunk = np.where(np.arange(600) % 4 == 0, 1, 2), 3, 20
    df = frame(spark, x, y, key=key)
    detector = Ddm(min_n=10, warning=1.5, out=2.0)
    got = E.bagged_stream(df, ["key"], "seq", ["x0", "x1"], "label", 2, members=members, chunk=chunk, subspaces=spaces, detector=detector)
    got = {(r["key"], r["seq"]): (r["y_pred"], r["swaps"]) for r in got.collect()}
    draws = df.select("key", "seq", "x0", "x1", "label", *[hash_poisson(F.concat_ws("-", "key", "seq"), F.lit(f"42:bag{m}"), 6.0).alias(f"w{m}") for m in range(members)])
    swapped = 0
    for k, part in draws.toPandas().sort_values("seq").groupby("key"):
        states = [dict(live=Sums.zeros(2, len(spaces[m]) if spaces else 2), back=None, hits=0, seen=0, swaps=0, watch=detector.start()) for m in range(members)]
        for lo in range(0, len(part), chunk):
            rows = part.iloc[lo : lo + chunk]
            label, votes, swaps = rows["label"].to_numpy(), np.zeros((len(rows), 2)), sum(s["swaps"] for s in states)
            for m, s in enumerate(states):
                v = rows[["x0", "x1"]].to_numpy()[:, spaces[m] if spaces else [0, 1]]
                guess = s["live"].predict(v)
                votes[np.arange(len(rows)), guess] += s["hits"] / s["seen"] if s["seen"] else 1.0
                kinds = []
                for wrong in guess != label:
                    s["watch"], alarm = detector.feed(s["watch"], {"x": np.array([float(wrong)])})
                    kinds += list(alarm["kind"])
                s["hits"], s["seen"] = s["hits"] + int((guess == label).sum()), s["seen"] + len(rows)
                new = Sums.of(v, label, 2, rows[f"w{m}"].to_numpy().astype(float))
                if len(rows) == chunk:
                    s["live"], s["back"] = s["live"] + new, s["back"] + new if s["back"] is not None else None
                    if "change" in kinds:
                        s.update(live=s["back"] or Sums.zeros(2, v.shape[1]), back=None, hits=0, seen=0, swaps=s["swaps"] + 1)
                    elif "warning" in kinds and s["back"] is None:
                        s["back"] = new
            for i, seq in enumerate(rows["seq"]):
                assert got[k, seq] == (votes[i].argmax(), swaps), (k, seq)
        swapped += sum(s["swaps"] for s in states)
    assert swapped


def test_bags_by_name(spark):
    from tidemark import registry

    x, y = concept(400, flip=200)
    df = frame(spark, x, y, key=np.where(np.arange(400) % 2 == 0, 1, 2))
    run = registry.prequential(df, "adaptive_bagging, random_patches, adwin_random_patches", order="seq", features=["x0", "x1"], label="label", n_classes=2, keys=["key"])
    assert {r["method"]: r["count"] for r in run.groupBy("method").count().collect()} == {"adaptive_bagging": 400, "random_patches": 400, "adwin_random_patches": 400}
